"""Transforms on coordinate entries ``(i, j, v)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import idiv


def transpose(df: DataFrame) -> DataFrame:
    """Swap row and column."""
    return df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def symmetrize(df: DataFrame, self_loops: str = "double") -> DataFrame:
    """``A + A^T`` as entries, in one scan (no union of two reads).

    Each entry ``(a, b, v)`` yields ``(a, b, v)`` and ``(b, a, v)``, so a
    self-loop ``(a, a, v)`` appears twice (``self_loops='double'``, the
    reference's behaviour: it sums to ``2v``) or once (``'once'``).
    """
    fwd = F.struct(F.col("i").alias("i"), F.col("j").alias("j"), F.col("v").alias("v"))
    back = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("v"))
    if self_loops == "double":
        both = F.array(fwd, back)
    elif self_loops == "once":
        both = F.when(F.col("i") == F.col("j"), F.array(fwd)).otherwise(F.array(fwd, back))
    else:
        raise ValueError("self_loops must be 'double' or 'once'")
    return df.select(F.explode(both).alias("e")).select("e.i", "e.j", "e.v")


def symmetrize_union(df: DataFrame) -> DataFrame:
    """Two-pass form of ``symmetrize``: ``A UNION ALL A^T`` (older editions)."""
    return df.select("i", "j", "v").unionByName(transpose(df))


def dedupe(df: DataFrame, how: str = "sum", order_col: str | None = None) -> DataFrame:
    """Resolve duplicate ``(i, j)`` entries.

    ``sum`` adds them (what conversions to blocks do, and the default here so
    every strategy agrees); ``last`` keeps the value with the greatest
    ``order_col`` (the replicate reducer's last-wins map; equal order values
    are broken by the larger value, so retries agree); ``error`` raises if
    any cell repeats (indexed-row conversion), now and in a pass of its own;
    ``raise`` fails in the job that uses the entries and names the cell.
    """
    if how == "sum":
        return df.groupBy("i", "j").agg(F.sum("v").alias("v"))
    if how == "last":
        if order_col is None:
            raise ValueError("dedupe(how='last') needs an order column")
        return df.groupBy("i", "j").agg(F.max_by("v", F.struct(order_col, "v")).alias("v"))
    if how == "error":
        dup = df.groupBy("i", "j").count().where(F.col("count") > 1)
        if dup.limit(1).count():
            raise ValueError("Found duplicate indices")
        return df.select("i", "j", "v")
    if how == "raise":
        once = df.groupBy("i", "j").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("_n"))
        said = _cell_text("duplicate entry ", "")
        return once.where(_must(F.col("_n") == 1, said)).select("i", "j", "v")
    raise ValueError(f"unknown dedupe policy {how!r}")


def _must(cond, said):
    """``cond`` as a filter that fails the job where it does not hold."""
    return F.when(cond, True).otherwise(F.raise_error(said).cast("boolean"))


def _cell_text(before: str, after: str):
    i, j = (F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("i", "j"))
    return F.concat(F.lit(f"{before}("), i, F.lit(", "), j, F.lit(f"){after}"))


def drop_zeros(df: DataFrame) -> DataFrame:
    """Keep stored non-zeros only."""
    return df.where(F.col("v") != 0)


def in_shape(n_rows: int | None, n_cols: int | None):
    cond = (F.col("i") >= 0) & (F.col("j") >= 0)
    if n_rows is not None:
        cond = cond & (F.col("i") < n_rows)
    if n_cols is not None:
        cond = cond & (F.col("j") < n_cols)
    return cond


def shape_stats(df: DataFrame, n_rows: int | None = None, n_cols: int | None = None) -> DataFrame:
    """One-row summary in one aggregate pass: entry count, index ranges and
    how many entries fall outside the declared shape."""
    return df.agg(
        F.count(F.lit(1)).alias("nnz"),
        F.min("i").alias("min_i"), F.max("i").alias("max_i"),
        F.min("j").alias("min_j"), F.max("j").alias("max_j"),
        F.count_if(~in_shape(n_rows, n_cols)).cast("long").alias("outside"),
    )


def validate_shape(df: DataFrame, n_rows: int | None, n_cols: int | None,
                   policy: str = "drop") -> DataFrame:
    """Apply a declared shape.

    ``drop``: silently discard out-of-shape entries (the replicate reducer
    never visits them); ``error``: raise if any exist (block conversion), now
    and in a pass of its own; ``raise``: fail in the job that uses the
    entries, naming the first one met; ``ignore``: leave entries alone (outer
    product never looks at shape).
    """
    if policy == "ignore":
        return df
    if policy == "drop":
        return df.where(in_shape(n_rows, n_cols))
    if policy == "error":
        bad = df.where(~in_shape(n_rows, n_cols)).limit(1).collect()
        if bad:
            r = bad[0]
            raise ValueError(f"entry ({r['i']}, {r['j']}) out of range for shape ({n_rows}, {n_cols})")
        return df
    if policy == "raise":
        return df.where(_must(in_shape(n_rows, n_cols), _cell_text("entry ", f" out of range for shape ({n_rows}, {n_cols})")))
    raise ValueError(f"unknown shape policy {policy!r}")


def column_groups(df: DataFrame, h: int) -> DataFrame:
    """Split columns into ``h`` groups by modulus: ``g = j mod h`` and the
    compact position ``c = j div h`` inside the group (``j = c * h + g``)."""
    return df.withColumn("g", F.pmod(F.col("j"), F.lit(h)).cast("int")).withColumn(
        "c", idiv("j", h))


def from_column_groups(df: DataFrame, h: int) -> DataFrame:
    """Map compact column positions back: ``j = c * h + g``."""
    return df.withColumn("j", (F.col("c") * F.lit(h) + F.col("g")).cast("long"))
