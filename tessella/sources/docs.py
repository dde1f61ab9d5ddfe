"""Exported JSON documents: one collection holding both operands, grouped
per-inner-index documents, and cell-keyed result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType([
    T.StructField("i", T.LongType(), True),
    T.StructField("j", T.LongType(), True),
    T.StructField("k", T.LongType(), True),
    T.StructField("v", T.DoubleType(), True),
])
LEFT_LIST = "array<struct<i:bigint,v:double>>"
RIGHT_LIST = "array<struct<k:bigint,v:double>>"


def docs_of(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left entries as ``{i, j, v}`` and right entries as ``{j, k, v}``."""
    null = F.lit(None).cast("long")
    a = left.select(F.col("i"), F.col("j"), null.alias("k"), F.col("v"))
    b = right.select(null.alias("i"), F.col("i").alias("j"), F.col("j").alias("k"), F.col("v"))
    return a.unionByName(b)


def write_docs(left: DataFrame, right: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; absent fields are omitted, as in the exported collection."""
    docs_of(left, right).write.mode(mode).json(path)


def _checked(df: DataFrame, good, said, on_bad: str, columns: list[str]) -> DataFrame:
    """``columns`` of the rows where ``good`` holds; others fail the job
    (``on_bad='error'``) with ``said`` or are left out (``'drop'``).  A row is
    looked at before any of its columns can be, so that no filter on a column
    goes to the reader and hides it."""
    if on_bad not in ("error", "drop"):
        raise ValueError(f"on_bad must be 'error' or 'drop', not {on_bad!r}")
    good = F.coalesce(good, F.lit(False))
    if on_bad == "drop":
        return df.where(good).select(*columns)
    whole = F.struct(*columns)
    error = F.raise_error(F.concat(F.lit("bad document: "), said))
    return df.select(F.when(good, whole).otherwise(error.cast(df.select(whole.alias("x")).schema["x"].dataType)).alias("_doc")).select(
        *[F.col("_doc").getField(c).alias(c) for c in columns])


def read_docs(spark: SparkSession, path: str, on_bad: str = "error") -> DataFrame:
    """JSON lines -> ``(i, j, k, v)``.  A document is bad if it does not
    parse, a field has another type, the inner index or the value is missing,
    or both outer indices are; checked inside the job that reads it."""
    schema = T.StructType(list(DOC_SCHEMA) + [T.StructField("_bad", T.StringType(), True)])
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path)
    good = (F.col("_bad").isNull() & F.col("j").isNotNull() & F.col("v").isNotNull()
            & (F.col("i").isNotNull() | F.col("k").isNotNull()))
    said = F.coalesce("_bad", F.to_json(F.struct("i", "j", "k", "v")))
    return _checked(raw, good, said, on_bad, ["i", "j", "k", "v"])


def side_predicates(docs: DataFrame):
    """Which operand a document belongs to, decided by field presence.

    Left iff ``k`` is missing or zero and ``i`` is present; right iff ``i``
    is missing or zero and ``k`` is present.  So index 0 does not mark a
    side: ``{i: 0, k: 5}`` is a right entry, ``{i: 0, k: 0}`` is both, and a
    document with non-zero ``i`` and ``k`` is neither."""
    is_left = F.col("i").isNotNull() & (F.coalesce(F.col("k"), F.lit(0)) == 0)
    is_right = F.col("k").isNotNull() & (F.coalesce(F.col("i"), F.lit(0)) == 0)
    return is_left, is_right


def split_docs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One document collection -> ``(left, right)`` entries."""
    is_left, is_right = side_predicates(docs)
    ok = F.col("j").isNotNull() & F.col("v").isNotNull()
    left = docs.where(is_left & ok).select("i", "j", "v")
    right = docs.where(is_right & ok).select(F.col("j").alias("i"), F.col("k").alias("j"), "v")
    return left, right


def grouped_json(docs: DataFrame) -> DataFrame:
    """Grouped documents ``(c, ..., left, right)`` -> ``(j, i, k)`` with the
    two lists as JSON text, the exported form of the per-index documents."""
    return docs.select(
        F.col("c").alias("j"),
        F.to_json(F.transform("left", lambda e: F.struct(e["i"].alias("i"), e["v"].alias("v")))).alias("i"),
        F.to_json(F.transform("right", lambda e: F.struct(e["k"].alias("k"), e["w"].alias("v")))).alias("k"))


def parse_grouped(df: DataFrame, on_bad: str = "error") -> DataFrame:
    """JSON text lists back to arrays of structs (``from_json``).

    A missing list is an empty one.  A list that does not parse, or holds an
    element without index or value, makes its document bad; checked inside
    the job."""
    out = df.select("j", F.col("i").alias("_i"), F.col("k").alias("_k"),
                    F.from_json("i", LEFT_LIST).alias("left"), F.from_json("k", RIGHT_LIST).alias("right"))

    def whole(text: str, parsed: str, index: str):
        return F.col(text).isNull() | F.coalesce(
            F.forall(parsed, lambda e: e.isNotNull() & e[index].isNotNull() & e["v"].isNotNull()), F.lit(False))

    said = F.to_json(F.struct("j", F.col("_i").alias("i"), F.col("_k").alias("k")))
    good = F.col("j").isNotNull() & whole("_i", "left", "i") & whole("_k", "right", "k")
    return _checked(out, good, said, on_bad, ["j", "left", "right"]).select(
        "j", F.coalesce("left", F.from_json(F.lit("[]"), LEFT_LIST)).alias("left"),
        F.coalesce("right", F.from_json(F.lit("[]"), RIGHT_LIST)).alias("right"))


def cell_docs(df: DataFrame, integer_values: bool = False) -> DataFrame:
    """Result cells as ``{_id: "i,k", value}`` documents."""
    v = F.col("v").cast("long") if integer_values else F.col("v")
    return df.select(F.concat_ws(",", F.col("i").cast("string"), F.col("j").cast("string")).alias("_id"),
                     v.alias("value"))


def write_cells(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists",
                integer_values: bool = False) -> None:
    cell_docs(df, integer_values).write.mode(mode).format(fmt).save(path)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write an intermediate as Parquet and continue from the written copy.

    Cuts lineage like a temporary collection between two jobs; a lost
    executor later re-reads files instead of recomputing the whole chain.
    ``path`` must be on a shared file system (see ``session.scratch_path``)."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
