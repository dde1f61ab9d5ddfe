"""Delimited text triples, tagged triples, edge and vertex lists.

Readers take a line's first fields as text and cast them to fixed types (no
inference: a file of integer values is read as DOUBLE values); a bad line is
an error unless the caller asks to drop it.
Paths are Hadoop file-system URIs, so local, HDFS and object stores work the
same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _min_partitions(df: DataFrame, partitions: int | None) -> DataFrame:
    """``partitions`` partitions, if asked for.  Without a shuffle, splits are
    made finer by ``spark.sql.files.maxPartitionBytes``."""
    if not partitions:
        return df
    return df.repartition(partitions)


def _fields(spark: SparkSession, path: str, sep: str, names: list[str], header: bool = False) -> DataFrame:
    """The first fields of every line as trimmed text; further fields (also
    the empty one after a trailing separator) are ignored, missing ones null."""
    schema = T.StructType([T.StructField(n, T.StringType(), True) for n in names])
    raw = (spark.read.schema(schema).option("sep", sep).option("header", str(header).lower())
           .option("quote", "").option("mode", "PERMISSIVE").csv(path))
    folders = [c for c in raw.columns if c not in names]      # partition columns
    return raw.select(*[F.trim(F.col(n)).alias(n) for n in names], *folders)


def _typed(raw: DataFrame, types: dict[str, str], optional: dict, on_bad: str) -> DataFrame:
    """Casts the named fields.  A field that is absent takes its value from
    ``optional`` if it has one there; absent or unparsable otherwise, the
    line is bad: ``on_bad='error'`` fails inside the job and names the line,
    ``'drop'`` leaves it out."""
    if on_bad not in ("error", "drop"):
        raise ValueError(f"on_bad must be 'error' or 'drop', not {on_bad!r}")
    cast = {n: F.col(n).try_cast(t) for n, t in types.items()}
    good = F.lit(True)
    for n in types:
        absent = F.col(n).isNull() | (F.col(n) == "")
        good = good & (cast[n].isNotNull() if n not in optional else absent | cast[n].isNotNull())
    if on_bad == "error":
        said = F.concat(F.lit("bad line: "), F.concat_ws(" ", *[F.coalesce(F.col(n), F.lit("<none>")) for n in raw.columns]))
        good = F.when(good, True).otherwise(F.raise_error(said).cast("boolean"))
    rest = [c for c in raw.columns if c not in types]
    return raw.where(good).select(*[
        F.coalesce(cast[n], F.lit(optional[n])).alias(n) if n in optional else cast[n].alias(n) for n in types], *rest)


def read_coo(spark: SparkSession, path: str, sep: str = " ", header: bool = False,
             partitions: int | None = None, on_bad: str = "error") -> DataFrame:
    """``row col value`` lines -> entries.  ``header=True`` skips each file's
    first line.  Only the first three fields count; a line without three
    parsable ones is an error, or left out with ``on_bad='drop'``."""
    df = _typed(_fields(spark, path, sep, ["i", "j", "v"], header),
                {"i": "long", "j": "long", "v": "double"}, {}, on_bad)
    return _min_partitions(df, partitions)


def triple_line(sep: str = " ", integer_values: bool = False):
    v = F.col("v").cast("long") if integer_values else F.col("v")
    return F.concat_ws(sep, F.col("i").cast("string"), F.col("j").cast("string"), v.cast("string"))


def format_triples(df: DataFrame, sep: str = " ", integer_values: bool = False) -> DataFrame:
    """Entries -> one text column ``line``: ``i<sep>j<sep>v``."""
    return df.select(triple_line(sep, integer_values).alias("line"))


def write_coo(df: DataFrame, path: str, sep: str = " ", by: str | None = None,
              header: str | None = None, mode: str = "errorifexists",
              integer_values: bool = False, rows_per_file: int | None = None) -> None:
    """Entries -> text triples, one ``i j v`` line each (``sep=','`` for
    comma triples).  ``by`` writes one sub-folder per value of that column
    (per result column or column group); rows are brought together by it
    first, and the adaptive planner cuts a value that is too large for a task
    by its measured size and joins small ones, so there are about as many
    files as values.  ``rows_per_file`` bounds a file.  ``header`` (e.g.
    ``'m k v'``) writes that first line through the CSV writer instead."""
    if header is not None:
        names = header.split(" ")
        out = df.select(F.col("i").alias(names[0]), F.col("j").alias(names[1]),
                        (F.col("v").cast("long") if integer_values else F.col("v")).alias(names[2]))
        out.write.mode(mode).option("sep", sep).option("header", "true").csv(path)
        return
    lines = df.select(triple_line(sep, integer_values).alias("line"), *([F.col(by)] if by else []))
    if by:
        lines = lines.hint("rebalance", by)
    w = lines.write.mode(mode)
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    if by:
        w = w.partitionBy(by)
    w.text(path)


def read_tagged(spark: SparkSession, path: str, on_bad: str = "error") -> tuple[DataFrame, DataFrame]:
    """``M,i,j,v`` / ``N,j,k,v`` lines in one folder -> ``(left, right)``.
    Any tag other than ``M`` belongs to the right operand."""
    raw = _typed(_fields(spark, path, ",", ["tag", "a", "b", "v"]),
                 {"a": "long", "b": "long", "v": "double"}, {}, on_bad)
    left = raw.where(F.col("tag") == "M").select(F.col("a").alias("i"), F.col("b").alias("j"), "v")
    right = raw.where(~(F.col("tag") == "M") | F.col("tag").isNull()).select(
        F.col("a").alias("i"), F.col("b").alias("j"), "v")
    return left, right


def tagged_lines(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both operands as tagged comma lines (column ``line``)."""
    def fmt(df, tag):
        return df.select(F.concat_ws(",", F.lit(tag), F.col("i").cast("string"),
                                     F.col("j").cast("string"), F.col("v").cast("string")).alias("line"))
    return fmt(left, "M").unionByName(fmt(right, "N"))


def write_tagged(left: DataFrame, right: DataFrame, path: str, mode: str = "errorifexists") -> None:
    tagged_lines(left, right).write.mode(mode).text(path)


def read_edges(spark: SparkSession, path: str, sep: str = " ", on_bad: str = "error") -> DataFrame:
    """``src dst [weight]`` lines; an absent weight is 1, an unparsable one
    makes the line bad."""
    return _typed(_fields(spark, path, sep, ["src", "dst", "w"]),
                  {"src": "long", "dst": "long", "w": "double"}, {"w": 1.0}, on_bad)


def write_edges(edges: DataFrame, path: str, sep: str = " ", weighted: bool = True,
                mode: str = "errorifexists") -> None:
    cols = [F.col("src").cast("string"), F.col("dst").cast("string")]
    if weighted:
        cols.append(F.col("w").cast("string"))
    edges.select(F.concat_ws(sep, *cols).alias("line")).write.mode(mode).text(path)


def read_vertices(spark: SparkSession, path: str, on_bad: str = "error") -> DataFrame:
    """One vertex id per line."""
    return _typed(_fields(spark, path, " ", ["id"]), {"id": "long"}, {}, on_bad)


def write_vertices(vertices: DataFrame, path: str, mode: str = "errorifexists") -> None:
    vertices.select(F.col("id").cast("string").alias("line")).write.mode(mode).text(path)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """BFS source lines ``vertex column 1.0`` -> ``(vertex, col)``."""
    return read_coo(spark, path).select(F.col("i").alias("vertex"), F.col("j").alias("col"))
