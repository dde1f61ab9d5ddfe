"""Layout conversions: packed rows / columns, blocks, dense rows and columns.

Every packed group has a proven size bound: rows are cut into segments of
``width`` consecutive column ids (at most ``width`` entries once duplicates
are summed) and blocks hold at most ``mb * kb`` entries.  Duplicates are
summed by an aggregation with a map-side partial sum before any group is
collected, so neither a row holding a third of the matrix nor a cell repeated
a third of the time lands whole in one task or one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import idiv

from tessella.functions.arrays import densify
from tessella.operators.entries import transpose
from tessella.plans.guards import MAX_BROADCAST_ROWS, rows_at_most
from tessella.plans.store import written, written_small

DEFAULT_SEGMENT = 1 << 16
MAX_DENSE_WIDTH = 1 << 14


def pack_rows(df: DataFrame, width: int = DEFAULT_SEGMENT) -> DataFrame:
    """Entries -> sorted sparse row segments ``(i, seg, idx, val)``.

    ``seg = j div width``.  Duplicates are summed first, with a map-side
    partial sum, so even a cell repeated a huge number of times is combined
    before any shuffle; the collection then sees at most ``width`` entries
    per segment.  Entries, sums and segments are written one after the other
    by tasks of bounded size (``store.written``): none holds the tables of two
    steps, and none grows with the entries.
    """
    plain = written(df.select("i", "j", "v"), "pack")
    e = (written_small(plain.groupBy("i", "j").agg(F.sum("v").alias("v")), "pack-sums")
           .withColumn("seg", idiv("j", width)))
    packed = e.groupBy("i", "seg").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("e"))
    return written_small(packed.select("i", "seg", F.col("e.j").alias("idx"), F.col("e.v").alias("val")), "packed")


def pack_columns(df: DataFrame, width: int = DEFAULT_SEGMENT) -> DataFrame:
    """Entries -> sorted sparse column segments ``(j, seg, idx, val)`` where
    ``idx`` holds row ids."""
    return pack_rows(transpose(df), width).withColumnRenamed("i", "j")


def unpack_rows(packed: DataFrame, key: str = "i", inner: str = "j") -> DataFrame:
    """Packed segments -> entries."""
    z = packed.select(key, F.explode(F.arrays_zip("idx", "val")).alias("z"))
    return z.select(F.col(key).alias("i" if key == "i" else key),
                    F.col("z.idx").alias(inner), F.col("z.val").alias("v"))


def render_packed(packed: DataFrame) -> DataFrame:
    """Printable segment: ``'j:v,j:v,..'`` with integer values."""
    return packed.withColumn("entries", F.array_join(F.transform(
        F.arrays_zip("idx", "val"),
        lambda z: F.concat(z["idx"].cast("string"), F.lit(":"), z["val"].cast("long").cast("string"))), ","))


def to_blocks(df: DataFrame, mb: int, kb: int) -> DataFrame:
    """Entries -> blocks ``(bi, bj, i, j, v arrays)`` of at most ``mb x kb``
    cells; duplicate entries are summed (as block conversion does)."""
    e = (df.select("i", "j", "v")
           .withColumn("bi", idiv("i", mb))
           .withColumn("bj", idiv("j", kb))
           .groupBy("bi", "bj", "i", "j").agg(F.sum("v").alias("v")))
    b = e.groupBy("bi", "bj").agg(F.collect_list(F.struct("i", "j", "v")).alias("e"))
    return b.select("bi", "bj", F.col("e.i").alias("ei"), F.col("e.j").alias("ej"),
                    F.col("e.v").alias("ev"))


def from_blocks(blocks: DataFrame) -> DataFrame:
    z = blocks.select(F.explode(F.arrays_zip("ei", "ej", "ev")).alias("z"))
    return z.select(F.col("z.ei").alias("i"), F.col("z.ej").alias("j"), F.col("z.ev").alias("v"))


def block_stats(df: DataFrame, mb: int, kb: int) -> DataFrame:
    """Per block: stored entries and value sum (block directory)."""
    return (df.groupBy(idiv("i", mb).alias("bi"),
                       idiv("j", kb).alias("bj"))
              .agg(F.count(F.lit(1)).alias("nnz"), F.sum("v").alias("total")))


def dense_rows(df: DataFrame, n: int, keys: tuple[str, ...] = ("i",)) -> DataFrame:
    """Entries -> ``(keys.., vals)`` with ``vals`` a dense ``array<double>``
    of length ``n`` over column ``j`` (columns outside ``0..n-1`` are left
    out).  Duplicates are summed with a map-side partial sum first; each
    list is then bounded by ``n``."""
    if n > MAX_DENSE_WIDTH:
        raise ValueError(f"dense width {n} exceeds {MAX_DENSE_WIDTH}; use a sparse strategy")
    keys = list(keys)
    e = (df.where((F.col("j") >= 0) & (F.col("j") < n))
           .groupBy(*keys, "j").agg(F.sum("v").alias("v"))
           .groupBy(*keys).agg(F.collect_list(F.struct("j", "v")).alias("e")))
    return e.select(*keys, densify(F.col("e.j"), F.col("e.v"), F.lit(n)).alias("vals"))


def dense_column(spark: SparkSession, column: DataFrame, k: int,
                 max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """One column ``(i, v)`` -> dense vector ``(i, v)`` for every ``i`` in
    ``0..k-1``, zeros filled in.  The index range is generated distributed
    (``spark.range``); the column joins it by broadcast only when small."""
    col = column.groupBy("i").agg(F.sum("v").alias("_v"))
    if rows_at_most(col, max_broadcast_rows):
        col = F.broadcast(col)
    rng = spark.range(k).select(F.col("id").alias("i"))
    return rng.join(col, "i", "left").select("i", F.coalesce("_v", F.lit(0.0)).alias("v"))
