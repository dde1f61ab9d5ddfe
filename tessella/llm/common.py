"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import checkpoint_dir, scratch_path

# Whitespace of every "word" in this subpackage: space and U+0009..U+000D,
# which is also what ``bytes.split()`` cuts at.  [fixed values]
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(spark: SparkSession, df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back:
    later plans start from files that survive the loss of any executor.
    Python workers are sent at most ``batch`` rows at a time, if given: both
    sides hold whole batches, which counts where rows are long."""
    path, before = scratch_path(spark, name), spark.conf.get(BATCH, None)
    if batch:
        spark.conf.set(BATCH, str(batch))
    try:
        df.write.parquet(path)
    finally:
        if batch:
            spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_path = path
    return back


def bucketed(spark: SparkSession, df: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """``df`` as a table in the shared folder, in as many buckets of ``keys``
    as there are shuffle partitions: joins on the keys take its rows as they
    lie, however often it is joined."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    (df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys)
     .option("path", path).saveAsTable(table))
    drop_shuffles(spark)
    back = spark.table(table)
    back.written_path, back.table_name = path, table
    return back


def drop_shuffles(spark: SparkSession) -> None:
    """Lets the shuffle files of finished jobs go: Spark drops them when the
    driver's garbage is collected, which else may be hours away."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, table: DataFrame) -> None:
    """Deletes the files of a ``written`` or ``bucketed`` table.  Only for a
    table whose last reader has itself been written: nothing can ask for it
    again.  The shuffle files of the jobs that made it go, too."""
    if name := table.__dict__.get("table_name"):
        spark.sql(f"drop table if exists {name}")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(table.written_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    drop_shuffles(spark)


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage through the shared folder."""
    checkpoint_dir(spark)
    return df.checkpoint()


def words_column(text):
    """Words of a text as an array column, without a Python worker.

    The words are maximal runs outside ``WORD_GAP``; a null or blank text
    gives an empty array.
    """
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def lower_ascii(text):
    """Lower-case A-Z only, leaving every other code point as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(col="text"):
    """A text column as UTF-8 bytes, null as empty: workers split bytes."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def worker_cache(name: str, make):
    """An object built once per Python worker process and reused by the
    tasks it runs (compiled tables, word memos).  One at a time: a job with
    another one frees the last one's memory."""
    store = sys.__dict__.setdefault("_tessella_worker_cache", {})
    if name not in store:
        worker_release()
        store[name] = make()
    return store[name]


def worker_release() -> None:
    """Frees what earlier jobs kept in this worker process; tasks that keep
    nothing themselves call it first."""
    store = sys.__dict__.get("_tessella_worker_cache")
    if store:
        store.clear()
        gc.collect()
    worker_trim()


def worker_trim() -> None:
    """Gives memory that earlier tasks of this process have freed back to the
    system: Arrow's pool and, where the C library can, the heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_slices(batch, column: int, rows: int = 128, size: int = 1 << 20):
    """Slices of an Arrow batch of at most ``rows`` rows and, unless a single
    text is longer, ``size`` bytes of its texts, so that what is made of a
    slice stays small where long texts come together."""
    lengths = [0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()]
    lo = 0
    while lo < len(lengths):
        hi, total = lo + 1, lengths[lo]
        while hi < len(lengths) and hi - lo < rows and total + lengths[hi] <= size:
            total += lengths[hi]
            hi += 1
        yield batch.slice(lo, hi - lo)
        lo = hi


class Memo:
    """A bounded memo in two generations: when the young one holds half of
    ``size`` entries it becomes the old one, and what is asked for again
    moves back, so half of the entries go at a time, the unused half."""

    def __init__(self, size: int):
        self.half = max(size // 2, 1)
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = value


def id_bounds(ids: DataFrame, n: int) -> list[int]:
    """At most ``n - 1`` values of ``doc_id`` that cut the rows into ``n``
    ranges of about equal size; reads the id column only.  All are above the
    smallest id, so no range is empty."""
    if n <= 1:
        return []
    share = ", ".join(repr(k / n) for k in range(1, n))
    got = ids.select(F.expr(f"percentile_approx(doc_id, array({share}), {max(10_000, 20 * n)})").alias("q"), F.min("doc_id").alias("least")).first()
    return sorted({q for q in got["q"] or [] if q > got["least"]})


def range_of(bounds: list[int]):
    """Number of bounds <= ``doc_id``, by binary search; 0 for a null id."""
    if not bounds:
        return F.lit(0)
    table = "array(" + ", ".join(f"{b}L" for b in bounds) + ")"
    steps = ", ".join(str(1 << k) for k in reversed(range(len(bounds).bit_length())))
    return F.expr(f"""if(doc_id is null, 0, aggregate(array({steps}), 0, (at, step) ->
        if(at + step <= {len(bounds)}, if(get({table}, at + step - 1) <= doc_id, at + step, at), at)))""")
