"""Operands written once and read by several plans.

``stored`` folds an operand's duplicates and writes it under the shared
checkpoint folder, so that counting it, sizing a grid from it and joining it
do not run what made it again; a lost executor rereads files.  ``HubStore``
goes further for an operand that many jobs join on its inner index: hub keys
are counted on the stored rows, salted by their work, and the rows are written
in buckets of ``(key, salt)``, so every later join takes them as they lie.
"""

from __future__ import annotations

import math
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans import skew
from tessella.session import scratch_path


TASK_BYTES = 16 << 20   # of files or of a shuffle, that a writing task reads


@contextmanager
def small_tasks(df: DataFrame, task_bytes: int | None = None):
    """While it lasts, jobs on ``df`` read ``task_bytes`` a task: files are cut
    at it, and a shuffle has a partition for every half of it in ``df``'s
    files (AQE joins small ones again).  So a task's sorts and hash tables
    do not grow with the tables, whatever ``spark.sql.shuffle.partitions``."""
    spark, task_bytes = df.sparkSession, task_bytes or TASK_BYTES
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    size = 0
    for file in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(file)
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * size / task_bytes))
    wanted = {"spark.sql.shuffle.partitions": str(partitions),
              "spark.sql.files.maxPartitionBytes": str(task_bytes),
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(task_bytes)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield partitions
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, made by small tasks
    and read back."""
    return written_small(df, name)


def written_small(df: DataFrame, name: str, task_bytes: int | None = None) -> DataFrame:
    """Like ``written``, with tasks of ``task_bytes`` (``small_tasks``)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_tasks(df, task_bytes):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, keys: tuple[str, str], value: str, name: str) -> DataFrame:
    """Entries with duplicates summed (map-side first), written once.

    They are written as they come first: an operand that is an aggregate
    itself would else be summed again in the tasks that make it, with three
    tables of all their groups in memory at a time."""
    plain = written(df.select(*keys, value), f"{name}-entries")
    return written(plain.groupBy(*keys).agg(F.sum(value).alias(value)), name)


@dataclass(frozen=True)
class HubStore:
    """Rows of an operand in buckets of ``(key, salt)``; ``hubs(key, _n)``
    tells how many salts the rows of a hub key have (others: one)."""

    rows: DataFrame
    hubs: DataFrame
    key: str
    buckets: int

    def join(self, other: DataFrame) -> DataFrame:
        """Inner equi-join with a smaller operand.  Its rows of a hub key are
        copied to every salt; the stored side is read bucket by bucket and
        not exchanged."""
        n = F.coalesce("_n", F.lit(1))
        right = (other.join(self.hubs, self.key, "left")
                 .withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_n"))
        return self.rows.join(right.hint("merge"), [self.key, "_salt"]).drop("_salt")


def hub_store(df: DataFrame, key: str, spread: str, *, rows_per_task: int | None = None,
              buckets: int | None = None) -> HubStore:
    """Writes ``df`` bucketed by ``key`` and the salt of ``spread``.

    What made ``df`` runs once: the rows are written plainly first, hubs are
    counted on them, and the buckets are dealt from the files.
    """
    spark = df.sparkSession
    rows_per_task = rows_per_task or skew.DEFAULT_ROWS_PER_TASK
    plain = written(df, "operand")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hubs = written(skew.hot_keys(plain, key, rows_per_task, name="_n"), "hubs")
    salted = (plain.join(hubs, key, "left")
              .withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n"))
    table = f"operand_{uuid.uuid4().hex}"
    (salted.repartition(buckets, key, "_salt").write.bucketBy(buckets, key, "_salt").sortBy(key, "_salt")
     .option("path", scratch_path(spark, "operand-buckets")).format("parquet").saveAsTable(table))
    return HubStore(spark.table(table), hubs, key, buckets)
