"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every tessella job wants.  AQE re-plans joins and coalesces
# shuffle partitions at run time; its skew join splits oversized partitions
# of hot join keys (explicit salting in ``plans.skew`` is the alternative).
# A sort-merge join becomes a shuffled hash join only when AQE has measured
# every build-side partition below 64 MB, so the hash tables stay bounded.
# A shuffled hash join cannot spill: the bound must fit per-task memory
# (fine from ~1 GB per core; lower it, or set it to 0, for smaller tasks).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "tessella", extra: dict | None = None,
                  local_memory: str = "8g") -> SparkSession:
    """Local or cluster session with the defaults above.  In local mode the
    single JVM is both driver and executor, so its heap (``local_memory``)
    is the executors' memory too; on a cluster size executors as usual."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master.startswith("local"):
        conf["spark.driver.memory"] = local_memory
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared file system folder
    and is used as is.  Only when it is unset (local tests) a private folder
    is created and registered, so ``DataFrame.checkpoint()`` works.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a session without a local SparkContext
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        return d
    d = sc.getCheckpointDir()
    if d:
        return d
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tessella-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder under the shared checkpoint folder, in
    the application's own part of it."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tessella-{spark.sparkContext.applicationId}"


def remove_scratch(spark: SparkSession) -> bool:
    """Deletes what this application wrote to ``scratch_path`` folders; call it
    when no result that reads them is needed any more.  Other applications'
    folders and Spark's own checkpoints stay."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def local_fs_path(path: str) -> str:
    """Strip a ``file:`` scheme for Python-side inspection in tests."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)


def persisted(df):
    """Cache an operand that several plans read, and compute it once now.

    ``MEMORY_AND_DISK`` spills instead of failing, and a lost executor's
    blocks are recomputed from lineage.  Call ``df.unpersist()`` when done.
    """
    from pyspark import StorageLevel

    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.count()
    return df
