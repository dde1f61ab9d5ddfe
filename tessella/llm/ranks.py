"""Positions inside groups without a window over a whole group.

The rows are sorted over the cluster by group and order (range partitions, so
a group with a third of all rows spans many tasks) and written once; a row's
position is its place in its partition plus the rows that the earlier
partitions hold of its group.  Only that small table, one row per group and
partition, is summed by a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import written


def ranked(spark: SparkSession, rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` and ``idx``, the position from 0 in its group by ``order``
    (nulls first), and ``n``, the group's rows.

    ``group`` is never null.  ``order`` should tell all rows apart where the
    result must not depend on the partitions; rows that it does not tell
    apart, however many, need a last column that spreads them.
    """
    assert not {"__at", "__part", "__first", "__before"} & set(rows.columns)
    placed = written(spark, rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                     .withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33).alias("__part")     # partition id: the upper 31 bits
    up = Window.partitionBy(group).orderBy("__part")
    starts = (placed.groupBy(group, part).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
              .select(group, "__part", "__first",
                      (F.sum("__n").over(up) - F.col("__n")).alias("__before"),
                      F.sum("__n").over(Window.partitionBy(group)).alias("n")))
    return (placed.withColumn("__part", part).join(starts, [group, "__part"])
            .select(*rows.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("idx"), "n"))


def running(rows: DataFrame, key: str, at: str, cols: list[str], stretch: int = 4096,
            descending: bool = False) -> DataFrame:
    """``rows`` and, per column of ``cols``, ``before_<col>``: its sum over
    the key's rows of smaller ``at`` (larger, if ``descending``).

    ``(key, at)`` tells all rows apart.  Sums go in two levels, inside
    stretches of ``at`` and over the stretches, so the longest key costs a
    window of its rows divided by ``stretch``.
    """
    def ordered(col):
        return F.col(col).desc() if descending else F.col(col).asc()

    def sums(table, keys, col, names):
        w = Window.partitionBy(*keys).orderBy(ordered(col)).rowsBetween(Window.unboundedPreceding, -1)
        return table.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for c, n in names])

    cut = rows.withColumn("__s", F.floor(F.col(at) / stretch))
    inner = sums(cut, [key, "__s"], at, [(c, f"__in_{c}") for c in cols])
    outer = sums(cut.groupBy(key, "__s").agg(*[F.sum(c).alias(f"__t_{c}") for c in cols]),
                 [key], "__s", [(f"__t_{c}", f"__out_{c}") for c in cols])
    return inner.join(outer, [key, "__s"]).select(
        *rows.columns, *[(F.col(f"__in_{c}") + F.col(f"__out_{c}")).alias(f"before_{c}") for c in cols])
