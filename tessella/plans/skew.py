"""Hot-key splitting for joins.

A single join key (a hub vertex, a popular order) may hold a large share of
all rows.  Shuffling by that key alone would hand the whole group to one
task, whose work is the *product* of the key's rows on both sides: AQE's skew
join looks at bytes and does not see it.  ``split_join`` finds keys with more
than ``rows_per_task`` rows on a side or more than ``PAIRS_PER_TASK`` pairs
(one count per key over both sides, combined map-side, so the shuffle is one
row per key and map task; it is part of the join's own plan), and spreads each
over an ``sa x sb`` grid:

* left rows of a hot key get a salt ``a`` in ``[0, sa)`` from a hash of the
  row and are copied to every ``b`` in ``[0, sb)``;
* right rows get ``b`` from their own hash and are copied to every ``a``.

Joining on ``(key, a, b)`` then pairs every left row with every right row of
the key exactly once, in ``sa * sb`` tasks of bounded size.  Cold keys keep
``a = b = 0`` and are joined as usual.  The cuts are looked up by hash bucket
of the key in a table of at most ``GRID_BUCKETS`` rows, which is broadcast; a
table of hot keys counted beforehand (``hot_grid``) is broadcast only at no
more than ``MAX_HOT_KEYS`` rows and else joined by a shuffle.  The caller's
thresholds stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.plans.guards import MAX_HOT_KEYS

# Rows of one key that a single task is allowed to take before the key is
# split.  Large enough that test-scale data never splits unless asked to.
DEFAULT_ROWS_PER_TASK = 1_000_000
# Pairs of one key that a single task is allowed to make.
PAIRS_PER_TASK = 50_000_000
# Hash buckets of keys that share a row of the broadcast grid table.
GRID_BUCKETS = 1 << 20
# ``None`` makes no count and leaves hot keys to Spark's adaptive skew join,
# which splits partitions by bytes: enough where one side has one row a key.
JOIN_ROWS_PER_TASK: int | None = None
# Cells one collected tile may hold when a strategy sizes its own tiles
# (``mm_block_fixed_k``).  Grouped collections cannot be split by AQE, so
# every collected group in this package has a bound like this one.
LIST_ROWS = 1_000_000


def _keys(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def hot_keys(df: DataFrame, on: str | Sequence[str], rows_per_task: int,
             name: str = "splits") -> DataFrame:
    """Keys with more than ``rows_per_task`` rows and their split count."""
    keys = _keys(on)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
              .where(F.col("_n") > rows_per_task)
              .select(*keys, F.ceil(F.col("_n") / F.lit(rows_per_task)).cast("int").alias(name)))


def _counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key on both sides (``_l``, ``_r``), combined map-side.

    Rows are counted by their last column, the value: an operand that is
    itself an aggregate then has the same exchange here as in the join, and
    the planner runs it once.  Null values, which make no products, do not
    count."""
    def ones(df: DataFrame) -> Column:
        return F.when(F.col(df.columns[-1]).isNotNull(), 1).otherwise(0)

    sides = (left.select(*keys, ones(left).alias("_l"), F.lit(0).alias("_r"))
             .unionAll(right.select(*keys, F.lit(0).alias("_l"), ones(right).alias("_r"))))
    return sides.groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))


def _cuts(counts: DataFrame, rows: int, pairs: int) -> DataFrame:
    """The keys of ``counts`` that are hot, with their cuts ``_sa``, ``_sb``."""
    a = F.greatest(F.ceil(F.col("_l") / rows), F.lit(1))
    b = F.greatest(F.ceil(F.col("_r") / rows), F.lit(1))
    # a grid cell of too many pairs is cut alike on both sides; a side with
    # too few rows for its share leaves the rest of the cut to the other
    more = F.greatest(F.col("_l").cast("double") * F.col("_r") / (F.col("_sa") * F.col("_sb") * pairs), F.lit(1.0))
    cut_b = F.least(F.ceil(F.col("_sb") * F.sqrt("_more")), F.greatest("_r", F.lit(1)))
    cut_a = F.least(F.ceil(F.col("_sa") * F.col("_more") * F.col("_sb") / F.col("_tb")), F.greatest("_l", F.lit(1)))
    last_b = F.greatest("_tb", F.least(F.ceil(F.col("_sb") * F.col("_more") * F.col("_sa") / F.col("_ta")),
                                       F.greatest("_r", F.lit(1))))
    return (counts.where((F.col("_l") > rows) | (F.col("_r") > rows)
                         | (F.col("_l").cast("double") * F.col("_r") > pairs))
            .withColumn("_sa", a).withColumn("_sb", b).withColumn("_more", more)
            .withColumn("_tb", cut_b).withColumn("_ta", F.greatest("_sa", cut_a))
            .withColumn("_sb", last_b.cast("int")).withColumn("_sa", F.col("_ta").cast("int")))


def _limits(rows_per_task: int, pairs_per_task: int | None) -> tuple[int, int]:
    pairs = PAIRS_PER_TASK if pairs_per_task is None else pairs_per_task
    return max(int(rows_per_task), 1), max(int(pairs), 1)


def hot_grid(left: DataFrame, right: DataFrame, on: str | Sequence[str],
             rows_per_task: int = DEFAULT_ROWS_PER_TASK,
             pairs_per_task: int | None = None) -> DataFrame | None:
    """``(key.., _sa, _sb)`` for keys hot on either side or in their pairs,
    or ``None`` if there are none; broadcast-hinted if at most
    ``MAX_HOT_KEYS`` rows.  Counted now, for several plans to share."""
    from tessella.session import checkpoint_dir

    checkpoint_dir(left.sparkSession)
    keys = _keys(on)
    # written once (hot keys only), so the main plans read this small table
    # instead of counting both inputs again
    grid = (_cuts(_counts(left, right, keys), *_limits(rows_per_task, pairs_per_task))
            .select(*keys, "_sa", "_sb").checkpoint(eager=True))
    n = grid.count()
    if n == 0:
        return None
    return F.broadcast(grid) if n <= MAX_HOT_KEYS else grid


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(GRID_BUCKETS)).alias("_bucket")


def bucket_grid(left: DataFrame, right: DataFrame, on: str | Sequence[str],
                rows_per_task: int = DEFAULT_ROWS_PER_TASK,
                pairs_per_task: int | None = None) -> DataFrame:
    """``(_bucket, _sa, _sb)`` of the hash buckets that hold a hot key, with
    the widest cut among them: part of the plan it is joined in, no job of
    its own.

    ``GRID_BUCKETS`` bounds its rows, so it may be broadcast whatever the
    data.  Without hot keys it is empty, which the adaptive planner learns
    before it starts the join and drops the lookup.  Cold keys that share a
    bucket with a hot one are spread as well, which costs copies, not cells.
    """
    keys = _keys(on)
    hot = _cuts(_counts(left, right, keys), *_limits(rows_per_task, pairs_per_task))
    return F.broadcast(hot.groupBy(_bucket(keys)).agg(F.max("_sa").alias("_sa"), F.max("_sb").alias("_sb")))


def _row_hash(cols: Sequence[str | Column]) -> Column:
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols])


def spread(left: DataFrame, right: DataFrame, on: str | Sequence[str],
           left_spread: Sequence[str], right_spread: Sequence[str],
           rows_per_task: int = DEFAULT_ROWS_PER_TASK, grid: DataFrame | None = None,
           pairs_per_task: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with the place ``(_a, _b)`` of their rows in the salt grid
    of their key, copied as the grid asks for; ``(0, 0)`` for cold keys."""
    keys = _keys(on)
    lcols, rcols = left.columns, right.columns
    by = keys
    if grid is None:
        grid = bucket_grid(left, right, keys, rows_per_task, pairs_per_task)
        left, right, by = left.withColumn("_bucket", _bucket(keys)), right.withColumn("_bucket", _bucket(keys)), ["_bucket"]

    def placed(df, cols, mine, n, other, m, columns):
        return (df.join(grid, by, "left")
                .withColumn(mine, F.pmod(_row_hash(columns), F.coalesce(n, F.lit(1))).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(m, F.lit(1)) - 1)))
                .select(*cols, "_a", "_b"))

    return (placed(left, lcols, "_a", "_sa", "_b", "_sb", left_spread),
            placed(right, rcols, "_b", "_sb", "_a", "_sa", right_spread))


def split_join(left: DataFrame, right: DataFrame, on: str | Sequence[str],
               left_spread: Sequence[str], right_spread: Sequence[str],
               rows_per_task: int | None = JOIN_ROWS_PER_TASK,
               grid: DataFrame | None = None) -> DataFrame:
    """Inner equi-join on ``on`` with hot keys spread over a salt grid.

    ``left_spread`` / ``right_spread`` name columns that vary inside a key
    (the other matrix index), hashed to place rows in the grid.  With
    ``rows_per_task=None`` (default) keys are not counted and AQE's
    skew-join splits hot partitions; a row count salts keys above it or above
    ``PAIRS_PER_TASK``, and a precomputed ``grid`` (from ``hot_grid``) shares
    one count.
    """
    keys = _keys(on)
    if grid is None and rows_per_task is None:
        return left.join(right, keys)
    lg, rg = spread(left, right, keys, left_spread, right_spread, rows_per_task or DEFAULT_ROWS_PER_TASK, grid)
    return lg.join(rg, keys + ["_a", "_b"]).drop("_a", "_b")
