"""Matrix product strategies.

Every strategy takes ``left (i, j, v)`` and ``right (i, j, v)`` (the right
operand's ``i`` is the contraction index) and returns ``(i, j, v)`` of
``left x right``.  They differ in physical plan, mirroring the strategies the
reference compares; all return the same cells once zero handling is fixed
(``drop_zeros``).  Duplicated input entries are summed (linear, so a product
of un-deduplicated operands is still right).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import idiv
from tessella.functions.arrays import Csr
from tessella.plans import skew
from tessella.plans.batches import CELLS, broadcast_rows, entry_cell, tile_cell
from tessella.plans.guards import MAX_BROADCAST_ROWS, rows_at_most
from tessella.plans.skew import DEFAULT_ROWS_PER_TASK, LIST_ROWS, split_join, spread
from tessella.plans.store import TASK_BYTES, HubStore, hub_store, stored, written, written_small


def _lr(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rename to ``l(i, c, v)`` and ``r(c, k, w)`` with ``c`` the inner index."""
    l = left.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("c"),
                    F.col("v").cast("double").alias("v"))
    r = right.select(F.col("i").cast("long").alias("c"), F.col("j").cast("long").alias("k"),
                     F.col("v").cast("double").alias("w"))
    return l, r


def _cells(pairs: DataFrame, drop_zeros: bool) -> DataFrame:
    """Sum partial products by output cell (partial aggregation map-side)."""
    out = pairs.groupBy("i", "k").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    if drop_zeros:
        out = out.where(F.col("v") != 0)
    return out.select("i", F.col("k").alias("j"), "v")


# --------------------------------------------------------------------- X1
def mm_outer(left: DataFrame, right: DataFrame, *, partitions: int | None = None,
             drop_zeros: bool = False, rows_per_task: int | None = DEFAULT_ROWS_PER_TASK) -> DataFrame:
    """Outer-product strategy: join on the inner index, multiply, sum by cell.

    Plan: Exchange(c) on both sides -> equi-join (sort-merge; AQE turns it
    into a shuffled hash or broadcast join when measured sizes allow) ->
    partial HashAggregate (i, k) in the same stage -> Exchange(i, k) -> final
    HashAggregate.  An operand already hash-partitioned on its inner index is
    not shuffled again.  ``partitions`` fixes the
    join parallelism explicitly (both sides hash-partitioned on ``c`` with
    that count, which the join then reuses); such pre-partitioned sides are
    not re-split by AQE.  The work of an inner index is the product of its
    rows on both sides, so the plan counts both and spreads a hot index over
    a salt grid (``plans.skew``); ``rows_per_task=None`` leaves it to AQE.
    Nothing runs while the plan is built.  Cancelled sums are kept as 0.0
    unless ``drop_zeros``.
    """
    l, r = _lr(left, right)
    if partitions:
        l = l.repartition(partitions, "c")
        r = r.repartition(partitions, "c")
    pairs = split_join(l, r, "c", ["i", "v"], ["k", "w"], rows_per_task=rows_per_task)
    return _cells(pairs, drop_zeros)


# --------------------------------------------------------------------- X3
def mm_inner_broadcast(left: DataFrame, right: DataFrame, *, drop_zeros: bool = True,
                       max_broadcast_rows: int = MAX_BROADCAST_ROWS,
                       rows_per_task: int | None = DEFAULT_ROWS_PER_TASK) -> DataFrame:
    """Broadcast strategy: the right operand is shipped whole to every task.

    Only after a count proves ``right`` has at most ``max_broadcast_rows``
    entries; otherwise the plan falls back to ``mm_outer``'s shuffle join.
    The broadcast hash join keeps the left side where it is (no shuffle of
    the large operand); the only exchange is the partially aggregated
    ``(i, k)`` cells, which also spreads a heavy row over many tasks.
    """
    l, r = _lr(left, right)
    if not rows_at_most(r, max_broadcast_rows):
        return mm_outer(left, right, drop_zeros=drop_zeros, rows_per_task=rows_per_task)
    pairs = l.join(F.broadcast(r), "c")
    return _cells(pairs, drop_zeros)


def mm(left: DataFrame, right: DataFrame, strategy: str = "outer", **kw) -> DataFrame:
    """Dispatch by strategy name (``outer``, ``inner_broadcast``, ...)."""
    fn = STRATEGIES[strategy]
    return fn(left, right, **kw)


STRATEGIES = {
    "outer": mm_outer,
    "inner_broadcast": mm_inner_broadcast,
}


# --------------------------------------------------------------------- X2
CELL_ENTRIES = 1 << 19      # entries of both operands that a grid cell is sized for


def _parts_for(left: DataFrame, right: DataFrame, entries: int) -> int:
    """Hash parts of the inner index: enough for ``entries`` a part and for
    every shuffle partition to have one.  Counts stored tables."""
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(tasks, math.ceil((left.count() + right.count()) / entries))


def mm_inner_cartesian(left: DataFrame, right: DataFrame, *, width: int | None = None,
                       drop_zeros: bool = False, entries_per_cell: int = CELL_ENTRIES,
                       rows_per_task: int | None = None) -> DataFrame:
    """Inner-product strategy: packed rows dotted with packed columns.

    The reference pairs every packed row with every packed column (a
    cartesian product) and drops pairs with no shared index.  Here a grid of
    row groups x inner segments x column groups takes its place.  The inner
    index is cut into hash parts sized for ``entries_per_cell`` (and into
    ranges of ``width``, if given); within a part all rows and all columns
    are one group, except at an inner index so frequent that its rows and
    columns are dealt to a grid of groups of their own (``plans.skew``).  So
    both operands are stored once, and an entry travels to one cell (the
    entries of a hot index to a row or column of cells).  In a cell the row
    segments and column segments are laid out flat, merged on the inner index
    and summed by pair in slices: one call per cell, and only pairs that
    share an index are formed.  Dots of segments add up over the parts.

    Same cells as the cartesian form: sums that cancel stay as 0.0, pairs
    with an empty intersection never appear.  The cells are written by tasks
    of bounded size (``store.small_tasks``).
    """
    l, r = _lr(left, right)
    l, r = stored(l, ("i", "c"), "v", "inner-rows"), stored(r, ("c", "k"), "w", "inner-columns")
    parts = _parts_for(l, r, entries_per_cell)
    lg, rg = spread(l, r, "c", ["i"], ["k"], rows_per_task or entries_per_cell)
    part = F.pmod(F.xxhash64("c"), F.lit(parts)).alias("part")
    segment = (idiv("c", width) if width else F.lit(0).cast("long")).alias("seg")
    cells = (lg.select(part, segment, "_a", "_b", F.lit(0).alias("side"), F.col("i").alias("x"), "c", "v")
             .unionAll(rg.select(part, segment, "_a", "_b", F.lit(1).alias("side"), F.col("k").alias("x"), "c", "w")))
    dots = cells.groupBy("part", "seg", "_a", "_b").applyInArrow(entry_cell, CELLS)
    # a grid cell is sorted whole: a task gets one or two of them
    return written_small(_summed(dots, drop_zeros), "inner-cells", TASK_BYTES // 4)


def _summed(cells: DataFrame, drop_zeros: bool) -> DataFrame:
    out = cells.groupBy("i", "k").agg(F.sum("v").alias("v"))
    if drop_zeros:
        out = out.where(F.col("v") != 0)
    return out.select("i", F.col("k").alias("j"), "v")


# --------------------------------------------------------------------- X4
def _shares(n_left: int, n_right: int, cells: int, m: int | None, p: int | None) -> tuple[int, int]:
    """Shares ``(g, h)`` with about ``cells`` cells that copy the fewest rows,
    ``h * n_left + g * n_right``."""
    best = math.sqrt(cells * max(n_left, 1) / max(n_right, 1))
    g = max(1, min(round(best), cells, m or cells))
    h = max(1, min(-(-cells // g), p or cells))
    return g, h


def mm_replicate(left: DataFrame, right: DataFrame, m: int | None = None, p: int | None = None,
                 n: int | None = None, *, grid: tuple[int, int] | None = None,
                 drop_zeros: bool = True) -> DataFrame:
    """Replicate-and-reduce strategy: both operands are copied across a grid
    of reducers that each hold everything their output cells need.

    Rows are dealt to ``g`` groups and columns to ``h``; a left entry goes to
    the ``h`` reducers of its row group, a right entry to the ``g`` of its
    column group, and they meet on the inner index inside a reducer:
    ``h |L| + g |R|`` rows are shuffled, whatever ``m`` and ``p``.  The
    default grid has a cell per shuffle partition and is shaped by the
    operands' sizes (they are stored once, duplicates summed, and counted);
    ``grid=(m, p)`` is one reducer per output cell.  Reducers of a finer grid
    than the default one share its cells, and an entry is sent once to all
    reducers of a cell: a task that holds many reducers holds it for each.
    Entries outside the declared shape (``i >= m``, ``k >= p``, ``j >= n``)
    never meet a partner.  The join key includes the inner index, so even a
    heavy row or column is spread over many tasks.  Neither side is
    broadcast: the planner knows the size of an operand, not of its copies.
    """
    l, r = _lr(left, right)
    for df_col, bound in (("i", m), ("c", n)):
        l = l if bound is None else l.where((F.col(df_col) >= 0) & (F.col(df_col) < bound))
    for df_col, bound in (("k", p), ("c", n)):
        r = r if bound is None else r.where((F.col(df_col) >= 0) & (F.col(df_col) < bound))
    l, r = stored(l, ("i", "c"), "v", "replicate-rows"), stored(r, ("c", "k"), "w", "replicate-columns")
    tasks = int(l.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = _shares(l.count(), r.count(), tasks, m, p)
    rows, columns = grid or shared
    g, h = min(rows, shared[0]), min(columns, shared[1])

    def group(name: str, size: int, reducers: int, bound: int | None) -> Column:
        x = F.col(name) if reducers == bound else F.xxhash64(name)
        return F.pmod(F.pmod(x, F.lit(reducers).cast("long")), F.lit(size).cast("long"))

    def every(size: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")))

    lx = l.select(group("i", g, rows, m).alias("a"), every(h).alias("b"), "i", "c", "v")
    rx = r.select(every(g).alias("a"), group("k", h, columns, p).alias("b"), "k", "c", "w")
    return _cells(lx.join(rx.hint("merge"), ["a", "b", "c"]), drop_zeros)


# --------------------------------------------------------------------- X5
LIST_WIDTH = 1 << 16   # ids per document part: a part lists at most this many entries


def _parts(l: DataFrame, r: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Per inner index, the left list cut into parts of ``width`` consecutive
    row ids and the right list into parts of ``width`` column ids.  After
    duplicates are summed (map-side partial sums first) a part holds at most
    ``width`` entries: a proven bound, with no pass over the data to find hot
    indices."""
    la = (l.withColumn("part_a", idiv("i", width))
           .groupBy("c", "part_a", "i").agg(F.sum("v").alias("v"))
           .groupBy("c", "part_a").agg(F.collect_list(F.struct("i", "v")).alias("left")))
    ra = (r.withColumn("part_b", idiv("k", width))
           .groupBy("c", "part_b", "k").agg(F.sum("w").alias("w"))
           .groupBy("c", "part_b").agg(F.collect_list(F.struct("k", "w")).alias("right")))
    return la, ra


def cogroup_documents(left: DataFrame, right: DataFrame, *,
                      width: int = LIST_WIDTH) -> DataFrame:
    """Group both operands by inner index into documents
    ``(c, part, left ARRAY<(i, v)>, right ARRAY<(k, w)>)``.

    The reference builds one document per inner index holding both lists.
    Here a list longer than ``width`` ids is cut into parts, and document
    ``part`` of an index holds left part ``part`` and right part ``part``
    (either may be empty).  An index with short lists keeps exactly one
    document, ``part = 0``.  Indices present on one side only yield a
    document with one empty list.
    """
    l, r = _lr(left, right)
    la, ra = _parts(l, r, width)
    docs = (la.withColumnRenamed("part_a", "part")
              .join(ra.withColumnRenamed("part_b", "part"), ["c", "part"], "full"))
    empty_l = F.array().cast("array<struct<i:bigint,v:double>>")
    empty_r = F.array().cast("array<struct<k:bigint,w:double>>")
    return docs.select("c", "part", F.coalesce("left", empty_l).alias("left"),
                       F.coalesce("right", empty_r).alias("right"))


def mm_cogroup(left: DataFrame, right: DataFrame, *, width: int = LIST_WIDTH,
               pairs_per_task: int | None = None, drop_zeros: bool = False) -> DataFrame:
    """Group-by-inner-index strategy: per inner index, every left entry times
    every right entry, then a sum per cell.

    An index has one list of left and one of right entries unless a list
    would pass ``width`` entries or its pairs ``pairs_per_task`` (default
    ``skew.PAIRS_PER_TASK``); then rows and columns are dealt to a grid of
    list parts, and a pair of parts, not the index, is what a task gets.
    Operands are stored once with duplicates summed, so counts bound lists.
    Parts meet by an equi-join and are expanded with two ``explode``s; the
    cells are written by tasks of bounded size (``store.small_tasks``).
    Cancelled sums are kept, as the reference's reducer writes every sum.
    """
    l, r = _lr(left, right)
    l, r = stored(l, ("i", "c"), "v", "cogroup-rows"), stored(r, ("c", "k"), "w", "cogroup-columns")
    la, ra = _list_parts(l, r, width, pairs_per_task)
    pairs = (la.join(ra, ["c", "_a", "_b"])
               .select(F.explode("left").alias("a"), "right")
               .select("a.i", "a.v", F.explode("right").alias("b"))
               .select("i", "v", "b.k", "b.w"))
    return written(_cells(pairs, drop_zeros), "cogroup-cells")


def _list_parts(l: DataFrame, r: DataFrame, width: int,
                pairs_per_task: int | None) -> tuple[DataFrame, DataFrame]:
    """Lists ``(c, _a, _b, left)`` and ``(c, _a, _b, right)``."""
    pairs = min(width * width, skew.PAIRS_PER_TASK if pairs_per_task is None else pairs_per_task)
    lg, rg = spread(l, r, "c", ["i"], ["k"], width, pairs_per_task=pairs)
    return (lg.groupBy("c", "_a", "_b").agg(F.collect_list(F.struct("i", "v")).alias("left")),
            rg.groupBy("c", "_a", "_b").agg(F.collect_list(F.struct("k", "w")).alias("right")))


# --------------------------------------------------------------------- X6 / X7
def mm_block(left: DataFrame, right: DataFrame, mb: int, kb: int, nb: int, *,
             mid_splits: int = 1, drop_zeros: bool = True,
             entries_per_group: int = CELL_ENTRIES) -> DataFrame:
    """Block strategy: tile both operands, multiply matching tiles, sum.

    Left tiles ``(bi, bk)`` hold at most ``mb x kb`` cells, right tiles
    ``(bk, bj)`` at most ``kb x nb``.  Both tilings are written once; their
    key columns and sizes are the block directories.  All tiles of some inner
    blocks, about ``entries_per_group`` entries, are one group, so a tile is
    sent once and not to each of its partners: where ids are many and entries
    few, tile pairs outnumber the products by far.  An inner block with more
    entries on a side is a group of its own, its tiles dealt to a grid of
    groups (``_tile_groups``).  The kernel multiplies a group's matching tiles
    in slices of a bounded number of partial products
    (``functions.arrays.Csr``), so its memory is that of the tiles however
    many products they make; results are summed over ``bk``.
    ``mid_splits > 1`` sums in two steps, first within ``bk mod mid_splits``
    groups, like a mid-dimension split.
    """
    from tessella.operators.layout import to_blocks

    def tiles(df, rows, columns, bk, name):
        df = written(df.select("i", "j", "v"), f"entries-{name}")
        blocks = to_blocks(df, rows, columns).withColumnsRenamed({bk: "bk"}).where("bk is not null")
        return written(blocks.withColumn("n", F.size("ei").cast("long")), f"tiles-{name}")

    lt, rt = tiles(left, mb, kb, "bj", "left"), tiles(right, kb, nb, "bi", "right")
    split = F.pmod(F.col("bk"), F.lit(mid_splits)).cast("long").alias("split")
    groups = ["split", "alone", "part", "_a", "_b"]
    cols = [split, *groups[1:], "side", "ei", "ej", "ev"]
    lg, rg = _tile_groups(lt, rt, entries_per_group)
    out = (lg.select(*cols).unionAll(rg.select(*cols)).groupBy(*groups)
           .applyInArrow(tile_cell, CELLS + ", split long"))
    if mid_splits > 1:
        out = out.groupBy("i", "k", "split").agg(F.sum("v").alias("v"))
    return _summed(out, drop_zeros)


def _tile_groups(lt: DataFrame, rt: DataFrame, entries: int) -> tuple[DataFrame, DataFrame]:
    """Tiles with their group ``(alone, part, _a, _b)``.  Inner blocks are
    dealt to parts of about ``entries`` entries; one with more entries than
    that on a side is alone in its part, its left tiles are cut into ``_sa``
    shares and its right tiles into ``_sb``, and every share meets every
    share of the other side."""
    tasks = int(lt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(0).cast("long")
    sizes = (lt.select("bk", F.col("n").alias("l"), none.alias("r"))
             .unionAll(rt.select("bk", none.alias("l"), F.col("n").alias("r")))
             .groupBy("bk").agg(F.sum("l").alias("l"), F.sum("r").alias("r")))
    total = sizes.agg(F.sum(F.col("l") + F.col("r"))).first()[0] or 0
    parts = max(tasks, math.ceil(total / entries))

    def cut(n: str) -> Column:
        return F.greatest(F.ceil(F.col(n) / entries), F.lit(1)).cast("int")

    # at most one row for ``entries`` entries of the operands
    large = F.broadcast(sizes.where((F.col("l") > entries) | (F.col("r") > entries))
                        .select("bk", cut("l").alias("_sa"), cut("r").alias("_sb")))
    alone = F.col("_sa").isNotNull()

    def placed(df, side, row, mine, n, other, m):
        return (df.join(large, "bk", "left").withColumn("alone", alone).withColumn("side", F.lit(side))
                .withColumn("part", F.when(alone, F.col("bk")).otherwise(F.pmod(F.xxhash64("bk"), F.lit(parts))))
                .withColumn(mine, F.pmod(F.xxhash64(row), F.coalesce(n, F.lit(1))).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(m, F.lit(1)) - 1))))

    return placed(lt, 0, "bi", "_a", "_sa", "_b", "_sb"), placed(rt, 1, "bj", "_b", "_sb", "_a", "_sa")


def mm_block_fixed_k(left: DataFrame, right: DataFrame, mb: int, nb: int, *,
                     tile_cells: int = LIST_ROWS, drop_zeros: bool = True) -> DataFrame:
    """Block strategy with the whole inner dimension in one block.

    Left strips of ``mb`` rows meet right strips of ``nb`` columns, each
    spanning the inner dimension, so every ``(bi, bj)`` result block is
    complete in one tile product and no partial sums cross inner blocks.
    A strip is still a group collected into one array, so its inner span is
    capped at ``tile_cells // mb`` indices (and ``tile_cells // nb``
    on the right, the smaller of the two): when the inner dimension is
    wider, strips are cut there and the per-cell sum adds the pieces.  Up to
    that width this is exactly the fixed-inner-dimension plan.
    """
    kb = max(1, tile_cells // max(mb, nb))
    return mm_block(left, right, mb, kb, nb, drop_zeros=drop_zeros)


# --------------------------------------------------------------------- X8
# Stored cells of a right operand that may be broadcast: three 8-byte arrays,
# about 100 MB.  Rows and columns of the operand are no more than its cells.
MAX_DENSE_CELLS = 4_000_000


def _in_width(right: DataFrame, n: int | None) -> DataFrame:
    """Right entries of a declared width: columns outside ``[0, n)`` are not
    part of the operand, whichever plan its width leads to."""
    kept = right.where(F.col("j") >= 0)
    return kept if n is None else kept.where(F.col("j") < F.lit(int(n)))


def _shared(right: DataFrame, max_cells: int) -> Csr | None:
    """The right operand as sparse rows in three arrays, or ``None`` if it
    has more than ``max_cells`` cells.  One run of the operand: at most one
    row beyond the bound leaves it."""
    r = (right.groupBy(F.col("i").cast("long").alias("c"), F.col("j").cast("long").alias("k"))
         .agg(F.sum(F.col("v").cast("double")).alias("w")).limit(max_cells + 1).toArrow())
    if r.num_rows > max_cells:
        return None
    return Csr(*[r.column(x).to_numpy() for x in ("c", "k", "w")])


def _times_shared(left: DataFrame, shared: Csr) -> DataFrame:
    l = left.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("c"),
                    F.col("v").cast("double").alias("v"))
    box = left.sparkSession.sparkContext.broadcast(shared)
    return _summed(l.mapInArrow(broadcast_rows(box), CELLS), drop_zeros=True)


def mm_row_dense(left: DataFrame, right: DataFrame, n: int | None = None, *,
                 max_dense_cells: int = MAX_DENSE_CELLS) -> DataFrame:
    """Sparse rows times a broadcast local matrix.

    The right operand is run once; if it has at most ``max_dense_cells``
    cells, its rows are broadcast as three arrays (row starts, columns,
    values) without filled-in zeros, and every task adds the products of its
    left rows up by cell, some hundred thousand entries at a time, before
    anything is shuffled.  Beyond the bound both operands meet in
    ``mm_outer``'s shuffle join.  Zeros are dropped (the reference filters
    them).
    """
    right = _in_width(right, n)
    shared = _shared(right, max_dense_cells)
    if shared is None:
        return mm_outer(left, right, drop_zeros=True)
    return _times_shared(left, shared)


# --------------------------------------------------------------------- X9
def mm_matvec(left: DataFrame, column: DataFrame, *,
              max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Matrix times one column ``(i, v)``: ``(i, v)`` of non-zero results.

    The reference runs one job per right column.  Here a column is one plan;
    ``mm_matvec_all`` takes all columns of a matrix in one."""
    col = column.groupBy(F.col("i").cast("long").alias("c")).agg(F.sum("v").alias("w"))
    if rows_at_most(col, max_broadcast_rows):
        col = F.broadcast(col)
    l = left.select("i", F.col("j").cast("long").alias("c"), "v")
    out = l.join(col, "c").groupBy("i").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return out.where(F.col("v") != 0)


def mm_matvec_all(left: DataFrame, right: DataFrame, *,
                  max_dense_cells: int = MAX_DENSE_CELLS) -> DataFrame:
    """Matrix times every column of a matrix, column by column.

    All columns at once while they fit a broadcast together, which reads the
    left operand once; beyond that ``mm_outer``'s shuffle join.  Non-zero
    cells ``(i, j, v)``; ``write_columns`` writes a folder per column."""
    return mm_row_dense(left, right, max_dense_cells=max_dense_cells)


def write_columns(left: DataFrame, right: DataFrame, path: str, *, rows_per_file: int = 1_000_000,
                  max_dense_cells: int = MAX_DENSE_CELLS) -> None:
    """One folder ``path/j=<column>`` of triples per result column, with at
    most ``rows_per_file`` rows a file (``write_coo`` spreads the columns)."""
    from tessella.sources.text import write_coo

    out = mm_matvec_all(left, right, max_dense_cells=max_dense_cells)
    write_coo(out.withColumn("column", F.col("j")), path, by="column", rows_per_file=rows_per_file)


# --------------------------------------------------------------------- X10
def mm_column_groups(left: DataFrame, right: DataFrame, h: int, n: int | None = None, *,
                     max_dense_cells: int = MAX_DENSE_CELLS) -> DataFrame:
    """Column-group strategy: right columns split by ``j mod h``.

    Returns ``(i, j, v, g)`` of all groups from one plan that reads the left
    operand once; the right operand is broadcast whole if it fits
    (``mm_row_dense``).  To hold only one group's ``1/h`` of it at a time, as
    the reference's per-group jobs do, use ``write_column_groups``.
    """
    out = mm_row_dense(left, right, n, max_dense_cells=max_dense_cells)
    return out.withColumn("g", F.pmod(F.col("j"), F.lit(h)).cast("int"))


def column_group_products(left: DataFrame, right: DataFrame, h: int, n: int | None = None, *,
                          max_dense_cells: int = MAX_DENSE_CELLS):
    """Yield ``(g, DataFrame (i, j, v))`` per column group, lazily.

    Group ``g`` holds columns ``g, g + h, ...`` renumbered ``c = j div h``.
    Both operands are stored once for all groups.  A group that fits is
    broadcast and the left rows stay where they are; for larger groups the
    left operand is dealt once to buckets of its inner index, hub indices
    counted and salted (``plans.store``), and no group exchanges it again.
    """
    from tessella.operators.entries import column_groups, from_column_groups

    l = written(left.select("i", "j", "v"), "groups-left")
    grouped = written(column_groups(_in_width(right, n), h).select("i", F.col("c").alias("j"), "v", "g"), "groups-right")
    store: HubStore | None = None
    for g in range(h):
        sub = grouped.where(F.col("g") == g).select("i", "j", "v")
        shared = _shared(sub, max_dense_cells)
        if shared is None:
            store = store or hub_store(_lr(l, sub)[0], "c", "i")
            prod = _cells(store.join(_lr(l, sub)[1]), drop_zeros=True)
        else:
            prod = _times_shared(l, shared)
        back = from_column_groups(prod.select("i", F.col("j").alias("c"), "v", F.lit(g).alias("g")), h)
        yield g, back.select("i", "j", "v")


def write_column_groups(left: DataFrame, right: DataFrame, h: int, path: str,
                        n: int | None = None, *, max_dense_cells: int = MAX_DENSE_CELLS) -> None:
    """Column-group product written one group per job into ``path/g=<g>``
    (the layout ``write_coo(by='g')`` makes), so each job broadcasts only
    ``1/h`` of the right operand, as the reference's per-group jobs do, and
    the left operand's own plan runs once."""
    from tessella.sources.text import write_coo

    for g, prod in column_group_products(left, right, h, n, max_dense_cells=max_dense_cells):
        write_coo(prod, f"{path.rstrip('/')}/g={g}")


def multiply(left, right, strategy: str = "outer", *, shape: str = "drop", **kw):
    """``Matrix x Matrix -> Matrix`` with one contract for every strategy.

    Declared inner sizes must agree.  Entries outside the declared shape of
    their operand (or of negative index) are treated before the product, in
    its own job: ``shape='drop'`` leaves them out, ``'raise'`` fails and names
    one, ``'error'`` looks for them now, ``'ignore'`` leaves them to the
    strategy.  So all strategies return the same cells, up to sums that
    cancel.  Strategies that enumerate a dimension get it from the declared
    shapes; the product's shape is declared."""
    from tessella.matrix import Matrix, check_product_shapes

    rows, cols = check_product_shapes(left, right)
    if strategy == "replicate":
        kw.setdefault("m", rows)
        kw.setdefault("p", cols)
        kw.setdefault("n", left.n_cols if left.n_cols is not None else right.n_rows)
    if strategy in ("row_dense", "column_groups") and cols is not None:
        kw.setdefault("n", cols)
    a, b = left.validated(shape), right.validated(shape)
    return Matrix(mm(a.entries(), b.entries(), strategy, **kw), rows, cols)


STRATEGIES.update({
    "inner_cartesian": mm_inner_cartesian,
    "replicate": mm_replicate,
    "cogroup": mm_cogroup,
    "block": mm_block,
    "block_fixed_k": mm_block_fixed_k,
    "row_dense": mm_row_dense,
    "matvec": mm_matvec_all,
    "column_groups": mm_column_groups,
})
