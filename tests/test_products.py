"""Product strategies: brute force, cross-strategy agreement, algebra,
zero and duplicate policies, hot keys, plan shapes."""

import random
import re

import pytest
from conftest import cells, dense_product, entries
from pyspark.sql import functions as F

from tessella.operators.entries import transpose
from tessella.plans import products as P


def rand_rows(seed, n_rows, n_cols, nnz, lo=-3, hi=5):
    rnd = random.Random(seed)
    out = {}
    while len(out) < nnz:
        out[(rnd.randrange(n_rows), rnd.randrange(n_cols))] = float(rnd.choice([x for x in range(lo, hi) if x]))
    return [(i, j, v) for (i, j), v in out.items()]


A_ROWS = rand_rows(1, 37, 53, 300)
B_ROWS = rand_rows(2, 53, 29, 250)
EXPECT = dense_product(A_ROWS, B_ROWS)
EXPECT_NZ = {k: v for k, v in EXPECT.items() if v != 0}


@pytest.fixture(scope="module")
def ab(spark):
    return entries(spark, A_ROWS), entries(spark, B_ROWS)


def test_outer_matches_brute_force(ab):
    a, b = ab
    assert cells(P.mm_outer(a, b)) == EXPECT


def test_outer_explicit_partitions(ab):
    a, b = ab
    assert cells(P.mm_outer(a, b, partitions=7)) == EXPECT


def test_outer_explicit_salting_matches(ab):
    a, b = ab
    # every inner index with more than 2 rows is split over a salt grid
    assert cells(P.mm_outer(a, b, rows_per_task=2)) == EXPECT


@pytest.mark.parametrize("name,kwargs,drop", [
    ("mm_inner_broadcast", {}, True),
    ("mm_inner_broadcast", {"max_broadcast_rows": 10}, True),   # falls back to shuffle join
    ("mm_inner_cartesian", {}, False),
    ("mm_inner_cartesian", {"width": 8, "rows_per_task": 3}, False),
    ("mm_cogroup", {}, False),
    ("mm_cogroup", {"width": 4}, False),
    ("mm_block", {"mb": 5, "kb": 7, "nb": 3}, True),
    ("mm_block", {"mb": 5, "kb": 7, "nb": 3, "mid_splits": 3}, True),
    ("mm_block", {"mb": 100, "kb": 100, "nb": 100}, True),
    ("mm_block_fixed_k", {"mb": 4, "nb": 6}, True),
    ("mm_block_fixed_k", {"mb": 4, "nb": 6, "tile_cells": 40}, True),
    ("mm_row_dense", {}, True),
    ("mm_replicate", {"m": 37, "p": 29}, True),
])
def test_strategies_agree(ab, name, kwargs, drop):
    a, b = ab
    got = cells(getattr(P, name)(a, b, **kwargs))
    assert got == (EXPECT_NZ if drop else EXPECT)


def test_column_groups(ab):
    a, b = ab
    out = P.mm_column_groups(a, b, 4)
    rows = out.collect()
    assert {(r["i"], r["j"]): r["v"] for r in rows} == EXPECT_NZ
    assert all(r["g"] == r["j"] % 4 for r in rows)


def test_matvec(spark, ab):
    a, b = ab
    col = b.where("j = 3").select("i", "v")
    got = {r["i"]: r["v"] for r in P.mm_matvec(a, col).collect()}
    want = {i: v for (i, k), v in EXPECT_NZ.items() if k == 3}
    assert got == want


def test_dispatch(ab):
    a, b = ab
    assert cells(P.mm(a, b, "outer")) == EXPECT
    assert cells(P.mm(a, b, "replicate", m=37, p=29)) == EXPECT_NZ


def test_transpose_identity(spark, ab):
    a, b = ab
    left = cells(transpose(P.mm_outer(a, b)))
    right = cells(P.mm_outer(transpose(b), transpose(a)))
    assert left == right


def test_identity_and_distributive(spark, ab):
    a, b = ab
    eye = entries(spark, [(j, j, 1.0) for j in range(53)])
    assert cells(P.mm_outer(a, eye)) == {(i, j): v for i, j, v in A_ROWS}
    c_rows = rand_rows(3, 53, 29, 200)
    c = entries(spark, c_rows)
    bc = b.unionByName(c)              # B + C as un-merged entries (sums are linear)
    lhs = cells(P.mm_outer(a, bc), drop_zeros=True)
    ab_ = dense_product(A_ROWS, B_ROWS)
    ac = dense_product(A_ROWS, c_rows)
    rhs = {k: ab_.get(k, 0) + ac.get(k, 0) for k in set(ab_) | set(ac)}
    assert lhs == {k: v for k, v in rhs.items() if v != 0}


def test_cancel_keeps_or_drops_zero(spark):
    # (0,0,1),(0,1,1) x (0,0,1),(1,0,-1): the only cell sums to 0.0
    a = entries(spark, [(0, 0, 1), (0, 1, 1)])
    b = entries(spark, [(0, 0, 1), (1, 0, -1)])
    assert cells(P.mm_outer(a, b)) == {(0, 0): 0.0}
    assert cells(P.mm_cogroup(a, b)) == {(0, 0): 0.0}
    assert cells(P.mm_inner_cartesian(a, b)) == {(0, 0): 0.0}
    assert cells(P.mm_outer(a, b, drop_zeros=True)) == {}
    assert cells(P.mm_inner_broadcast(a, b)) == {}
    assert cells(P.mm_block(a, b, 2, 2, 2)) == {}
    assert cells(P.mm_replicate(a, b, 1, 1)) == {}


def test_duplicates_are_summed_everywhere(spark):
    a = entries(spark, [(0, 1, 2), (0, 1, 3), (1, 1, 1)])
    b = entries(spark, [(1, 0, 10)])
    want = {(0, 0): 50.0, (1, 0): 10.0}
    for fn in (P.mm_outer, P.mm_cogroup, P.mm_inner_cartesian, P.mm_inner_broadcast):
        assert cells(fn(a, b)) == want
    assert cells(P.mm_block(a, b, 1, 1, 1)) == want
    assert cells(P.mm_row_dense(a, b)) == want
    assert cells(P.mm_replicate(a, b, 2, 1)) == want


def test_empty_operand(spark):
    a = entries(spark, [(0, 1, 2)])
    empty = entries(spark, [])
    assert cells(P.mm_outer(a, empty)) == {}
    assert cells(P.mm_cogroup(empty, a)) == {}
    assert cells(P.mm_block(a, empty, 2, 2, 2)) == {}


def test_hub_inner_index(spark):
    # one inner index shared by many rows and many columns
    a_rows = [(i, 0, 1.0) for i in range(60)] + [(i, 1, 2.0) for i in range(5)]
    b_rows = [(0, k, 1.0) for k in range(40)] + [(1, 0, 3.0)]
    want = dense_product(a_rows, b_rows)
    a, b = entries(spark, a_rows), entries(spark, b_rows)
    assert cells(P.mm_outer(a, b, rows_per_task=7)) == want
    assert cells(P.mm_cogroup(a, b, width=8)) == want
    assert cells(P.mm_inner_cartesian(a, b, width=1, rows_per_task=5)) == want
    assert cells(P.mm_block_fixed_k(a, b, 8, 8, tile_cells=16)) == want


def test_replicate_ignores_out_of_shape(spark):
    a = entries(spark, [(0, 0, 1), (5, 0, 1), (0, 9, 1)])
    b = entries(spark, [(0, 0, 2), (0, 7, 2), (9, 0, 2)])
    # m=1, p=1, n=5: only cell (0,0) through inner index 0
    assert cells(P.mm_replicate(a, b, 1, 1, 5)) == {(0, 0): 2.0}


def test_row_dense_beyond_broadcast_bound(spark, ab):
    # too big to broadcast explicitly: same result through a shuffle join
    a, b = ab
    assert cells(P.mm_row_dense(a, b, max_dense_cells=10)) == EXPECT_NZ
    groups = P.mm_column_groups(a, b, 3, max_dense_cells=10)
    assert {(r["i"], r["j"]): r["v"] for r in groups.collect()} == EXPECT_NZ


def test_dense_strategies_on_wide_rows(spark):
    from tessella.operators.layout import MAX_DENSE_WIDTH
    a = entries(spark, [(0, 0, 2), (1, 1, 3)])
    b = entries(spark, [(0, MAX_DENSE_WIDTH + 5, 1), (1, 2, 4)])
    want = {(0, MAX_DENSE_WIDTH + 5): 2.0, (1, 2): 12.0}
    assert cells(P.mm_row_dense(a, b)) == want
    rows = P.mm_column_groups(a, b, 2).collect()
    assert {(r["i"], r["j"]): r["v"] for r in rows} == want
    assert all(r["g"] == r["j"] % 2 for r in rows)


def _plan(df):
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_broadcast_plan_shape(spark, ab):
    a, b = ab
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(P.mm_inner_broadcast(a, b))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "BroadcastHashJoin" in plan
    # the large side is never shuffled: only the partially aggregated cells are
    assert plan.count("Exchange hashpartitioning") == 1


def test_outer_plan_has_partial_aggregation(spark, ab):
    a, b = ab
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(P.mm_outer(a, b))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    assert "partial_sum" in plan


def test_aqe_splits_hot_inner_index(spark):
    """Default skew path: with thresholds scaled down to test size, AQE's
    skew join splits the partition of an inner index holding most entries."""
    from pyspark.sql import functions as F

    confs = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256KB",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k, None) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        hot = spark.range(200000).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("j"),
                                         F.lit(1.0).alias("v"))
        cold = spark.range(100000).select((F.col("id") % 5000).alias("i"), (F.col("id") + 1).alias("j"),
                                          F.lit(2.0).alias("v"))
        b = spark.range(100001).select(F.col("id").alias("i"), (F.col("id") % 7).alias("j"),
                                       F.lit(1.0).alias("v"))
        df = P.mm_outer(hot.unionByName(cold), b)
        rows = df.collect()
        plan = _plan(df)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert len(rows) == 230000
    got = {(r["i"], r["j"]): r["v"] for r in rows}
    # hot entries (i, 0, 1) meet right row 0 -> column 0; cold entry
    # (id % 5000, id + 1, 2) meets right row id + 1 -> column (id + 1) % 7
    assert got[(7, 0)] == 1.0 + sum(2.0 for x in range(100000) if x % 5000 == 7 and (x + 1) % 7 == 0)
    assert "skew=true" in plan


@pytest.mark.parametrize("n", [10, 16385])
def test_declared_width_holds_in_every_plan(spark, tmp_path, n):
    a = entries(spark, [(0, 0, 1), (1, 0, 2)])
    b = entries(spark, [(0, 3, 1), (0, n - 1, 5), (0, n + 1, 7), (0, n + 50, 8), (0, -1, 9)])
    want = {(0, 3): 1, (0, n - 1): 5, (1, 3): 2, (1, n - 1): 10}
    assert cells(P.mm_row_dense(a, b, n)) == want
    for h in (1, 4):
        assert cells(P.mm_column_groups(a, b, h, n)) == want
        got = {}
        for _, part in P.column_group_products(a, b, h, n):
            got |= cells(part)
        assert got == want


def _plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_replicate_broadcasts_no_copies(ab):
    a, b = ab
    out = P.mm_replicate(a, b, 37, 29)
    assert "BroadcastHashJoin" not in _plan(out) and cells(out) == EXPECT_NZ


def test_replicate_sends_an_entry_once_to_the_reducers_of_a_task(spark, ab):
    a, b = ab
    out = P.mm_replicate(a, b, 37, 29, grid=(37, 29))
    last = re.findall(r"sequence\(cast\(0 as bigint\), cast\((\d+) as bigint\)", _plan(out, "analyzed"))
    assert len(last) == 2 and max(map(int, last)) < int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert cells(out) == EXPECT_NZ


def test_block_sends_a_tile_once(spark):
    # one inner block, a tile for every entry: no tile is copied to its partners
    arrays = [F.array(F.lit(0).cast("long")).alias(x) for x in ("ei", "ej")] + [F.array(F.lit(1.0)).alias("ev")]
    tiles = spark.range(20).select(F.col("id").alias("bi"), F.lit(0).cast("long").alias("bk"),
                                   F.lit(1).cast("long").alias("n"), *arrays)
    left, right = P._tile_groups(tiles, tiles.withColumnRenamed("bi", "bj"), 100)
    assert left.count() == right.count() == 20
    groups = left.select("alone", "part", "_a", "_b").unionAll(right.select("alone", "part", "_a", "_b"))
    assert groups.distinct().count() == 1


@pytest.mark.parametrize("mid_splits", [1, 2])
def test_block_deals_a_large_inner_block_to_a_grid(ab, mid_splits):
    a, b = ab
    got = P.mm_block(a, b, 5, 20, 3, mid_splits=mid_splits, entries_per_group=16)
    assert cells(got) == EXPECT_NZ


def test_aggregated_operands_are_not_summed_again_where_they_are_made(ab, monkeypatch):
    from tessella.operators import layout
    from tessella.plans import store

    plans, write = [], store.written

    def seen(df, name):
        plans.append(_plan(df))
        return write(df, name)

    monkeypatch.setattr(store, "written", seen)
    monkeypatch.setattr(layout, "written", seen)
    sums = ab[0].groupBy("i", "j").agg(F.sum("v").alias("v"))
    assert cells(store.stored(sums, ("i", "j"), "v", "twice")) == cells(ab[0])
    assert cells(layout.unpack_rows(layout.pack_rows(sums))) == cells(ab[0])
    assert len(plans) == 3 and all(p.count("HashAggregate") <= 2 for p in plans)
