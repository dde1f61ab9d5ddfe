"""The product kernels, grids and stored operands: exact on random entries,
bounded in memory, cells, copies, files and exchanges."""

import glob
import math
import os
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import cells, dense_product, entries
from tessella.functions.arrays import Csr
from tessella.operators.layout import pack_rows
from tessella.plans import products as P
from tessella.plans import skew, store
from tessella.plans.store import hub_store
from tessella.session import scratch_path
from tessella.sources.text import read_coo, write_coo


def _sums(chunks):
    out = defaultdict(float)
    for i, k, v in chunks:
        for a, b, c in zip(i.tolist(), k.tolist(), v.tolist()):
            out[(a, b)] += c
    return dict(out)


@pytest.mark.parametrize("wide", [False, True])
def test_sliced_product_is_exact_at_every_slice_size(wide):
    r = np.random.default_rng(3)
    for _ in range(60):
        n, m, d = int(r.integers(0, 50)), int(r.integers(0, 50)), int(r.integers(1, 9))
        left = [(int(i), int(c), float(v)) for i, c, v in zip(r.integers(-3, 8, n), r.integers(0, d, n), r.integers(-3, 4, n))]
        cols = r.integers(-5, 10**12, m) if wide else r.integers(0, 5, m)
        right = [(int(c), int(k), float(w)) for c, k, w in zip(r.integers(0, d, m), cols, r.integers(-3, 4, m))]
        want = dense_product(left, right)
        a, b = np.array(left).reshape(-1, 3).T, np.array(right, dtype=object).reshape(-1, 3).T
        csr = Csr(b[0].astype(np.int64), b[1].astype(np.int64), b[2].astype(float))
        for limit in (1, 3, 17, 1 << 20):
            assert _sums(csr.product(a[0], a[1], a[2], limit)) == want


def test_product_memory_does_not_grow_with_the_products():
    def peak(columns):
        n = 4_000
        i, c = np.arange(n) % 500, np.arange(n) % 40
        rc, rk = np.arange(40 * columns) % 40, np.arange(40 * columns) // 40
        csr = Csr(rc, rk, np.ones(len(rc)))
        tracemalloc.start()
        products = sum(1 for _ in csr.product(i, c, np.ones(n), 1 << 16))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top, products

    small, few = peak(100)       # 400,000 partial products
    large, many = peak(3_000)    # 12,000,000
    assert many > 20 * few and large < 1.5 * small


def _hub(spark, n_left, n_right, others=50):
    left = spark.range(n_left).selectExpr("id as i", "0L as j", "1.0D as v").unionAll(
        spark.range(others).selectExpr("id as i", "id + 1 as j", "2.0D as v"))
    right = spark.range(n_right).selectExpr("0L as i", "id as j", "3.0D as v").unionAll(
        spark.range(others).selectExpr("id + 1 as i", "id as j", "1.0D as v"))
    return left, right


@pytest.mark.parametrize("strategy, kw", [
    ("outer", {"rows_per_task": 40}), ("inner_cartesian", {"entries_per_cell": 60}),
    ("cogroup", {"width": 32, "pairs_per_task": 200}), ("replicate", {}), ("block", {"mb": 64, "kb": 8, "nb": 32}),
    ("row_dense", {}), ("matvec", {})])
def test_hub_products(spark, strategy, kw):
    left, right = _hub(spark, 150, 120)
    want = dense_product([tuple(r) for r in left.collect()], [tuple(r) for r in right.collect()])
    assert cells(P.mm(left, right, strategy, **kw)) == want


def test_no_task_of_a_hub_is_above_the_pair_bound(spark):
    left, right = _hub(spark, 100_000, 100_000)
    la, ra = P._list_parts(*P._lr(left, right), P.LIST_WIDTH, None)
    pairs = (la.select("c", "_a", "_b", F.size("left").cast("long").alias("n"))
             .join(ra.select("c", "_a", "_b", F.size("right").alias("m")), ["c", "_a", "_b"]))
    got = pairs.agg(F.max(F.col("n") * F.col("m")), F.sum(F.col("n") * F.col("m")), F.max("n"), F.count("*")).first()
    assert got[0] <= 1.1 * skew.PAIRS_PER_TASK and got[1] == 100_000 ** 2 + 50
    assert got[2] <= P.LIST_WIDTH and got[3] >= 200


def test_grid_cells_hold_a_bounded_share(spark):
    left, right = _hub(spark, 3_000, 2_000, others=4_000)
    l, r = P._lr(left, right)
    lg, rg = skew.spread(l, r, "c", ["i"], ["k"], 500)
    part = F.pmod(F.xxhash64("c"), F.lit(16)).alias("part")
    sizes = (lg.select(part, "_a", "_b").unionAll(rg.select(part, "_a", "_b"))
             .groupBy("part", "_a", "_b").count().agg(F.max("count")).first()[0])
    assert sizes < 2_000        # two cut sides of the hub and a part of the others


def test_shares_copy_the_fewest_rows():
    for n_left, n_right, tasks in ((1_000, 1_000, 16), (10_000_000, 10, 64), (5, 9_000, 32), (0, 0, 8)):
        g, h = P._shares(n_left, n_right, tasks, None, None)
        cost = h * n_left + g * n_right
        assert g * h >= tasks and all(cost <= 1.6 * (math.ceil(tasks / x) * n_left + x * n_right) for x in range(1, tasks + 1))
    assert P._shares(10**6, 10**6, 64, 2, 3) == (2, 3)


def test_replicate_without_a_shape_and_cell_by_cell(spark):
    r = np.random.default_rng(1)
    left = [(int(a) * 10**11, int(b), 1.0) for a, b in r.integers(0, 30, (200, 2))]
    right = [(int(a), int(b) * 10**10, 2.0) for a, b in r.integers(0, 30, (200, 2))]
    want = dense_product(left, right)
    assert cells(P.mm_replicate(entries(spark, left), entries(spark, right))) == want
    small = [(int(a), int(b), 1.0) for a, b in r.integers(0, 6, (60, 2))]
    a = entries(spark, small)
    want = {x: v for x, v in dense_product([e for e in small if e[0] < 4], [e for e in small if e[1] < 5]).items()}
    assert cells(P.mm_replicate(a, a, 4, 5, grid=(4, 5))) == want == cells(P.mm_replicate(a, a, 4, 5))
    plan = P.mm_replicate(a, a, grid=(3, 2))._jdf.queryExecution().optimizedPlan().toString()
    assert "CROSS" not in plan.upper()


def test_stored_operand_is_not_exchanged_again(spark):
    left, right = _hub(spark, 400, 300)
    l, r = P._lr(left, right)
    store = hub_store(l, "c", "i", rows_per_task=50, buckets=5)
    assert {x["c"]: x["_n"] for x in store.hubs.collect()} == {0: 8}
    joined = store.join(r)
    rows = sorted(tuple(x) for x in joined.select("c", "i", "v", "k", "w").collect())
    assert rows == sorted(tuple(x) for x in l.join(r, "c").select("c", "i", "v", "k", "w").collect())
    plan = joined._jdf.queryExecution().executedPlan().toString()
    stored_side = plan[:plan.index("operand_")].rsplit("SortMergeJoin", 1)[1]
    assert "Exchange" not in stored_side and "Bucketed: true" in plan


def test_column_groups_beyond_the_broadcast_bound(spark):
    r = np.random.default_rng(2)
    left = [(int(a), int(b), float(v)) for a, b, v in r.integers(0, 20, (150, 3))]
    right = [(int(a), int(b), float(v)) for a, b, v in r.integers(0, 20, (150, 3))]
    want = {k: v for k, v in dense_product(left, right).items() if v}
    for bound in (10, 10_000):
        got = {}
        for g, part in P.column_group_products(entries(spark, left), entries(spark, right), 3, max_dense_cells=bound):
            for (i, j), v in cells(part).items():
                assert j % 3 == g
                got[(i, j)] = v
        assert got == want


def test_broadcast_kernel_sums_before_the_only_exchange(spark):
    left, right = _hub(spark, 300, 40)
    df = P.mm_row_dense(left, right)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "MapInArrow" in plan and "Join" not in plan


def test_files_per_key_are_bounded(spark):
    rows = spark.range(5_000).selectExpr("id as i", "if(id % 10 < 7, 0, id % 10) as j", "1.0D as v").repartition(16)
    path = scratch_path(spark, "by-key")
    write_coo(rows.withColumn("column", F.col("j")), path, by="column", rows_per_file=1_000)
    root = path.removeprefix("file:")
    files = {d: len(glob.glob(os.path.join(root, d, "part-*"))) for d in os.listdir(root) if d.startswith("column=")}
    assert set(files) == {"column=0", "column=7", "column=8", "column=9"}
    assert files.pop("column=0") == 4 and set(files.values()) == {1}
    assert cells(read_coo(spark, path).select("i", "j", "v")) == cells(rows)


def test_all_columns_with_a_folder_each(spark):
    left = [(0, 0, 1.0), (1, 0, 2.0), (1, 1, -1.0)]
    right = [(0, 5, 2.0), (0, 7, 1.0), (1, 7, 2.0)]
    path = scratch_path(spark, "columns")
    P.write_columns(entries(spark, left), entries(spark, right), path)
    got = read_coo(spark, path)
    assert cells(got.select("i", "j", "v")) == {(0, 5): 2.0, (1, 5): 4.0, (0, 7): 1.0}
    assert {r["column"] for r in got.select("column").distinct().collect()} == {5, 7}


def test_written_tasks_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    """F12, F16, F17: files are cut and shuffles dealt by size, whatever the
    session's partitions; the session's settings stay."""
    path, settings = str(tmp_path / "rows"), ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes",
                                              "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.range(200_000).selectExpr("xxhash64(id) as i", "id as j", "1D as v").repartition(1).write.parquet(path)
    rows, before = spark.read.parquet(path), [spark.conf.get(s) for s in settings]
    monkeypatch.setattr(store, "TASK_BYTES", 100_000)
    joins = "spark.sql.adaptive.coalescePartitions.enabled"
    joined = spark.conf.get(joins)
    spark.conf.set(joins, "false")          # a file for every partition of the shuffle
    try:
        sums = store.written(rows.groupBy("i", "j").agg(F.sum("v").alias("v")), "sums")
    finally:
        spark.conf.set(joins, joined)
    assert [spark.conf.get(s) for s in settings] == before
    assert len(sums.inputFiles()) > int(before[0])
    with store.small_tasks(rows) as n:
        assert n > int(before[0]) and rows.rdd.getNumPartitions() >= 10
    with pytest.raises(ZeroDivisionError), store.small_tasks(rows):
        1 / 0
    assert [spark.conf.get(s) for s in settings] == before
    assert sums.count() == 200_000 and sums.agg({"v": "sum"}).first()[0] == 200_000
    packed = pack_rows(rows.selectExpr("pmod(i, 50) as i", "j", "v"), 1000)
    assert packed.selectExpr("sum(size(idx))", "sum(size(val))").first() == (200_000, 200_000)
