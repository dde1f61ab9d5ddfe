"""Algebraic properties and cross-strategy agreement on seeded random
sparse matrices (integer values, so equality is exact)."""

import pytest
from conftest import cells, dense_product

from tessella.operators.entries import transpose
from tessella.operators.generate import random_sparse
from tessella.plans import products as P


def rand(spark, rows, cols, density, seed):
    return random_sparse(spark.range(rows).select("id"), cols, density, seed)


def rows_of(df):
    return [(r["i"], r["j"], r["v"]) for r in df.collect()]


@pytest.mark.parametrize("density", [0.02, 0.1, 0.5])
def test_random_products(spark, density):
    a = rand(spark, 40, 30, density, f"a{density}")
    b = rand(spark, 30, 20, density, f"b{density}")
    want = dense_product(rows_of(a), rows_of(b))
    want_nz = {k: v for k, v in want.items() if v != 0}
    assert cells(P.mm_outer(a, b)) == want
    assert cells(P.mm_cogroup(a, b, width=7)) == want
    assert cells(P.mm_inner_cartesian(a, b, width=9)) == want
    assert cells(P.mm_inner_broadcast(a, b)) == want_nz
    assert cells(P.mm_block(a, b, 7, 6, 5, mid_splits=2)) == want_nz
    assert cells(P.mm_replicate(a, b, 40, 20)) == want_nz
    assert cells(P.mm_row_dense(a, b, 20)) == want_nz
    assert {(r["i"], r["j"]): r["v"] for r in P.mm_column_groups(a, b, 3, 20).collect()} == want_nz
    # (AB)^T = B^T A^T
    assert cells(transpose(P.mm_outer(a, b))) == cells(P.mm_outer(transpose(b), transpose(a)))


def test_associativity(spark):
    a = rand(spark, 15, 12, 0.3, "x")
    b = rand(spark, 12, 10, 0.3, "y")
    c = rand(spark, 10, 8, 0.3, "z")
    left = cells(P.mm_outer(P.mm_outer(a, b), c), drop_zeros=True)
    right = cells(P.mm_outer(a, P.mm_outer(b, c)), drop_zeros=True)
    assert left == right


def test_multiply_with_shapes(spark):
    from tessella.operators.generate import random_matrix
    from tessella.plans.products import multiply
    from tessella.session import persisted

    a = random_matrix(spark, 12, 9, 0.3, "ma")
    b = random_matrix(spark, 9, 7, 0.3, "mb")
    assert (a.n_rows, a.n_cols) == (12, 9)
    a = type(a)(persisted(a.df), a.n_rows, a.n_cols)
    want = {k: v for k, v in dense_product(rows_of(a.df), rows_of(b.df)).items() if v != 0}
    for strategy in ("outer", "replicate", "block", "row_dense", "column_groups"):
        kw = {"mb": 4, "kb": 4, "nb": 4} if strategy == "block" else {}
        kw = {"h": 3} if strategy == "column_groups" else kw
        c = multiply(a, b, strategy, **kw)
        assert (c.n_rows, c.n_cols) == (12, 7)
        assert cells(c.df.select("i", "j", "v"), drop_zeros=True) == want
    with pytest.raises(ValueError, match="inner sizes"):
        multiply(a, random_matrix(spark, 8, 7, 0.3, "mc"))
    a.df.unpersist()


def test_few_ids_are_dealt_to_all_partitions(spark):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = random_sparse(spark.range(1000).select("id").coalesce(1), 100, 1.0, "p")
    assert out.rdd.getNumPartitions() == tasks
    assert out.select("i", "j").distinct().count() == 100_000
