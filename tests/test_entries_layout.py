"""Entry transforms and layout conversions on the FIXTURES cases."""

import pytest
from conftest import cells, entries

from tessella.operators import entries as EN
from tessella.operators import layout as LA


def test_transpose(spark):
    df = entries(spark, [(0, 1, 2), (3, 4, 5)])
    assert cells(EN.transpose(df)) == {(1, 0): 2.0, (4, 3): 5.0}


def test_symmetrize_self_loops(spark):
    df = entries(spark, [(0, 1, 2), (3, 3, 5)])
    dbl = sorted(tuple(r) for r in EN.symmetrize(df, "double").collect())
    assert dbl == [(0, 1, 2.0), (1, 0, 2.0), (3, 3, 5.0), (3, 3, 5.0)]
    once = sorted(tuple(r) for r in EN.symmetrize(df, "once").collect())
    assert once == [(0, 1, 2.0), (1, 0, 2.0), (3, 3, 5.0)]
    union = sorted(tuple(r) for r in EN.symmetrize_union(df).collect())
    assert union == dbl
    with pytest.raises(ValueError):
        EN.symmetrize(df, "twice")


def test_dedupe_policies(spark):
    from pyspark.sql import functions as F
    df = entries(spark, [(0, 1, 2), (0, 1, 3), (1, 1, 1)])
    assert cells(EN.dedupe(df, "sum")) == {(0, 1): 5.0, (1, 1): 1.0}
    ordered = df.withColumn("o", F.when(F.col("v") == 2, 9).otherwise(1))
    assert cells(EN.dedupe(ordered, "last", "o")) == {(0, 1): 2.0, (1, 1): 1.0}
    with pytest.raises(ValueError, match="duplicate"):
        EN.dedupe(df, "error")
    assert cells(EN.dedupe(entries(spark, [(0, 1, 2)]), "error")) == {(0, 1): 2.0}


def test_drop_zeros(spark):
    df = entries(spark, [(0, 1, 0), (0, 2, 1)])
    assert cells(EN.drop_zeros(df)) == {(0, 2): 1.0}


def test_shape_policies(spark):
    df = entries(spark, [(0, 0, 1), (2, 0, 1), (0, 5, 1)])
    assert cells(EN.validate_shape(df, 2, 3, "drop")) == {(0, 0): 1.0}
    assert len(cells(EN.validate_shape(df, 2, 3, "ignore"))) == 3
    with pytest.raises(ValueError, match="out of range"):
        EN.validate_shape(df, 2, 3, "error")
    st = EN.shape_stats(df, 2, 3).first()
    assert (st["nnz"], st["max_i"], st["max_j"], st["outside"]) == (3, 2, 5, 2)


def test_column_groups_roundtrip(spark):
    df = entries(spark, [(0, j, j) for j in range(10)])
    g = EN.column_groups(df, 4).collect()
    assert all(r["g"] == r["j"] % 4 and r["c"] == r["j"] // 4 for r in g)
    back = EN.from_column_groups(EN.column_groups(df, 4).drop("j"), 4)
    assert sorted(r["j"] for r in back.collect()) == list(range(10))


def test_pack_and_unpack_rows(spark):
    df = entries(spark, [(0, 5, 1), (0, 1, 2), (0, 1, 3), (0, 9, 4), (2, 0, 7)])
    packed = {(r["i"], r["seg"]): (list(r["idx"]), list(r["val"]))
              for r in LA.pack_rows(df, width=4).collect()}
    # row 0 is cut into segments of 4 column ids; duplicates summed, sorted
    assert packed == {(0, 0): ([1], [5.0]), (0, 1): ([5], [1.0]), (0, 2): ([9], [4.0]),
                      (2, 0): ([0], [7.0])}
    assert cells(LA.unpack_rows(LA.pack_rows(df, width=4))) == {
        (0, 1): 5.0, (0, 5): 1.0, (0, 9): 4.0, (2, 0): 7.0}
    cols = {(r["j"], r["seg"]): list(r["idx"]) for r in LA.pack_columns(df, 1 << 16).collect()}
    assert cols[(1, 0)] == [0]


def test_blocks_ragged(spark):
    rows = [(i, j, i * 10 + j) for i in range(7) for j in range(5) if (i + j) % 2 == 0]
    df = entries(spark, rows)
    blocks = LA.to_blocks(df, 3, 2)
    assert {(r["bi"], r["bj"]) for r in blocks.collect()} <= {(a, b) for a in range(3) for b in range(3)}
    assert cells(LA.from_blocks(blocks)) == {(i, j): float(v) for i, j, v in rows}
    st = {(r["bi"], r["bj"]): (r["nnz"], r["total"]) for r in LA.block_stats(df, 3, 2).collect()}
    assert sum(n for n, _ in st.values()) == len(rows)
    assert st[(2, 2)] == (1, 64.0)   # only (6, 4) lands in the ragged corner


def test_dense_rows_and_column(spark):
    df = entries(spark, [(0, 1, 2), (0, 1, 1), (1, 0, 5)])
    d = {r["i"]: list(r["vals"]) for r in LA.dense_rows(df, 3).collect()}
    assert d == {0: [0.0, 3.0, 0.0], 1: [5.0, 0.0, 0.0]}
    with pytest.raises(ValueError):
        LA.dense_rows(df, LA.MAX_DENSE_WIDTH + 1)
    col = spark.createDataFrame([(1, 4.0), (3, 2.0)], "i long, v double")
    dense = {r["i"]: r["v"] for r in LA.dense_column(spark, col, 5).collect()}
    assert dense == {0: 0.0, 1: 4.0, 2: 0.0, 3: 2.0, 4: 0.0}


def test_matrix_shape_checks(spark):
    from tessella.matrix import Matrix, check_product_shapes

    df = entries(spark, [(0, 0, 1), (2, 0, 1)])
    m = Matrix(df, 2, 3)
    assert cells(m.validated("drop").df) == {(0, 0): 1.0}
    with pytest.raises(ValueError):
        m.validated("error")
    assert check_product_shapes(Matrix(df, 4, 3), Matrix(df, 3, 5)) == (4, 5)
    with pytest.raises(ValueError, match="inner sizes"):
        check_product_shapes(Matrix(df, 4, 3), Matrix(df, 2, 5))
