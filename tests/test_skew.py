"""Hot-key detection and the salt-grid join."""

from collections import Counter

from tessella.plans import skew


def _multiset(df, cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def _sides(spark):
    # key 0 is hot on both sides, key 1 hot on the left only, others cold
    left = [(0, i) for i in range(30)] + [(1, i) for i in range(12)] + [(k, 0) for k in range(2, 20)]
    right = [(0, 100 + i) for i in range(25)] + [(1, 200)] + [(k, 300 + k) for k in range(2, 20, 2)]
    l = spark.createDataFrame(left, "key long, a long")
    r = spark.createDataFrame(right, "key long, b long")
    return l, r


def test_hot_keys(spark):
    l, _ = _sides(spark)
    hot = {r["key"]: r["splits"] for r in skew.hot_keys(l, "key", 10).collect()}
    assert hot == {0: 3, 1: 2}


def test_hot_grid_none_when_cold(spark):
    l, r = _sides(spark)
    assert skew.hot_grid(l, r, "key", 1000) is None
    grid = {x["key"]: (x["_sa"], x["_sb"]) for x in skew.hot_grid(l, r, "key", 10).collect()}
    assert grid == {0: (3, 3), 1: (2, 1)}


def test_split_join_equals_plain_join(spark):
    l, r = _sides(spark)
    plain = _multiset(l.join(r, "key"), ["key", "a", "b"])
    for rows in (None, 1, 4, 10, 1000):
        got = skew.split_join(l, r, "key", ["a"], ["b"], rows_per_task=rows)
        assert _multiset(got, ["key", "a", "b"]) == plain


def test_threshold_kept_when_hot_table_is_large(spark, monkeypatch):
    l, r = _sides(spark)
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 1)
    grid = skew.hot_grid(l, r, "key", 1)        # many hot keys at 1 row: all kept, joined by a shuffle
    assert grid.count() == 2
    assert "ResolvedHint" not in grid._jdf.queryExecution().analyzed().toString()
    plain = _multiset(l.join(r, "key"), ["key", "a", "b"])
    got = skew.split_join(l, r, "key", ["a"], ["b"], rows_per_task=1)
    assert _multiset(got, ["key", "a", "b"]) == plain


def test_pairs_split_though_rows_are_few(spark):
    l, r = _sides(spark)                        # key 0: 30 x 25 pairs, key 1: 12 x 1
    grid = {x["key"]: (x["_sa"], x["_sb"]) for x in skew.hot_grid(l, r, "key", 1000, pairs_per_task=50).collect()}
    assert set(grid) == {0}
    a, b = grid[0]
    assert a > 1 and b > 1 and 30 * 25 / (a * b) <= 50
    one = {x["key"]: (x["_sa"], x["_sb"]) for x in skew.hot_grid(l, r, "key", 1000, pairs_per_task=4).collect()}
    assert one[1] == (3, 1)                     # the side with one row cannot be cut


def test_hub_is_split_by_default(spark):
    """20,000 x 20,000 rows on one index, thresholds as they come: the pairs
    of every task of the join stay under the bound, none holds the hub."""
    from pyspark.sql import functions as F

    n = 20_000
    l = spark.range(n).select(F.lit(0).alias("c"), F.col("id").alias("i"))
    r = spark.range(n).select(F.lit(0).alias("c"), F.col("id").alias("k"))
    (g,) = skew.hot_grid(l, r, "c").collect()
    assert n * n / (g["_sa"] * g["_sb"]) <= skew.PAIRS_PER_TASK
    a = l.groupBy(F.pmod(F.xxhash64("i"), F.lit(g["_sa"]))).count().agg(F.max("count")).first()[0]
    b = r.groupBy(F.pmod(F.xxhash64("k"), F.lit(g["_sb"]))).count().agg(F.max("count")).first()[0]
    assert a * b <= 1.1 * skew.PAIRS_PER_TASK


def test_composite_keys(spark):
    l = spark.createDataFrame([(0, s, i) for s in range(2) for i in range(9)], "k long, s long, a long")
    r = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 1, 3)], "k long, s long, b long")
    plain = _multiset(l.join(r, ["k", "s"]), ["k", "s", "a", "b"])
    got = skew.split_join(l, r, ["k", "s"], ["a"], ["b"], rows_per_task=2)
    assert _multiset(got, ["k", "s", "a", "b"]) == plain
