"""What happens to input that breaks a contract: shapes, duplicates,
documents, ids and samples."""

import pytest
from pyspark.sql import functions as F

from conftest import cells, dense_product, entries
from tessella.matrix import Matrix
from tessella.operators import entries as EN
from tessella.operators import graph as GR
from tessella.plans import products as P
from tessella.session import scratch_path
from tessella.sources import docs as DO

STRATEGIES = {"outer": {}, "inner_broadcast": {}, "inner_cartesian": {}, "replicate": {}, "cogroup": {},
              "block": {"mb": 2, "kb": 2, "nb": 2}, "block_fixed_k": {"mb": 2, "nb": 2}, "row_dense": {}, "matvec": {},
              "column_groups": {"h": 2}}
LEFT = [(0, 0, 1), (1, 2, 2), (9, 1, 3), (1, 7, 4), (-1, 0, 5), (0, -2, 6)]
RIGHT = [(0, 0, 1), (2, 3, 2), (1, 12, 3), (7, 1, 4), (0, -1, 5), (-2, 0, 6)]


@pytest.mark.parametrize("strategy", sorted(STRATEGIES))
def test_one_shape_contract(spark, strategy):
    left, right = Matrix(entries(spark, LEFT), 2, 3), Matrix(entries(spark, RIGHT), 3, 10)
    want = dense_product([e for e in LEFT if 0 <= e[0] < 2 and 0 <= e[1] < 3], [e for e in RIGHT if 0 <= e[0] < 3 and 0 <= e[1] < 10])
    kw = STRATEGIES[strategy]
    got = P.multiply(left, right, strategy, **kw)
    assert cells(got.df) == want and (got.n_rows, got.n_cols) == (2, 10)
    with pytest.raises(Exception, match=r"entry \(.*\) out of range for shape"):
        P.multiply(left, right, strategy, shape="raise", **kw).df.collect()
    inside = Matrix(entries(spark, LEFT[:2]), 2, 3), Matrix(entries(spark, RIGHT[:2]), 3, 10)
    assert cells(P.multiply(*inside, strategy, shape="raise", **kw).df) == want


def test_raise_policies_run_in_the_job(spark):
    df = entries(spark, [(0, 0, 1), (2, 0, 1), (0, 0, 4)])
    bad = EN.validate_shape(df, 2, 3, "raise")          # nothing runs yet
    with pytest.raises(Exception, match=r"entry \(2, 0\) out of range for shape \(2, 3\)"):
        bad.count()
    twice = EN.dedupe(df, "raise")
    with pytest.raises(Exception, match=r"duplicate entry \(0, 0\)"):
        twice.collect()
    assert cells(EN.dedupe(entries(spark, [(0, 1, 2), (1, 1, 3)]), "raise")) == {(0, 1): 2.0, (1, 1): 3.0}


def _lines(spark, lines):
    path = scratch_path(spark, "t-docs-bad")
    spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.text(path)
    return path


@pytest.mark.parametrize("line", [
    '{"i":1,"j":', '{"i":1,"j":2,"v":"x"}', '{"i":1,"v":2.0}', '{"i":1,"j":2}', '{"j":1,"v":2.0}', "[1]", "word", '{"i":1.5,"j":0,"v":1.0}'])
def test_documents_that_no_operand_can_take(spark, line):
    path = _lines(spark, ['{"i":0,"j":1,"v":2.0}', line, '{"j":1,"k":4,"v":3.0}'])
    left, right = DO.split_docs(DO.read_docs(spark, path, on_bad="drop"))
    assert cells(left) == {(0, 1): 2.0} and cells(right) == {(1, 4): 3.0}
    with pytest.raises(Exception, match="bad document"):
        DO.split_docs(DO.read_docs(spark, path))[0].collect()
    with pytest.raises(ValueError):
        DO.read_docs(spark, path, on_bad="skip")


def test_documents_of_neither_side_are_no_error(spark):
    path = _lines(spark, ['{"i":1,"j":1,"k":4,"v":2.0}', '{"i":0,"j":1,"v":2.0,"more":[1]}', ""])
    left, right = DO.split_docs(DO.read_docs(spark, path))
    assert cells(left) == {(0, 1): 2.0} and cells(right) == {}


@pytest.mark.parametrize("text", ['[{"i":1,"v":', '[{"i":1,"v":"x"}]', '[{"i":1}]', "[null]", '{"i":[1],"v":2}', "word"])
def test_lists_that_do_not_parse(spark, text):
    df = spark.createDataFrame([(1, '[{"i":1,"v":2.0}]', None), (2, text, '[{"k":1,"v":2.0}]'), (3, "[]", "[]")], "j long, i string, k string")
    got = {r["j"]: (len(r["left"]), len(r["right"])) for r in DO.parse_grouped(df, on_bad="drop").collect()}
    assert got == {1: (1, 0), 3: (0, 0)}
    with pytest.raises(Exception, match="bad document"):
        DO.parse_grouped(df).collect()


@pytest.mark.parametrize("accuracy", [1, 3, 50, 10_000])
def test_no_id_range_is_above_its_bound(spark, accuracy):
    # dense here, sparse there, negative, beyond 2^53
    ids = spark.range(3_000).select(F.expr("if(id < 2000, id, if(id < 2500, id * 1000003, -id * 3000000000000000))").alias("id"))
    cuts = GR.id_cuts(ids, 3_000, 100, accuracy)
    most = GR._bucketed(ids, cuts).groupBy("b").count().agg(F.max("count")).first()[0]
    assert most <= 100
    got = [(r["id"], r["dense"]) for r in GR.dense_ids(ids, ids_per_bucket=100, accuracy=accuracy).collect()]
    assert sorted(got) == [(x, n) for n, x in enumerate(sorted(x for x, _ in got))] and len(got) == 3_000


def test_too_few_vertices_for_the_sample(spark):
    for n in (0, 1, 7):
        with pytest.raises(Exception, match=f"8 sources asked of {n} vertices"):
            GR.sample_sources(spark.range(n), 8).collect()
    assert GR.sample_sources(spark.range(8), 8).count() == 8


def test_unknown_sources_are_one_error(spark):
    ids = GR.dense_ids(spark.range(50))
    src = spark.createDataFrame([(3, 0), (70, 1), (60, 2)], "vertex long, col long")
    for bound in (1, 1_000):
        with pytest.raises(KeyError, match="source vertex without an id: 60, 70"):
            GR.relabel_sources(src, ids, max_broadcast_rows=bound)


def test_scratch_is_removed_on_request():
    import os
    from types import SimpleNamespace

    from tessella import session

    # a session-like object with an application id of its own: the tests'
    # shared session keeps its files
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    sc = spark.sparkContext
    other = SimpleNamespace(sparkContext=SimpleNamespace(
        applicationId="other-app", _jvm=sc._jvm, _jsc=sc._jsc, getCheckpointDir=sc.getCheckpointDir, getConf=sc.getConf,
        master=sc.master, setCheckpointDir=sc.setCheckpointDir))
    mine, theirs = session.scratch_path(spark, "t-keep"), session.scratch_path(other, "t-drop")
    for p in (mine, theirs):
        spark.range(3).write.parquet(p)
    assert session.remove_scratch(other)
    assert spark.read.parquet(mine).count() == 3 and not os.path.exists(session.local_fs_path(theirs))
