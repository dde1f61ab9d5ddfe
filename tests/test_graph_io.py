"""Graph preparation, generators, readers and writers."""

import os

import pytest
from conftest import cells, entries

from tessella.operators import generate as GE
from tessella.operators import graph as GR
from tessella.plans import products as P
from tessella.session import local_fs_path, scratch_path
from tessella.sources import docs as DO
from tessella.sources import text as TX


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src long, dst long, w double")


SPARSE = [(7, 19, 1), (19, 1000000, 2), (7, 7, 3), (1000000, 42, 1)]


def test_vertex_set_and_dense_ids(spark):
    e = edges(spark, SPARSE)
    vs = sorted(r["id"] for r in GR.vertex_set(e).collect())
    assert vs == [7, 19, 42, 1000000]
    ids = {r["id"]: r["dense"] for r in GR.dense_ids(GR.vertex_set(e)).collect()}
    assert ids == {7: 0, 19: 1, 42: 2, 1000000: 3}


def test_dense_ids_many_buckets(spark):
    import random
    rnd = random.Random(5)
    vals = sorted(set(rnd.randrange(10**9) for _ in range(3000)))
    df = spark.createDataFrame([(v,) for v in vals], "id long")
    got = {r["id"]: r["dense"] for r in GR.dense_ids(df, ids_per_bucket=97).collect()}
    assert got == {v: n for n, v in enumerate(vals)}


def test_relabel_edges_and_salting(spark):
    rows = SPARSE + [(7, 42, 1)] * 5
    e = edges(spark, rows)
    ids = GR.dense_ids(GR.vertex_set(e))
    plain = sorted(tuple(r) for r in GR.relabel_edges(e, ids, rows_per_task=None).collect())
    salted = sorted(tuple(r) for r in GR.relabel_edges(e, ids, rows_per_task=2).collect())
    m = {7: 0, 19: 1, 42: 2, 1000000: 3}
    want = sorted((m[a], m[b], float(w)) for a, b, w in rows)
    assert plain == want == salted


def test_unweighted_edges(spark):
    e = spark.createDataFrame([(1, 2, None), (2, 3, 5.0)], "src long, dst long, w double")
    assert sorted(tuple(r) for r in GR.edges_unweighted(e).collect()) == [(1, 2, 1.0), (2, 3, 5.0)]


def test_sample_sources(spark):
    vs = spark.range(500).select("id")
    s = GR.sample_sources(vs, 100, "x").collect()
    assert len(s) == 100
    assert len({r["vertex"] for r in s}) == 100
    assert sorted(r["col"] for r in s) == list(range(100))
    assert [r["vertex"] for r in s] == sorted(r["vertex"] for r in s)
    again = GR.sample_sources(vs, 100, "x").collect()
    assert again == s
    other = GR.sample_sources(vs, 100, "y").collect()
    assert other != s


def test_relabel_sources_unknown_vertex(spark):
    e = edges(spark, SPARSE)
    ids = GR.dense_ids(GR.vertex_set(e))
    src = spark.createDataFrame([(19, 0), (55, 1)], "vertex long, col long")
    with pytest.raises(KeyError, match="source vertex without an id"):
        GR.relabel_sources(src, ids)
    # above the broadcast bound the check runs inside the job
    with pytest.raises(Exception, match="source vertex without an id: 55"):
        GR.relabel_sources(src, ids, max_broadcast_rows=1).collect()
    ok = spark.createDataFrame([(19, 0), (42, 1)], "vertex long, col long")
    assert cells(GR.relabel_sources(ok, ids)) == {(1, 0): 1.0, (2, 1): 1.0}
    assert cells(GR.relabel_sources(ok, ids, max_broadcast_rows=1)) == {(1, 0): 1.0, (2, 1): 1.0}


def test_msbfs_hop(spark):
    # path 0-1-2 plus a self-loop at 2; sources 1 (column 0) and 2 (column 1)
    e = edges(spark, [(0, 1, 1), (1, 2, 1), (2, 2, 1)])
    src = entries(spark, [(1, 0, 1), (2, 1, 1)])
    got = cells(GR.msbfs_hop(e, src))
    assert got == {(0, 0): 1.0, (2, 0): 1.0, (1, 1): 1.0, (2, 1): 2.0}
    assert cells(GR.msbfs_hop(e, src, self_loops="once"))[(2, 1)] == 1.0
    assert cells(GR.msbfs_hop(e, src, strategy="block", mb=2, kb=2, nb=2)) == got


def test_random_sparse(spark):
    rows = spark.range(200).select("id")
    m = GE.random_sparse(rows, 50, 0.1, "t").collect()
    assert len(m) == 200 * 5
    for density in (0.00001, 0.0001, 0.001, 0.004, 0.05, 0.5, 1.0):
        n = GE.random_sparse(spark.range(50_000).select("id"), 100, density, "t").count()
        want = 50_000 * 100 * density
        assert abs(n - want) <= max(0.01 * want, 4 * want ** 0.5)
    assert GE.random_sparse(spark.range(3).select("id"), 7, 1.0).distinct().count() == 21
    assert all(0 <= r["j"] < 50 and 1 <= r["v"] <= 9 for r in m)
    assert len({(r["i"], r["j"]) for r in m}) == len(m)
    assert GE.random_sparse(rows, 50, 0.1, "t").collect() == m
    assert GE.random_sparse(rows, 50, 0.0, "t").count() == 0


def test_coo_roundtrip_and_header(spark):
    df = entries(spark, [(0, 1, 1.0), (2, 3, 4.5)])
    p = scratch_path(spark, "t-coo")
    TX.write_coo(df, p)
    lines = sorted(r["value"] for r in spark.read.text(p).collect())
    assert lines == ["0 1 1.0", "2 3 4.5"]
    assert cells(TX.read_coo(spark, p, partitions=3)) == {(0, 1): 1.0, (2, 3): 4.5}
    # header flag: reading headerless files with header=True loses each one's first line
    one = scratch_path(spark, "t-one")
    TX.write_coo(df.coalesce(1), one)
    assert TX.read_coo(spark, one, header=True).count() == 1
    h = scratch_path(spark, "t-header")
    TX.write_coo(entries(spark, [(0, 1, 3), (1, 1, 2)]), h, sep=",", header="m k v", integer_values=True)
    assert cells(TX.read_coo(spark, h, sep=",", header=True)) == {(0, 1): 3.0, (1, 1): 2.0}


def test_write_by_column_folders(spark):
    df = entries(spark, [(0, 1, 1.0), (2, 3, 4.5), (5, 1, 2.0)])
    p = scratch_path(spark, "t-by")
    TX.write_coo(df, p, by="j")
    dirs = sorted(d for d in os.listdir(local_fs_path(p)) if d.startswith("j="))
    assert dirs == ["j=1", "j=3"]


def test_tagged_roundtrip(spark):
    a = entries(spark, [(0, 1, 1.0)])
    b = entries(spark, [(1, 2, 3.0), (1, 4, 5.0)])
    p = scratch_path(spark, "t-tag")
    TX.write_tagged(a, b, p)
    with open(os.path.join(local_fs_path(p), "extra.txt"), "w") as f:
        f.write("X,4,5,6.0\n")     # any tag other than M is the right operand
    left, right = TX.read_tagged(spark, p)
    assert cells(left) == {(0, 1): 1.0}
    assert cells(right) == {(1, 2): 3.0, (1, 4): 5.0, (4, 5): 6.0}


def test_edges_and_vertices_roundtrip(spark):
    e = edges(spark, SPARSE)
    p = scratch_path(spark, "t-e")
    TX.write_edges(e, p, weighted=False)
    back = sorted(tuple(r) for r in TX.read_edges(spark, p).collect())
    assert back == sorted((a, b, 1.0) for a, b, _ in SPARSE)
    v = scratch_path(spark, "t-v")
    TX.write_vertices(GR.vertex_set(e), v)
    assert sorted(r["id"] for r in TX.read_vertices(spark, v).collect()) == [7, 19, 42, 1000000]


def test_document_side_predicate(spark):
    docs = spark.createDataFrame(
        [(1, 2, None, 3.0), (None, 2, 4, 5.0), (0, 2, 7, 1.0), (0, 3, 0, 2.0), (1, 2, 4, 9.0)],
        DO.DOC_SCHEMA)
    left, right = DO.split_docs(docs)
    # {i:0,k:7} is right only; {i:0,k:0} is both; {i:1,k:4} is neither
    assert cells(left) == {(1, 2): 3.0, (0, 3): 2.0}
    assert cells(right) == {(2, 4): 5.0, (2, 7): 1.0, (3, 0): 2.0}


def test_documents_roundtrip_and_grouping(spark):
    a = entries(spark, [(i, 0, 1.0) for i in range(10)] + [(3, 1, 2.0)])
    b = entries(spark, [(0, 5, 2.0), (2, 6, 1.0)])
    p = scratch_path(spark, "t-docs")
    DO.write_docs(a, b, p)
    left, right = DO.split_docs(DO.read_docs(spark, p))
    docs = P.cogroup_documents(left, right, width=4)
    g = DO.materialize(docs, scratch_path(spark, "t-grouped"))
    rows = {(r["c"], r["part"]): (len(r["left"]), len(r["right"])) for r in g.collect()}
    # index 0 has 10 left entries: parts of 4 row ids (0-3, 4-7, 8-9); right
    # entries go to the part of their column id (5 div 4 = 1, 6 div 4 = 1);
    # index 2 is right only
    assert rows == {(0, 0): (4, 0), (0, 1): (4, 1), (0, 2): (2, 0), (1, 0): (1, 0), (2, 1): (0, 1)}
    parsed = DO.parse_grouped(DO.grouped_json(g))
    assert sum(len(r["left"]) for r in parsed.collect()) == 11
    cd = DO.cell_docs(P.mm_outer(a, b)).collect()
    assert {r["_id"]: r["value"] for r in cd}["3,5"] == 2


def test_checkpoint_dir_from_session(spark):
    from tessella.session import checkpoint_dir
    assert checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_write_column_groups_one_job_per_group(spark):
    from tessella.plans import products as P

    a = entries(spark, [(0, 0, 1.0), (1, 1, 2.0), (1, 0, 1.0)])
    b = entries(spark, [(0, j, 1.0) for j in range(6)] + [(1, 5, 3.0)])
    p = scratch_path(spark, "t-groups")
    P.write_column_groups(a, b, 4, p)
    dirs = sorted(d for d in os.listdir(local_fs_path(p)) if d.startswith("g="))
    assert dirs == ["g=0", "g=1", "g=2", "g=3"]
    back = TX.read_coo(spark, p)
    assert cells(back.select("i", "j", "v")) == cells(P.mm_outer(a, b, drop_zeros=True))
    assert all(r["g"] == r["j"] % 4 for r in back.collect())


def test_sources_file_and_cell_documents(spark):
    p = scratch_path(spark, "t-src")
    with_dir = local_fs_path(p)
    os.makedirs(with_dir)
    with open(os.path.join(with_dir, "N_tmp"), "w") as f:
        f.write("12 41 1.0\n7 0 1.0\n")
    got = sorted(tuple(r) for r in TX.read_sources(spark, p).collect())
    assert got == [(7, 0), (12, 41)]
    out = scratch_path(spark, "t-cells")
    DO.write_cells(entries(spark, [(0, 3, 2.0), (1, 4, 5.0)]), out)
    docs = {r["_id"]: r["value"] for r in spark.read.json(out).collect()}
    assert docs == {"0,3": 2, "1,4": 5}


def test_bad_lines(spark):
    p = scratch_path(spark, "t-bad")
    spark.createDataFrame([("1 2 3.0",), ("4 x 1.0",), ("5 6 2.0 ",), ("7 8 1.0 9",)], "line string").write.text(p)
    assert cells(TX.read_coo(spark, p, on_bad="drop")) == {(1, 2): 3.0, (5, 6): 2.0, (7, 8): 1.0}
    with pytest.raises(Exception, match="bad line: 4 x 1.0"):
        TX.read_coo(spark, p).count()
    e = scratch_path(spark, "t-bad-edges")
    spark.createDataFrame([("1 2",), ("3 4 abc",), ("5 6 0.5",)], "line string").write.text(e)
    assert {tuple(r) for r in TX.read_edges(spark, e, on_bad="drop").collect()} == {(1, 2, 1.0), (5, 6, 0.5)}
    with pytest.raises(Exception, match="bad line: 3 4 abc"):
        TX.read_edges(spark, e).collect()


def test_floor_division(spark):
    from tessella.functions import idiv

    got = spark.createDataFrame([(-5,), (-1,), (0,), (4,), (5,)], "x long").select(idiv("x", 5)).collect()
    assert [r[0] for r in got] == [-1, -1, 0, 0, 1]
