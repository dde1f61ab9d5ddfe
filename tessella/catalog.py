"""Registered queries over the parquet test tables and their DuckDB oracles.

Each query is ``fn(spark, sf_dir) -> DataFrame`` and reads whole tables (or
data Spark derives from them).  The oracle SQL computes the same rows with
plain joins and aggregates; column names and types are aligned (``BIGINT``
indices, ``DOUBLE`` values).  Queries that exercise a reader or writer first
write Spark-derived data to a fresh folder under the shared checkpoint
folder, then read it back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.matrix import Matrix
from tessella.operators import entries as EN
from tessella.operators import generate as GE
from tessella.operators import graph as GR
from tessella.operators import layout as LA
from tessella.plans import products as P
from tessella.session import scratch_path
from tessella.sources import docs as DO
from tessella.sources import tables as TB
from tessella.sources import text as TX

QueryFn = Callable[[SparkSession, str], DataFrame]

# Fixed parameters of the registered queries.
BFS_SOURCES = 100          # columns of the BFS source matrix
BFS_SEED = "bfs"
RANDOM_COLS = 100
RANDOM_DENSITY = 0.05
RANDOM_SEED = "rs"
GROUPS = 4                 # column groups for the lump strategy
BLOCK = (256, 16384, 2048)  # mb, kb, nb for the block product
STRIP = (64, 8)             # mb, nb for the fixed-inner block product
STATS_BLOCK = (10, 1000)   # mb, kb for block statistics
SEGMENT = LA.DEFAULT_SEGMENT

# ------------------------------------------------------------ SQL operands
SQL_M_SO = ("SELECT l_suppkey AS i, l_orderkey AS j, SUM(l_quantity) AS v "
            "FROM lineitem GROUP BY l_suppkey, l_orderkey")
SQL_M_RAW = "SELECT l_suppkey AS i, l_orderkey AS j, CAST(l_quantity AS DOUBLE) AS v FROM lineitem"
SQL_N_ON = ("SELECT o_orderkey AS i, CAST(c_nationkey AS BIGINT) AS j, CAST(1 AS DOUBLE) AS v "
            "FROM orders JOIN customer ON o_custkey = c_custkey")
SQL_N_OC = "SELECT o_orderkey AS i, o_custkey AS j, CAST(1 AS DOUBLE) AS v FROM orders"
SQL_M_NO = ("SELECT CAST(s_nationkey AS BIGINT) AS i, l_orderkey AS j, SUM(l_quantity) AS v "
            "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, l_orderkey")
SQL_E_PS = ("SELECT l_partkey AS src, l_suppkey AS dst, CAST(l_quantity AS DOUBLE) AS w "
            "FROM lineitem")
SQL_X_EMB = ("SELECT vec_id AS i, CAST(pos - 1 AS BIGINT) AS j, "
             "CAST(CAST(round(CAST(e AS DOUBLE) * 1000) AS BIGINT) AS DOUBLE) AS v "
             "FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS pos "
             "FROM embeddings)")
SQL_VEC_ON = ("SELECT o_orderkey AS i, CAST(c_nationkey AS DOUBLE) AS v "
              "FROM orders JOIN customer ON o_custkey = c_custkey")
SQL_IDS = ("WITH e AS ({e}), vs AS (SELECT src AS id FROM e UNION SELECT dst FROM e) "
           "SELECT id, CAST(DENSE_RANK() OVER (ORDER BY id) - 1 AS BIGINT) AS dense FROM vs")


def product_sql(lsql: str, rsql: str, nonzero: bool = False, select_extra: str = "") -> str:
    having = " HAVING SUM(l.v * r.v) <> 0" if nonzero else ""
    return (f"WITH l AS ({lsql}), r AS ({rsql}) "
            f"SELECT l.i AS i, r.j AS j, SUM(l.v * r.v) AS v{select_extra} "
            f"FROM l JOIN r ON l.j = r.i GROUP BY l.i, r.j{having}")


def transpose_sql(sql: str) -> str:
    return f"SELECT j AS i, i AS j, v FROM ({sql})"


def sources_sql(seed: str = BFS_SEED, c: int = BFS_SOURCES) -> str:
    """Vertices of E_ps, the seeded sample, and its column permutation."""
    return (f"e AS ({SQL_E_PS}), vs AS (SELECT src AS id FROM e UNION SELECT dst FROM e), "
            f"ids AS (SELECT id, CAST(DENSE_RANK() OVER (ORDER BY id) - 1 AS BIGINT) AS dense FROM vs), "
            f"picked AS (SELECT id AS vertex FROM vs "
            f"ORDER BY md5('{seed}:pick:' || CAST(id AS VARCHAR)), id LIMIT {c}), "
            f"src AS (SELECT vertex, CAST(ROW_NUMBER() OVER (ORDER BY md5('{seed}:col:' || "
            f"CAST(vertex AS VARCHAR)), vertex) - 1 AS BIGINT) AS col FROM picked)")


# ------------------------------------------------------------ operands
def m_so(spark, d):
    return TB.supplier_order(spark, d)


def n_on(spark, d):
    return TB.order_nation(spark, d)


def ids_of(spark, d):
    return GR.dense_ids(GR.vertex_set(TB.part_supplier_edges(spark, d)))


# ------------------------------------------------------------ products
def q_mm_outer(spark, d):
    return P.mm_outer(m_so(spark, d), n_on(spark, d))


def q_mm_outer_partitions(spark, d):
    return P.mm_outer(m_so(spark, d), n_on(spark, d), partitions=JOIN_PARTITIONS)


def q_mm_outer_gram(spark, d):
    m = m_so(spark, d)
    return P.mm_outer(m, EN.transpose(m))


# Skew paths on whole tables: thresholds low enough that many real keys are
# "hot", so the splitting code itself is checked against the oracle.
SALT_ROWS = 4          # an order with more than 4 supplier entries is split
SALT_EDGE_ROWS = 20    # a part with more than 20 line items is split
JOIN_PARTITIONS = 24   # of both sides of a join whose parallelism is given
NARROW = 64            # list / segment width in ids


def q_mm_outer_salted(spark, d):
    return P.mm_outer(m_so(spark, d), n_on(spark, d), rows_per_task=SALT_ROWS)


def q_mm_cogroup_parts(spark, d):
    return P.mm_cogroup(m_so(spark, d), n_on(spark, d), width=NARROW)


def q_mm_inner_segments(spark, d):
    return P.mm_inner_cartesian(TB.nation_order(spark, d), n_on(spark, d), width=NARROW * 64)


def q_mm_block_fixed_k_cut(spark, d):
    mb, nb = STRIP
    return P.mm_block_fixed_k(m_so(spark, d), n_on(spark, d), mb, nb, tile_cells=mb * 1000)


def q_relabel_edges_salted(spark, d):
    edges = TB.part_supplier_edges(spark, d)
    return GR.relabel_edges(edges, GR.dense_ids(GR.vertex_set(edges)), rows_per_task=SALT_EDGE_ROWS)


def q_mm_inner_broadcast(spark, d):
    return P.mm_inner_broadcast(m_so(spark, d), n_on(spark, d))


def q_mm_inner_cartesian(spark, d):
    return P.mm_inner_cartesian(TB.nation_order(spark, d), n_on(spark, d))


def _nations(spark, d):
    return TB.table(spark, d, "nation").agg(F.max("n_nationkey")).first()[0] + 1


def q_mm_replicate(spark, d):
    side = _nations(spark, d)
    return P.mm_replicate(TB.nation_order(spark, d), n_on(spark, d), m=side, p=side)


def q_mm_cogroup(spark, d):
    return P.mm_cogroup(m_so(spark, d), n_on(spark, d))


def q_mm_block(spark, d):
    mb, kb, nb = BLOCK
    return P.mm_block(m_so(spark, d), TB.order_customer(spark, d), mb, kb, nb)


def q_mm_block_mid_splits(spark, d):
    mb, kb, nb = BLOCK
    return P.mm_block(m_so(spark, d), TB.order_customer(spark, d), mb, kb, nb, mid_splits=3)


def q_mm_block_fixed_k(spark, d):
    mb, nb = STRIP
    return P.mm_block_fixed_k(m_so(spark, d), n_on(spark, d), mb, nb)


def q_mm_row_dense(spark, d):
    x = TB.embedding_entries(spark, d)
    return P.mm_row_dense(EN.transpose(x), x)


def q_mm_matvec(spark, d):
    o = TB.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = TB.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    vec = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("i"), F.col("c_nationkey").cast("double").alias("v"))
    return P.mm_matvec(m_so(spark, d), vec)


def q_mm_matvec_all(spark, d):
    # every column in one plan, a folder per column
    path = scratch_path(spark, "columns")
    P.write_columns(m_so(spark, d), n_on(spark, d), path)
    return TX.read_coo(spark, path).select("i", "j", "v")


def q_mm_replicate_cells(spark, d):
    side = _nations(spark, d)
    return P.mm_replicate(TB.nation_order(spark, d), n_on(spark, d), m=side, p=side, grid=(side, side))


def q_mm_column_groups(spark, d):
    return P.mm_column_groups(m_so(spark, d), n_on(spark, d), GROUPS)


def msbfs(spark, d, strategy, **kw):
    edges = TB.part_supplier_edges(spark, d)
    ids = GR.dense_ids(GR.vertex_set(edges))
    rel = GR.relabel_edges(edges, ids)
    src = GR.relabel_sources(GR.sample_sources(ids.select("id"), BFS_SOURCES, BFS_SEED), ids)
    return GR.msbfs_hop(rel, src, strategy=strategy, **kw)


def q_msbfs_hop(spark, d):
    return msbfs(spark, d, "outer")


def q_msbfs_hop_broadcast(spark, d):
    return msbfs(spark, d, "inner_broadcast")


def q_msbfs_hop_block(spark, d):
    mb, kb, nb = BLOCK
    return msbfs(spark, d, "block", mb=mb, kb=kb, nb=nb)


def q_msbfs_hop_row_dense(spark, d):
    return msbfs(spark, d, "row_dense")


# One shape contract: both operands declare less than they hold, and every
# strategy leaves the same entries out.
NARROW_COLS = 12           # declared columns of the right operand
SHAPED = {
    "outer": {}, "inner_broadcast": {}, "inner_cartesian": {}, "replicate": {}, "cogroup": {},
    "block": dict(zip(("mb", "kb", "nb"), BLOCK)), "row_dense": {}, "matvec": {}, "column_groups": {"h": GROUPS},
}


def out_of_shape(strategy):
    def q(spark, d):
        rows = TB.table(spark, d, "supplier").count() // 2
        inner = TB.table(spark, d, "orders").count() // 2
        left, right = Matrix(m_so(spark, d), rows, inner), Matrix(n_on(spark, d), inner, NARROW_COLS)
        return P.multiply(left, right, strategy, **SHAPED[strategy]).df.select("i", "j", "v")
    return q


_HALF = "(SELECT count(*) // 2 FROM {})"
SQL_OUT_OF_SHAPE = product_sql(
    f"SELECT * FROM ({SQL_M_SO}) WHERE i < {_HALF.format('supplier')} AND j < {_HALF.format('orders')}",
    f"SELECT * FROM ({SQL_N_ON}) WHERE i < {_HALF.format('orders')} AND j < {NARROW_COLS}")


# ------------------------------------------------------------ sources / sinks
def q_scan_coo_ragged(spark, d):
    # lines with a trailing space or a fourth field are good, and every
    # supplier adds lines that are not
    path = scratch_path(spark, "coo-ragged")
    line = TX.triple_line(integer_values=True)
    kind = F.pmod(F.xxhash64("i", "j"), F.lit(3))
    good = m_so(spark, d).select(F.concat(line, F.when(kind == 0, " ").when(kind == 1, " more").otherwise("")).alias("line"))
    bad = TB.table(spark, d, "supplier").select(F.explode(F.array(
        F.concat_ws(" ", "s_suppkey", F.lit("x"), F.lit("1.0")), F.col("s_suppkey").cast("string"),
        F.concat_ws(" ", F.lit("1"), "s_suppkey", F.lit("1,5")))).alias("line"))
    good.unionByName(bad).write.text(path)
    return TX.read_coo(spark, path, on_bad="drop")


def q_scan_coo(spark, d):
    path = scratch_path(spark, "coo")
    TX.write_coo(m_so(spark, d), path)
    return TX.read_coo(spark, path, partitions=8)


def q_scan_coo_header(spark, d):
    path = scratch_path(spark, "coo-header")
    TX.write_coo(m_so(spark, d), path, sep=",", header="m k v", integer_values=True)
    return TX.read_coo(spark, path, sep=",", header=True)


def q_scan_tagged(spark, d):
    path = scratch_path(spark, "tagged")
    TX.write_tagged(m_so(spark, d), n_on(spark, d), path)
    left, right = TX.read_tagged(spark, path)
    return left.withColumn("tag", F.lit("M")).unionByName(right.withColumn("tag", F.lit("N")))


def q_scan_edges(spark, d):
    path = scratch_path(spark, "edges")
    TX.write_edges(TB.part_supplier_edges(spark, d), path)
    return TX.read_edges(spark, path)


def q_scan_edges_unweighted(spark, d):
    path = scratch_path(spark, "edges-nw")
    TX.write_edges(TB.part_supplier_edges(spark, d), path, weighted=False)
    return GR.edges_unweighted(TX.read_edges(spark, path))


def q_scan_vertices(spark, d):
    path = scratch_path(spark, "vertices")
    TX.write_vertices(GR.vertex_set(TB.part_supplier_edges(spark, d)), path)
    return TX.read_vertices(spark, path)


def q_render_triples(spark, d):
    return TX.format_triples(m_so(spark, d), " ", integer_values=True)


def q_render_cells(spark, d):
    return DO.cell_docs(q_mm_outer(spark, d), integer_values=True)


def q_write_by_group(spark, d):
    # one job per column group, each into its own g=<group> folder
    path = scratch_path(spark, "by-group")
    P.write_column_groups(m_so(spark, d), n_on(spark, d), GROUPS, path)
    return TX.read_coo(spark, path).select("i", "j", "v", F.col("g").cast("int").alias("g"))


def _cogroup_from_docs(spark, d, broken: bool = False):
    path = scratch_path(spark, "docs")
    DO.write_docs(m_so(spark, d), n_on(spark, d), path)
    if broken:
        # every supplier adds documents that no operand can take
        key = F.col("s_suppkey").cast("string")
        TB.table(spark, d, "supplier").select(F.explode(F.array(
            F.concat(F.lit('{"i":'), key, F.lit(',"j":1')), F.concat(F.lit('{"i":'), key, F.lit(',"v":1.0}')),
            F.concat(F.lit('{"i":"'), key, F.lit('x","j":1,"v":2.0}')), F.concat(F.lit('{"j":'), key, F.lit(',"v":2.0}')),
        )).alias("line")).write.mode("append").text(path)
    left, right = DO.split_docs(DO.read_docs(spark, path, on_bad="drop" if broken else "error"))
    grouped = P.cogroup_documents(left, right)
    return DO.materialize(grouped, scratch_path(spark, "grouped"))


def q_cogroup_lists_bad(spark, d):
    return q_cogroup_lists(spark, d, broken=True)


def q_cogroup_lists(spark, d, broken: bool = False):
    g = _cogroup_from_docs(spark, d, broken)
    lsum = F.aggregate("left", F.lit(0.0), lambda a, e: a + e["v"])
    rsum = F.aggregate("right", F.lit(0.0), lambda a, e: a + e["w"])
    return g.groupBy(F.col("c").alias("j")).agg(
        F.sum(F.size("left")).cast("long").alias("n_left"),
        F.sum(lsum).alias("sum_left"),
        F.sum(F.size("right")).cast("long").alias("n_right"),
        F.sum(rsum).alias("sum_right"))


def q_json_lists(spark, d):
    g = _cogroup_from_docs(spark, d)
    lj = rj = DO.parse_grouped(DO.grouped_json(g))
    a = lj.select("j", F.explode("left").alias("e")).select(
        F.lit("L").alias("side"), "j", F.col("e.i").alias("a"), F.col("e.v").alias("v"))
    b = rj.select("j", F.explode("right").alias("e")).select(
        F.lit("R").alias("side"), "j", F.col("e.k").alias("a"), F.col("e.v").alias("v"))
    return a.unionByName(b)


# ------------------------------------------------------------ entry transforms
def q_transpose(spark, d):
    return EN.transpose(m_so(spark, d))


def q_symmetrize(spark, d):
    return GR.adjacency(TB.part_supplier_edges(spark, d), "double")


def q_symmetrize_once(spark, d):
    return GR.adjacency(TB.part_supplier_edges(spark, d), "once")


def q_dedupe_entries(spark, d):
    return EN.dedupe(TB.supplier_order_raw(spark, d), "sum")


def q_dedupe_last(spark, d):
    li = TB.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("i"), F.col("l_orderkey").alias("j"),
        F.col("l_quantity").alias("v"), "l_linenumber")
    return EN.dedupe(li, "last", order_col="l_linenumber")


def q_drop_zeros(spark, d):
    li = TB.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("i"), F.col("l_linenumber").cast("long").alias("j"),
        F.col("l_discount").alias("v"))
    return EN.drop_zeros(li)


def q_validate_shape(spark, d):
    n_rows = TB.table(spark, d, "supplier").count()
    n_cols = TB.table(spark, d, "orders").count()
    return EN.shape_stats(TB.supplier_order_raw(spark, d), n_rows, n_cols)


def q_column_groups(spark, d):
    return EN.column_groups(TB.order_customer(spark, d), GROUPS)


# ------------------------------------------------------------ layouts
def q_pack_rows(spark, d):
    p = LA.render_packed(LA.pack_rows(m_so(spark, d), SEGMENT))
    return p.select("i", "seg", F.size("idx").cast("long").alias("nnz"), "entries")


def q_pack_columns(spark, d):
    p = LA.render_packed(LA.pack_columns(m_so(spark, d), SEGMENT))
    return p.select("j", "seg", F.size("idx").cast("long").alias("nnz"), "entries")


def q_unpack_rows(spark, d):
    return LA.unpack_rows(LA.pack_rows(m_so(spark, d), SEGMENT))


def q_dense_column(spark, d):
    o = TB.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = TB.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    vec = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("i"), F.col("c_nationkey").cast("double").alias("v"))
    k = int(TB.table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]) + 1
    return LA.dense_column(spark, vec, k)


def q_block_stats(spark, d):
    mb, kb = STATS_BLOCK
    return LA.block_stats(m_so(spark, d), mb, kb)


def q_blocks_roundtrip(spark, d):
    mb, kb = STATS_BLOCK
    return LA.from_blocks(LA.to_blocks(TB.supplier_order_raw(spark, d), mb, kb))


# ------------------------------------------------------------ graph
def q_vertex_set(spark, d):
    return GR.vertex_set(TB.part_supplier_edges(spark, d))


def q_dense_ids(spark, d):
    return ids_of(spark, d)


def q_dense_ids_buckets(spark, d):
    # same numbering through many range buckets (the path large graphs take)
    edges = TB.part_supplier_edges(spark, d)
    return GR.dense_ids(GR.vertex_set(edges), ids_per_bucket=257)


def q_dense_ids_refined(spark, d):
    # rough cut points first: ranges that are too full are cut again
    edges = TB.part_supplier_edges(spark, d)
    return GR.dense_ids(GR.vertex_set(edges), ids_per_bucket=257, accuracy=4)


def q_relabel_edges(spark, d):
    edges = TB.part_supplier_edges(spark, d)
    return GR.relabel_edges(edges, GR.dense_ids(GR.vertex_set(edges)))


def q_sample_sources(spark, d):
    return GR.sample_sources(GR.vertex_set(TB.part_supplier_edges(spark, d)), BFS_SOURCES, BFS_SEED)


def q_relabel_sources(spark, d):
    ids = ids_of(spark, d)
    return GR.relabel_sources(GR.sample_sources(ids.select("id"), BFS_SOURCES, BFS_SEED), ids)


def q_random_sparse(spark, d):
    rows = TB.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return GE.random_sparse(rows, RANDOM_COLS, RANDOM_DENSITY, RANDOM_SEED)


def q_random_sparse_thin(spark, d):
    rows = TB.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return GE.random_sparse(rows, RANDOM_COLS, 0.004, RANDOM_SEED)


def q_random_sparse_full(spark, d):
    rows = TB.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return GE.random_sparse(rows, RANDOM_COLS, 1.0, RANDOM_SEED)


def _random_sql(density):
    """The entries of ``random_sparse`` over ``customer``."""
    want = density * RANDOM_COLS
    steps = ", ".join(map(str, GE.multipliers(RANDOM_COLS, RANDOM_SEED)))
    hx = "('0x' || substr({}, {}, {}))::BIGINT".format
    return (f"WITH h AS (SELECT c_custkey AS i, md5('{RANDOM_SEED}:' || CAST(c_custkey AS VARCHAR)) AS h FROM customer), "
            f"r AS (SELECT i, {int(want)} + CAST({hx('h', 1, 8)} < {int((want - int(want)) * (1 << 32))} AS BIGINT) AS n, "
            f"([{steps}])[({hx('h', 9, 4)} % 16 + 1)::INT] AS a, {hx('h', 13, 15)} % {RANDOM_COLS} AS b FROM h), "
            f"s AS (SELECT i, a, b, unnest(range(n)) AS t FROM r), "
            f"w AS (SELECT *, md5('{RANDOM_SEED}:' || CAST(i AS VARCHAR) || ':' || CAST(t AS VARCHAR)) AS v FROM s) "
            f"SELECT CAST(i AS BIGINT) AS i, CAST((a * t + b) % {RANDOM_COLS} AS BIGINT) AS j, "
            f"CAST({hx('v', 9, 4)} % 9 + 1 AS DOUBLE) AS v FROM w")


QUERIES: dict[str, QueryFn] = {
    # products (X1-X11)
    "mm_outer": q_mm_outer,
    "mm_outer_gram": q_mm_outer_gram,
    "mm_outer_salted": q_mm_outer_salted,
    "mm_cogroup_parts": q_mm_cogroup_parts,
    "mm_inner_segments": q_mm_inner_segments,
    "mm_block_fixed_k_cut": q_mm_block_fixed_k_cut,
    "relabel_edges_salted": q_relabel_edges_salted,
    "mm_inner_broadcast": q_mm_inner_broadcast,
    "mm_inner_cartesian": q_mm_inner_cartesian,
    "mm_replicate": q_mm_replicate,
    "mm_cogroup": q_mm_cogroup,
    "mm_block": q_mm_block,
    "mm_block_mid_splits": q_mm_block_mid_splits,
    "mm_block_fixed_k": q_mm_block_fixed_k,
    "mm_row_dense": q_mm_row_dense,
    "mm_matvec": q_mm_matvec,
    "mm_matvec_all": q_mm_matvec_all,
    "mm_replicate_cells": q_mm_replicate_cells,
    "mm_column_groups": q_mm_column_groups,
    **{f"mm_{name}_out_of_shape": out_of_shape(name) for name in SHAPED},
    "msbfs_hop": q_msbfs_hop,
    "msbfs_hop_broadcast": q_msbfs_hop_broadcast,
    "msbfs_hop_block": q_msbfs_hop_block,
    "msbfs_hop_row_dense": q_msbfs_hop_row_dense,
    "mm_outer_partitions": q_mm_outer_partitions,
    # sources and sinks
    "scan_coo": q_scan_coo,
    "scan_coo_header": q_scan_coo_header,
    "scan_coo_ragged": q_scan_coo_ragged,
    "scan_tagged": q_scan_tagged,
    "scan_edges": q_scan_edges,
    "scan_edges_unweighted": q_scan_edges_unweighted,
    "scan_vertices": q_scan_vertices,
    "render_triples": q_render_triples,
    "render_cells": q_render_cells,
    "write_by_group": q_write_by_group,
    "cogroup_lists": q_cogroup_lists,
    "cogroup_lists_bad": q_cogroup_lists_bad,
    "json_lists": q_json_lists,
    # entry transforms
    "transpose": q_transpose,
    "symmetrize": q_symmetrize,
    "symmetrize_once": q_symmetrize_once,
    "dedupe_entries": q_dedupe_entries,
    "dedupe_last": q_dedupe_last,
    "drop_zeros": q_drop_zeros,
    "validate_shape": q_validate_shape,
    "column_groups": q_column_groups,
    # layouts
    "pack_rows": q_pack_rows,
    "pack_columns": q_pack_columns,
    "unpack_rows": q_unpack_rows,
    "dense_column": q_dense_column,
    "block_stats": q_block_stats,
    "blocks_roundtrip": q_blocks_roundtrip,
    # graph preparation
    "vertex_set": q_vertex_set,
    "dense_ids": q_dense_ids,
    "dense_ids_buckets": q_dense_ids_buckets,
    "dense_ids_refined": q_dense_ids_refined,
    "relabel_edges": q_relabel_edges,
    "sample_sources": q_sample_sources,
    "relabel_sources": q_relabel_sources,
    "random_sparse": q_random_sparse,
    "random_sparse_thin": q_random_sparse_thin,
    "random_sparse_full": q_random_sparse_full,
}

_E = SQL_E_PS
_IDS = SQL_IDS.format(e=SQL_E_PS)
_SRC = sources_sql()
_RELABEL = (f"WITH {_SRC} SELECT a.dense AS src, b.dense AS dst, e.w AS w "
            f"FROM e JOIN ids a ON e.src = a.id JOIN ids b ON e.dst = b.id")
_REL_SOURCES = (f"WITH {_SRC} SELECT ids.dense AS i, src.col AS j, CAST(1 AS DOUBLE) AS v "
                f"FROM src JOIN ids ON src.vertex = ids.id")
_ADJ = "SELECT src AS i, dst AS j, w AS v FROM e UNION ALL SELECT dst AS i, src AS j, w AS v FROM e"
_ADJ_ONCE = ("SELECT src AS i, dst AS j, w AS v FROM e UNION ALL "
             "SELECT dst AS i, src AS j, w AS v FROM e WHERE src <> dst")
_PACK = ("WITH m AS ({m}) SELECT {k} AS {kn}, CAST({o} // {w} AS BIGINT) AS seg, COUNT(*) AS nnz, "
         "string_agg(CAST({o} AS VARCHAR) || ':' || CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY {o}) "
         "AS entries FROM m GROUP BY {k}, {o} // {w}")
_DOC_SUMMARY = (f"WITH l AS ({SQL_M_SO}), r AS ({SQL_N_ON}), "
                "la AS (SELECT j, COUNT(*) AS n, SUM(v) AS s FROM l GROUP BY j), "
                "ra AS (SELECT i AS j, COUNT(*) AS n, SUM(v) AS s FROM r GROUP BY i) "
                "SELECT COALESCE(la.j, ra.j) AS j, COALESCE(la.n, 0) AS n_left, "
                "COALESCE(la.s, 0) AS sum_left, COALESCE(ra.n, 0) AS n_right, "
                "COALESCE(ra.s, 0) AS sum_right FROM la FULL JOIN ra ON la.j = ra.j")

ORACLE: dict[str, str] = {
    "mm_outer": product_sql(SQL_M_SO, SQL_N_ON),
    **{f"mm_{name}_out_of_shape": SQL_OUT_OF_SHAPE for name in SHAPED},
    "mm_matvec_all": product_sql(SQL_M_SO, SQL_N_ON, nonzero=True),
    "mm_replicate_cells": product_sql(SQL_M_NO, SQL_N_ON, nonzero=True),
    "scan_coo_ragged": SQL_M_SO,
    "mm_outer_gram": product_sql(SQL_M_SO, transpose_sql(SQL_M_SO)),
    "mm_outer_salted": product_sql(SQL_M_SO, SQL_N_ON),
    "mm_cogroup_parts": product_sql(SQL_M_SO, SQL_N_ON),
    "mm_inner_segments": product_sql(SQL_M_NO, SQL_N_ON),
    "mm_block_fixed_k_cut": product_sql(SQL_M_SO, SQL_N_ON, nonzero=True),
    "mm_inner_broadcast": product_sql(SQL_M_SO, SQL_N_ON, nonzero=True),
    "mm_inner_cartesian": product_sql(SQL_M_NO, SQL_N_ON),
    "mm_replicate": product_sql(SQL_M_NO, SQL_N_ON, nonzero=True),
    "mm_cogroup": product_sql(SQL_M_SO, SQL_N_ON),
    "mm_block": product_sql(SQL_M_SO, SQL_N_OC, nonzero=True),
    "mm_block_mid_splits": product_sql(SQL_M_SO, SQL_N_OC, nonzero=True),
    "mm_block_fixed_k": product_sql(SQL_M_SO, SQL_N_ON, nonzero=True),
    "mm_row_dense": product_sql(transpose_sql(SQL_X_EMB), SQL_X_EMB, nonzero=True),
    "mm_matvec": (f"WITH l AS ({SQL_M_SO}), x AS ({SQL_VEC_ON}) SELECT l.i AS i, SUM(l.v * x.v) AS v "
                  f"FROM l JOIN x ON l.j = x.i GROUP BY l.i HAVING SUM(l.v * x.v) <> 0"),
    "mm_column_groups": product_sql(SQL_M_SO, SQL_N_ON, nonzero=True,
                                    select_extra=f", CAST(r.j % {GROUPS} AS INTEGER) AS g"),
    "msbfs_hop": (f"WITH {_SRC}, adj AS ({_ADJ}), "
                  f"n AS (SELECT ids.dense AS i, src.col AS j, CAST(1 AS DOUBLE) AS v "
                  f"FROM src JOIN ids ON src.vertex = ids.id), "
                  f"re AS (SELECT a.dense AS src, b.dense AS dst, e.w AS w "
                  f"FROM e JOIN ids a ON e.src = a.id JOIN ids b ON e.dst = b.id), "
                  f"adj2 AS (SELECT src AS i, dst AS j, w AS v FROM re UNION ALL "
                  f"SELECT dst AS i, src AS j, w AS v FROM re) "
                  f"SELECT adj2.i AS i, n.j AS j, SUM(adj2.v * n.v) AS v "
                  f"FROM adj2 JOIN n ON adj2.j = n.i GROUP BY adj2.i, n.j"),
    "scan_coo": SQL_M_SO,
    "scan_coo_header": SQL_M_SO,
    "scan_tagged": (f"SELECT i, j, v, 'M' AS tag FROM ({SQL_M_SO}) UNION ALL "
                    f"SELECT i, j, v, 'N' AS tag FROM ({SQL_N_ON})"),
    "scan_edges": SQL_E_PS,
    "scan_edges_unweighted": "SELECT l_partkey AS src, l_suppkey AS dst, CAST(1 AS DOUBLE) AS w FROM lineitem",
    "scan_vertices": f"WITH e AS ({_E}) SELECT src AS id FROM e UNION SELECT dst FROM e",
    "render_triples": (f"SELECT CAST(i AS VARCHAR) || ' ' || CAST(j AS VARCHAR) || ' ' || "
                       f"CAST(CAST(v AS BIGINT) AS VARCHAR) AS line FROM ({SQL_M_SO})"),
    "render_cells": (f"SELECT CAST(i AS VARCHAR) || ',' || CAST(j AS VARCHAR) AS _id, "
                     f"CAST(v AS BIGINT) AS value FROM ({product_sql(SQL_M_SO, SQL_N_ON)})"),
    "write_by_group": product_sql(SQL_M_SO, SQL_N_ON, nonzero=True,
                                  select_extra=f", CAST(r.j % {GROUPS} AS INTEGER) AS g"),
    "cogroup_lists": _DOC_SUMMARY,
    "cogroup_lists_bad": _DOC_SUMMARY,
    "json_lists": (f"SELECT 'L' AS side, j, i AS a, v FROM ({SQL_M_SO}) UNION ALL "
                   f"SELECT 'R' AS side, i AS j, j AS a, v FROM ({SQL_N_ON})"),
    "transpose": transpose_sql(SQL_M_SO),
    "symmetrize": f"WITH e AS ({_E}) {_ADJ}",
    "symmetrize_once": f"WITH e AS ({_E}) {_ADJ_ONCE}",
    "dedupe_entries": SQL_M_SO,
    "dedupe_last": ("SELECT l_suppkey AS i, l_orderkey AS j, "
                    "arg_max(l_quantity, {'o': l_linenumber, 'v': l_quantity}) AS v "
                    "FROM lineitem GROUP BY l_suppkey, l_orderkey"),
    "drop_zeros": ("SELECT l_orderkey AS i, CAST(l_linenumber AS BIGINT) AS j, l_discount AS v "
                   "FROM lineitem WHERE l_discount <> 0"),
    "validate_shape": (f"SELECT COUNT(*) AS nnz, MIN(i) AS min_i, MAX(i) AS max_i, MIN(j) AS min_j, "
                       f"MAX(j) AS max_j, CAST(COUNT(*) FILTER (WHERE NOT (i >= 0 AND j >= 0 AND "
                       f"i < (SELECT COUNT(*) FROM supplier) AND j < (SELECT COUNT(*) FROM orders))) "
                       f"AS BIGINT) AS outside FROM ({SQL_M_RAW})"),
    "column_groups": (f"SELECT i, j, v, CAST(j % {GROUPS} AS INTEGER) AS g, "
                      f"CAST(j // {GROUPS} AS BIGINT) AS c FROM ({SQL_N_OC})"),
    "pack_rows": _PACK.format(m=SQL_M_SO, k="i", kn="i", o="j", w=SEGMENT),
    "pack_columns": _PACK.format(m=SQL_M_SO, k="j", kn="j", o="i", w=SEGMENT),
    "unpack_rows": SQL_M_SO,
    "dense_column": (f"WITH x AS ({SQL_VEC_ON}) SELECT r.range AS i, COALESCE(x.v, 0) AS v "
                     f"FROM range((SELECT MAX(o_orderkey) + 1 FROM orders)) r "
                     f"LEFT JOIN x ON r.range = x.i"),
    "block_stats": (f"SELECT CAST(i // {STATS_BLOCK[0]} AS BIGINT) AS bi, "
                    f"CAST(j // {STATS_BLOCK[1]} AS BIGINT) AS bj, COUNT(*) AS nnz, SUM(v) AS total "
                    f"FROM ({SQL_M_SO}) GROUP BY 1, 2"),
    "blocks_roundtrip": SQL_M_SO,
    "vertex_set": f"WITH e AS ({_E}) SELECT src AS id FROM e UNION SELECT dst FROM e",
    "dense_ids": _IDS,
    "dense_ids_buckets": _IDS,
    "dense_ids_refined": _IDS,
    "relabel_edges": _RELABEL,
    "relabel_edges_salted": _RELABEL,
    "sample_sources": f"WITH {_SRC} SELECT vertex, col FROM src",
    "relabel_sources": _REL_SOURCES,
    "random_sparse": _random_sql(RANDOM_DENSITY),
    "random_sparse_thin": _random_sql(0.004),
    "random_sparse_full": _random_sql(1.0),
}
# the same cells by other strategies
ORACLE["mm_outer_partitions"] = ORACLE["mm_outer"]
ORACLE.update({f"msbfs_hop_{s}": ORACLE["msbfs_hop"] for s in ("broadcast", "block", "row_dense")})
