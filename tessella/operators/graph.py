"""Graph preparation for multi-source BFS: vertex sets, dense ids,
relabelling, source sampling, and one BFS hop as a sparse product.

Edges are ``(src LONG, dst LONG, w DOUBLE)``; vertices ``(id LONG)``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.guards import MAX_BROADCAST_ROWS, rows_at_most
from tessella.plans.skew import JOIN_ROWS_PER_TASK, split_join

# Target ids per range bucket when numbering ids densely.
IDS_PER_BUCKET = 2_000_000


def edges_unweighted(edges: DataFrame) -> DataFrame:
    """Edges without a weight get weight 1."""
    w = F.col("w") if "w" in edges.columns else F.lit(None).cast("double")
    return edges.select("src", "dst", F.coalesce(w.cast("double"), F.lit(1.0)).alias("w"))


def vertex_set(edges: DataFrame) -> DataFrame:
    """Distinct endpoints ``(id)`` in one scan of the edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


ACCURACY = 10_000     # of the first cut points: buckets are off by at most n / ACCURACY


def _bucketed(ids: DataFrame, cuts: list[float]) -> DataFrame:
    """``(id, b)``: the id's range by binary search; bucketing the id's double
    value is monotone, so bucket order is id order even past 2^53."""
    from pyspark.ml.feature import Bucketizer

    if not cuts:
        return ids.select("id", F.lit(0).alias("b"))
    splits = [float("-inf")] + cuts + [float("inf")]
    return (Bucketizer(splits=splits, inputCol="_x", outputCol="_b")
            .transform(ids.withColumn("_x", F.col("id").cast("double")))
            .select("id", F.col("_b").cast("int").alias("b")))


def _quantiles(n: int) -> list[float]:
    return [q / n for q in range(1, n)]


def id_cuts(ids: DataFrame, n: int, ids_per_bucket: int, accuracy: int = ACCURACY) -> list[float]:
    """Cut points that leave no range with more than ``ids_per_bucket`` of the
    ``n`` distinct ids, however rough the quantiles are: every range above
    the bound gets cut points of its own, from its own ids, until none is.
    The driver sees cut points and the counts of ranges that are too full."""
    buckets = math.ceil(n / ids_per_bucket)
    if buckets == 1:
        return []
    first = ids.agg(F.percentile_approx("id", _quantiles(buckets), accuracy)).first()[0]
    cuts = sorted(set(float(c) for c in first))
    while True:
        full = (_bucketed(ids, cuts).groupBy("b").agg(F.count(F.lit(1)).alias("nb"))
                .where(F.col("nb") > ids_per_bucket).collect())
        if not full:
            return cuts
        parts = max(2 * math.ceil(r["nb"] / ids_per_bucket) for r in full)
        inner = (_bucketed(ids, cuts).where(F.col("b").isin([r["b"] for r in full])).groupBy("b")
                 .agg(F.percentile_approx("id", _quantiles(parts), max(accuracy, 4 * parts)).alias("c")))
        more = {float(c) for r in inner.collect() for c in r["c"]} - set(cuts)
        if not more:      # ids that are one number as doubles stay together
            return cuts
        cuts = sorted(set(cuts) | more)


def dense_ids(vertices: DataFrame, col: str = "id", ids_per_bucket: int = IDS_PER_BUCKET,
              accuracy: int = ACCURACY) -> DataFrame:
    """Number distinct ids ``0..n-1`` in ascending numeric order:
    ``(id, dense)``.

    A global ``row_number`` would pull every id through one task.  Instead:
    cut points (``id_cuts``) give ranges of at most ``ids_per_bucket`` ids,
    each id gets its range by binary search, ids are numbered inside their
    range (one sort each), and every range's offset is the count of ids in
    lower ranges (a row per range, broadcast).  Equal to ``dense_rank() - 1``.

    The distinct ids are read several times (count, cut points, numbering), so
    they are checkpointed once to the shared checkpoint folder: one shuffle
    of the input, and lineage cut for executor loss.  The numbered table is
    checkpointed too, since every relabelling join reads it.  With at most
    ``ids_per_bucket`` ids there is one range and one sort.
    """
    from tessella.session import checkpoint_dir

    checkpoint_dir(vertices.sparkSession)
    ids = vertices.select(F.col(col).cast("long").alias("id")).distinct().checkpoint(eager=True)
    n = ids.count()
    if n == 0:
        return ids.withColumn("dense", F.lit(0).cast("long")).limit(0)
    cuts = id_cuts(ids, n, ids_per_bucket, accuracy)
    if not cuts:
        # one range: a single sort, no offsets needed
        w = Window.orderBy("id")
        return (ids.select("id", (F.row_number().over(w) - 1).cast("long").alias("dense"))
                   .checkpoint(eager=True))
    bucketed = _bucketed(ids, cuts).repartition("b")
    counts = bucketed.groupBy("b").agg(F.count(F.lit(1)).alias("nb"))
    offsets = counts.select("b", (F.sum("nb").over(Window.orderBy("b")) - F.col("nb")).alias("off"))
    ranked = bucketed.withColumn("rn", F.row_number().over(Window.partitionBy("b").orderBy("id")))
    # the numbered table is read by every later lookup: write it once
    return (ranked.join(F.broadcast(offsets), "b")
                  .select("id", (F.col("off") + F.col("rn") - 1).cast("long").alias("dense"))
                  .checkpoint(eager=True))


def _lookup(df: DataFrame, key: str, ids: DataFrame, out: str,
            rows_per_task: int | None, spread: list[str]) -> DataFrame:
    table = ids.select(F.col("id").alias(key), F.col("dense").alias(out))
    return split_join(df, table, key, spread, [out], rows_per_task).drop(key)


def relabel_edges(edges: DataFrame, ids: DataFrame,
                  rows_per_task: int | None = JOIN_ROWS_PER_TASK) -> DataFrame:
    """Both endpoints replaced by dense ids; weight kept.  Two equi-joins
    with the id table; a hub endpoint is split over tasks (AQE skew join,
    or an explicit salt grid with ``rows_per_task``)."""
    e = edges.select("src", "dst", "w")
    a = _lookup(e, "src", ids, "_s", rows_per_task, ["dst", "w"])
    b = _lookup(a, "dst", ids, "_d", rows_per_task, ["_s", "w"])
    return b.select(F.col("_s").alias("src"), F.col("_d").alias("dst"), "w")


def relabel_sources(sources: DataFrame, ids: DataFrame,
                    max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Sampled sources ``(vertex, col)`` -> right-matrix entries
    ``(i = dense id, j = col, v = 1.0)``.

    A source that is not a known vertex is an error, as the reference's
    dictionary lookup fails: ``KeyError`` from this call, whatever the sizes.
    A source table proven small is broadcast and looked up in one map-side
    pass over the id table (no shuffle of it), a larger one is joined by a
    shuffle; either way the result, one row per known source, is checkpointed
    and compared with the source count.
    """
    from tessella.session import checkpoint_dir

    checkpoint_dir(ids.sparkSession)
    s = sources.select(F.col("vertex").cast("long").alias("vertex"), F.col("col").cast("long").alias("col"))
    table = ids.select(F.col("id").alias("vertex"), "dense")
    small = rows_at_most(s, max_broadcast_rows)
    found = (table.join(F.broadcast(s) if small else s, "vertex")
                  .select(F.col("dense").alias("i"), F.col("col").alias("j"), F.lit(1.0).alias("v"))
                  .checkpoint(eager=True))
    if found.count() != s.count():
        missing = s.join(table, "vertex", "left_anti").orderBy("vertex").limit(5).collect()
        raise KeyError("source vertex without an id: " + ", ".join(str(r["vertex"]) for r in missing))
    return found


def seeded_hash(seed: str, *cols) -> F.Column:
    """Hex md5 of ``seed:c1:c2..``; the same string in DuckDB's md5()."""
    parts = [F.lit(seed)]
    for c in cols:
        parts += [F.lit(":"), (F.col(c) if isinstance(c, str) else c).cast("string")]
    return F.md5(F.concat(*parts))


def sample_sources(vertices: DataFrame, c: int = 100, seed: str = "bfs") -> DataFrame:
    """``c`` distinct BFS sources, each with its own column ``0..c-1``:
    ``(vertex, col)``, ordered by vertex.

    Sampling is a seeded hash order (retries and the SQL oracle see the same
    sample): the ``c`` vertices with the smallest ``md5(seed:pick:id)`` are
    chosen (a top-k, each task keeps only ``c`` rows), and their columns are
    the rank of ``md5(seed:col:id)`` among them, a random permutation of
    ``0..c-1``.  Fewer than ``c`` distinct vertices fail the job.
    """
    v = vertices.select(F.col("id").cast("long").alias("vertex")).distinct()
    chosen = (v.withColumn("_h", seeded_hash(seed + ":pick", "vertex"))
               .orderBy("_h", "vertex").limit(c).drop("_h"))
    # one row of at most ``c`` vertices, also when there are none at all
    order = F.struct(seeded_hash(seed + ":col", "vertex").alias("h"), "vertex")
    all_ = chosen.agg(F.array_sort(F.collect_list(order)).alias("p"))
    said = F.concat(F.lit(f"{c} sources asked of "), F.size("p").cast("string"), F.lit(" vertices"))
    enough = F.when(F.size("p") == c, True).otherwise(F.raise_error(said).cast("boolean"))
    return (all_.where(enough).select(F.posexplode("p").alias("col", "x"))
            .select("x.vertex", F.col("col").cast("long").alias("col")).orderBy("vertex"))


def adjacency(edges: DataFrame, self_loops: str = "double") -> DataFrame:
    """Undirected adjacency matrix entries from an edge list."""
    from tessella.operators.entries import symmetrize

    return symmetrize(edges.select(F.col("src").alias("i"), F.col("dst").alias("j"),
                                   F.col("w").alias("v")), self_loops)


def msbfs_hop(edges: DataFrame, sources: DataFrame, *, strategy: str = "outer",
              self_loops: str = "double", **kw) -> DataFrame:
    """One hop of multi-source BFS: ``sym(edges) x sources``.

    ``sources`` are right-matrix entries ``(i = vertex, j = source column,
    v)``; cell ``(u, s)`` is the weight of edges between ``u`` and source
    ``s`` (self-loops counted twice under the default)."""
    from tessella.plans.products import mm

    return mm(adjacency(edges, self_loops), sources, strategy, **kw)
