"""Embedding near-duplicates through a pivot-permutation index.

Every vector is described by the ``prefix`` nearest of a set of reference
vectors (pivots), in order of nearness.  Inverted lists, one for each pivot
(and label), hold the vectors that have the pivot in their prefix.  Two
vectors are candidates if they share at least ``SHARED`` = 2 pivots: a list is
merged with all others by cutting it into sub-lists by a second pivot, so
that a pair meets once for every two pivots it shares and pairs of one shared
pivot never meet.  A candidate is verified by its cosine in double precision.

* Pivots: about ``PIVOTS_PER_ROOT * sqrt(n)`` and at most ``MAX_PIVOTS``, so
  lists grow with the square root of the table.  They are spread over space:
  from a sample of ``OVERSAMPLE`` times as many vectors, chosen by a hash of
  their id, the one farthest from all pivots is taken next, until the rest is
  within ``SPREAD`` link angles of one.  A dense group so holds few pivots,
  and all its members have those in their prefix; vectors that merely share a
  direction still get as many pivots as asked for.
* Copies (same label, same vector) are one node and never form pairs.
* A list of more than ``LIST_BLOCK`` vectors is cut into blocks, and every
  pair of blocks is a task of its own, so no hot list meets in one task.
* A pair belongs to the sub-list of the two smallest pivots it shares.  Large
  sub-lists leave out vectors that share a smaller one, so a dense group is
  compared once, not once for every two of its pivots; what is found is
  counted only by its owner.  Tasks return counts and a spanning forest of
  the links they find, not the links.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut
from tessella.llm.components import connected_components, union_find

COSINE = 0.98
PIVOTS_PER_ROOT = 4.0
MAX_PIVOTS = 8192
OVERSAMPLE = 2
SPREAD = 1
PREFIX = 6
SHARED = 2
LIST_BLOCK = 2048
SMALL_LIST = 64         # vectors of a sub-list whose pairs are written out


def nodes_of(vectors: DataFrame) -> DataFrame:
    """Distinct usable vectors ``(label, v, node, copies)``: label and vector
    not null, no null or non-finite component, not zero."""
    ok = (F.col("label").isNotNull() & F.col("embedding").isNotNull()
          & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)
                     & (F.abs(x.cast("double")) < float("inf")))
          & F.exists("embedding", lambda x: x != 0))
    v = F.transform("embedding", lambda x: x.cast("double"))
    return (vectors.where(F.coalesce(ok, F.lit(False))).select("vec_id", "label", v.alias("v"))
            .groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
            .withColumn("node", F.xxhash64("label", "v")))


def unit(rows):
    """Rows scaled to length 1; scaled by their largest part first, so that
    neither very large nor very small parts lose the length."""
    import numpy as np

    x = rows / np.abs(rows).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(column):
    """Arrow list column -> 2-d float64 array (equal lengths)."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def spread(sample, wanted: int, cosine: float):
    """At most ``wanted`` rows of ``sample`` (unit length), farthest first,
    until every row is within ``SPREAD`` times the angle of ``cosine`` of one."""
    import numpy as np

    x = sample.astype(np.float32)
    angle = SPREAD * math.acos(max(-1.0, min(1.0, cosine)))
    enough = math.cos(min(angle, math.pi / 2))
    taken, nearest = [0], x @ x[0]
    while len(taken) < wanted:
        i = int(nearest.argmin())
        if nearest[i] >= enough:
            break
        taken.append(i)
        np.maximum(nearest, x @ x[i], out=nearest)
    return sample[taken]


def prefixes(nodes: DataFrame, pivots, prefix: int) -> DataFrame:
    """Adds ``near``: numbers of the nearest pivots, nearest first (ties: the
    smaller number)."""

    def run(batches):
        import numpy as np

        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                x = unit(matrix(part.column(2)))
                d = -(x @ pivots.T)
                near = np.argsort(d, axis=1, kind="stable")[:, :prefix]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))],
                    ["node", "label", "v", "copies", "near"])

    kind = nodes.schema["label"].dataType.simpleString()
    return nodes.select("node", "label", "v", "copies").mapInArrow(
        run, f"node long, label {kind}, v array<double>, copies long, near array<int>")


class owners:
    """The two smallest pivots that vectors ``i`` and ``j`` share, compared
    with a list and its sub-lists; with one pivot in all, that one twice."""

    def __init__(self, near, i, j):
        import numpy as np

        mine, none = near[i], np.iinfo(np.int32).max
        shared = np.where((mine[:, :, None] == near[j][:, None, :]).any(2), mine, none)
        shared.sort(axis=1)
        self.first, self.second = shared[:, 0], shared[:, min(1, shared.shape[1] - 1)]

    def __eq__(self, place):
        return (self.first == place[0]) & (self.second == place[1])


def candidate_pairs(near, mine, pivot: int, x: int, y: int, v, cosine: float):
    """Yields ``(i, j, second)``: pairs of vectors of one list (sorted
    prefixes ``near``) that also share the pivot ``second``, one of block
    ``x`` and the other of block ``y``; pairs of large sub-lists only if a
    product of matrices finds them close."""
    import numpy as np

    width = near.shape[1]
    if width == 1:                                   # one pivot in all
        rows, seconds = np.arange(len(near)), np.full(len(near), pivot, np.int32)
    else:
        rows, at = np.nonzero(near > pivot)
        seconds = near[rows, at]
    order = np.lexsort((rows, seconds))
    rows, seconds = rows[order], seconds[order]
    first = np.flatnonzero(np.append(True, seconds[1:] != seconds[:-1])) if len(rows) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(rows)))
    # small sub-lists: all their pairs, many lists at a time
    small = np.flatnonzero((size > 1) & (size <= SMALL_LIST))
    ends = np.cumsum(size[small] * size[small])
    lo = 0
    while lo < len(small):
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 400_000, side="right")), lo + 1)
        n, start = size[small[lo:hi]], first[small[lo:hi]]
        of = np.repeat(np.arange(len(n)), n * n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n * n) - n * n, n * n)
        a, b = start[of] + k // n[of], start[of] + k % n[of]
        i, j = rows[a], rows[b]
        keep = (mine[i] == x) & (mine[j] == y) & ((i < j) if x == y else True)
        yield i[keep], j[keep], seconds[a[keep]]
        lo = hi
    for f, n in zip(first[size > SMALL_LIST], size[size > SMALL_LIST]):
        members, second = rows[f:f + n], int(seconds[f])
        # the smallest other pivot, if it comes before ``second``: vectors
        # with the same one have an owner elsewhere
        low = near[members, 0]
        if width > 1:
            low = np.where(low == pivot, near[members, 1], low)
        tag = np.where((low < second) & (low != pivot), low, -1)
        for t in np.unique(tag):
            left = members[(tag == t) & (mine[members] == x)]
            right = members[((tag != t) | (t == -1)) & (mine[members] == y)]
            for lo in range(0, len(left), 256):
                a = left[lo:lo + 256]
                close = v[a] @ v[right].T >= cosine - 1e-9
                if x == y:
                    close &= a[:, None] < right[None, :]
                i, j = np.nonzero(close)
                yield a[i], right[j], np.full(len(i), second, np.int32)


def links(spark: SparkSession, described: DataFrame, cosine: float) -> DataFrame:
    """``(a, b, n)``: for each node found in a task the root of its set there
    and the number of vectors it links to there (copies counted)."""
    listed = described.withColumn("pivot", F.explode("near"))
    sizes = listed.groupBy("label", "pivot").agg(F.count("*").alias("n")).where("n > 1").select(
        "label", "pivot", F.ceil(F.col("n") / LIST_BLOCK).cast("int").alias("blocks"))
    mine = (F.pmod("node", F.col("blocks"))).cast("int")
    # block pair (x, y), x <= y; a vector goes to all pairs its block is in
    pairs = F.expr("transform(sequence(0, blocks - 1), k -> struct(least(k, mine) as x, greatest(k, mine) as y))")
    dealt = (listed.join(sizes, ["label", "pivot"]).withColumn("mine", mine)
             .withColumn("p", F.explode(pairs))
             .select("label", "pivot", "p.x", "p.y", "mine", "node", "v", "copies", "near"))

    def run(key, table):
        import numpy as np

        pivot, x, y = key[1].as_py(), key[2].as_py(), key[3].as_py()
        table = table.sort_by("node")
        node = table.column("node").to_numpy()
        copies = table.column("copies").to_numpy()
        mine = table.column("mine").to_numpy()
        v = unit(matrix(table.column("v").combine_chunks()))
        near = np.sort(table.column("near").combine_chunks().flatten().to_numpy().reshape(len(node), -1), axis=1)
        union, roots = union_find(len(node))
        count = np.zeros(len(node), np.int64)
        for p, q, second in candidate_pairs(near, mine, pivot, x, y, v, cosine):
            for s in range(0, len(p), 100_000):
                i, j, k = p[s:s + 100_000], q[s:s + 100_000], second[s:s + 100_000]
                cos = (v[i] * v[j]).sum(1)
                i, j, k = (z[cos >= cosine] for z in (i, j, k))
                owned = owners(near, i, j) == (pivot, k) if len(i) else np.zeros(0, bool)
                i, j = i[owned], j[owned]
                np.add.at(count, i, copies[j])
                np.add.at(count, j, copies[i])
                union(i, j)
        root = roots()
        hit = np.flatnonzero(count > 0)
        return pa.table({"a": pa.array(node[hit]), "b": pa.array(node[root[hit]]), "n": pa.array(count[hit])})

    return dealt.groupBy("label", "pivot", "x", "y").applyInArrow(run, "a long, b long, n long")


def near_duplicates(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE,
                    prefix: int = PREFIX) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors``.

    Rows link within a label at cosine >= ``cosine``.  Rows whose label or
    vector is null, zero or holds null or non-finite parts link with nothing.
    Rows with equal vectors and labels link with each other (repeated rows,
    too).  Vectors of different lengths never link.  An empty table gives no
    rows; further columns are ignored.
    """
    rows = vectors.select("vec_id", "label", "embedding")
    nodes = cut(spark, nodes_of(rows))
    sizes = [(r["d"], r["n"]) for r in nodes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()]
    import numpy as np

    found = None
    for d, n in sorted(sizes):          # one entry per vector length
        same = nodes.where(F.size("v") == d)
        wanted = int(min(max(math.ceil(PIVOTS_PER_ROOT * math.sqrt(n)), prefix), MAX_PIVOTS, n))
        # at most OVERSAMPLE * MAX_PIVOTS vectors
        sample = [r["v"] for r in same.orderBy(F.xxhash64(F.lit(11), "node"), "node").limit(OVERSAMPLE * wanted).collect()]
        pivots = spread(unit(np.array(sample)), wanted, cosine)
        described = prefixes(same, pivots, min(prefix, len(pivots)))
        part = links(spark, described, cosine)
        found = part if found is None else found.unionAll(part)
    as_node = nodes.select(F.col("label").alias("l2"), "v", "node")
    v = F.transform("embedding", lambda x: x.cast("double"))
    keyed = (rows.select("vec_id", "label", v.alias("w"))
             .join(as_node, (F.col("label") == F.col("l2")) & (F.col("w") == F.col("v")), "left")
             .select("vec_id", "node"))
    if found is None:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"),
                            F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(spark, found)
    n_links = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    labels = connected_components(spark, found.select("a", "b"))
    named = (nodes.select("node", "least", "copies").join(n_links, "node", "left")
             .join(labels, "node", "left")
             .select("node", "least", "copies", F.coalesce("n", F.lit(0)).alias("n"),
                     F.coalesce("root", "node").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    facts = named.join(least, "root").select("node", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component")
    return (keyed.join(facts, "node", "left")
            .withColumn("component_id", F.coalesce("component", "vec_id"))
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
                    F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def oracle(cosine: float = COSINE) -> str:
    """DuckDB SQL with the rows of ``near_duplicates``, all pairs compared
    (ids not repeated)."""
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {cosine}),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN l ON l.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
"""
