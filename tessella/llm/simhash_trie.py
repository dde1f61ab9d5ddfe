"""SimHash near-dedup by a binary-trie self-join.

Fingerprints are the leaves of a binary trie over their bits.  The self-join
walks *pairs* of trie nodes together, adds up the levels at which the two
paths took different bits and drops a pair as soon as the Hamming budget is
exceeded, so whole subtrees that cannot match are never opened.

Distribution: two fingerprints within ``d`` differing bits agree on at least
one of ``d + 1`` equal slices.  So the trie is built once per slice with that
slice rotated to the top, and only node pairs *equal* on the top slice are
handed on: each (slice, value) subtree is joined with itself by one task.
A subtree with more than ``hot_rows`` fingerprints is cut further by the same
argument applied to the remaining bits.  No pair within the budget is lost.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut, text_bytes, worker_release
from tessella.llm.components import connected_components, union_find

BITS = 64
HASH_SEED = 42
NO_ID = (1 << 63) - 1  # stands for a null id: such rows come last
LEAF = 8          # node pairs with at most this many fingerprint pairs are compared directly
FRONTIER = 1 << 19  # node pairs opened at a time: bounds a task's memory


def text_fingerprint(text: bytes, shingle: int) -> int:
    """Majority-vote fingerprint of one UTF-8 text (see ``fingerprints``)."""
    import numpy as np
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(len(words) - shingle + 1, 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[-n:] - 1).tolist()
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, n, 65536):  # bounded memory for very long texts
        h = np.array([digest(joined[s:e], HASH_SEED) for s, e in
                      zip(starts[lo:lo + 65536], stops[lo:lo + 65536])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, fp)`` per row: 64-bit SimHash of each whole text.

    A-Z are lower-cased, words are runs outside space and U+0009..U+000D,
    shingles are ``shingle`` words joined by one space with repeats (a
    shorter text is one shingle, a text without words has fingerprint 0); a
    bit is set if more than half of the shingles' XXH64 values have it.  A
    null text counts as empty.  ``text_key`` tells repeated ids apart.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
                       text_bytes(text_col).alias("t"))

    def run(batches):
        import numpy as np

        worker_release()
        for b in batches:
            fp = np.fromiter((text_fingerprint(t, shingle) for t in b.column(2).to_pylist()),
                             np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(fp.view(np.int64))],
                ["doc_id", "text_key", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


def trie_pairs(values, groups, first_bit: int, budget: int):
    """Yield index arrays ``(x, y)`` of the pairs within ``budget`` bits.

    ``values``: uint64 sorted within each of the ``groups`` ((lo, hi) arrays
    of index ranges, each one subtree whose paths agree before
    ``first_bit``, counted from the top).  A node is a range of the sorted
    array; its children meet at the first value with the next bit set.
    """
    import numpy as np

    lo, hi = groups
    todo = [(first_bit, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while todo:
        bit, l1, h1, l2, h2, err = todo.pop()
        if len(l1) > FRONTIER:
            half = len(l1) // 2
            todo.append((bit, l1[half:], h1[half:], l2[half:], h2[half:], err[half:]))
            todo.append((bit, l1[:half], h1[:half], l2[:half], h2[:half], err[:half]))
            continue
        small = ((h1 - l1) * (h2 - l2) <= LEAF) | (bit == BITS)
        if small.any():
            a, b, n, m = l1[small], l2[small], (h1 - l1)[small], (h2 - l2)[small]
            each = n * m
            at = np.repeat(np.arange(len(a)), each)
            k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            x, y = a[at] + k // m[at], b[at] + k % m[at]
            near = (x < y) & (np.bitwise_count(values[x] ^ values[y]) <= budget)
            if near.any():
                yield x[near], y[near]
            keep = ~small
            l1, h1, l2, h2, err = l1[keep], h1[keep], l2[keep], h2[keep], err[keep]
        if not len(l1):
            continue
        m1, m2 = _middle(values, l1, h1, bit), _middle(values, l2, h2, bit)
        same = l1 == l2
        cross = np.ones(len(l1), bool)
        parts = []
        for (a, b, c, d, cost, which) in (
                (l1, m1, l2, m2, 0, cross), (m1, h1, m2, h2, 0, cross),
                (l1, m1, m2, h2, 1, cross), (m1, h1, l2, m2, 1, ~same)):
            ok = which & (b > a) & (d > c) & (err + cost <= budget)
            parts.append((a[ok], b[ok], c[ok], d[ok], (err + cost)[ok].astype(np.int8)))
        todo.append((bit + 1, *(np.concatenate(x) for x in zip(*parts))))


def _middle(values, lo, hi, bit):
    """First index in [lo, hi) whose bit is set (binary search, all at once)."""
    import numpy as np

    lo, hi = lo.copy(), hi.copy()
    shift = np.uint64(BITS - 1 - bit)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        one = open_ & ((values[np.minimum(mid, len(values) - 1)] >> shift) & np.uint64(1)).astype(bool)
        hi = np.where(one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def _slices(budget: int, first: int, last: int):
    """(start, width) of ``budget + 1`` slices that cover bits [first, last)."""
    n = budget + 1
    cuts = [first + (last - first) * k // n for k in range(n + 1)]
    return [(cuts[k], cuts[k + 1] - cuts[k]) for k in range(n)]


def _rotate(col, left: int):
    left %= BITS
    if left == 0:
        return col
    return F.shiftleft(col, left).bitwiseOR(F.shiftrightunsigned(col, BITS - left))


def _top(col, start: int, width: int):
    return F.shiftrightunsigned(F.shiftleft(col, start), BITS - width)


def linked_fingerprints(spark: SparkSession, distinct: DataFrame, budget: int,
                        hot_rows: int = 1 << 20) -> DataFrame:
    """Edges ``(a, b)`` that connect all of ``distinct(fp)`` within ``budget``
    bits: each task returns a spanning forest of the pairs it finds."""
    subtrees = None
    for k, (start, width) in enumerate(_slices(budget, 0, BITS)):
        v = _rotate(F.col("fp"), start)
        part = distinct.select(F.lit(k).alias("slice"), F.lit(start).alias("turn"),
                               F.lit(width).alias("depth"), v.alias("v"),
                               _top(v, 0, width).alias("k1"))
        subtrees = part if subtrees is None else subtrees.unionAll(part)
    subtrees = subtrees.withColumn("k2", F.lit(-1).cast("long")).withColumn("sub", F.lit(-1))
    # at most (budget + 1) * 2^16 keys: the table of hot ones is bounded
    hot = F.broadcast(subtrees.groupBy("slice", "k1").count()
                      .where(F.col("count") > hot_rows).select("slice", "k1", F.lit(True).alias("hot")))
    width = BITS // (budget + 1)
    inner = F.array(*[F.struct(F.lit(j).alias("sub"), _top(F.col("v"), s, w).alias("k2"))
                      for j, (s, w) in enumerate(_slices(budget, width, BITS))])
    marked = subtrees.join(hot, ["slice", "k1"], "left")
    cut_again = (marked.where("hot").drop("sub", "k2").select("*", F.explode(inner).alias("c"))
                 .select("slice", "turn", "depth", "v", "k1", "c.k2", "c.sub"))
    keyed = (marked.where("hot is null").select("slice", "turn", "depth", "v", "k1", "k2", "sub")
             .unionAll(cut_again).repartition("slice", "k1", "sub", "k2")
             .select("slice", "turn", "depth", "v", "k1", "sub", "k2"))

    def run(batches):
        import numpy as np

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        sl, turn, depth, v, k1, sub, k2 = (t.column(i).to_numpy() for i in range(7))
        v = v.view(np.uint64)
        order = np.lexsort((v, k2, sub, k1, sl))
        sl, turn, depth, v, k1, sub, k2 = (x[order] for x in (sl, turn, depth, v, k1, sub, k2))
        new = np.ones(len(v), bool)
        new[1:] = ((sl[1:] != sl[:-1]) | (k1[1:] != k1[:-1]) | (sub[1:] != sub[:-1]) | (k2[1:] != k2[:-1]))
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(v))
        union, roots = union_find(len(v))
        for d in np.unique(depth):
            many = (hi - lo > 1) & (depth[lo] == d)
            for x, y in trie_pairs(v, (lo[many], hi[many]), int(d), budget):
                union(x, y)
        root = roots()
        x = np.flatnonzero(root != np.arange(len(v)))
        if len(x):
            back = turn.astype(np.uint64)
            fp = np.where(back == 0, v, (v >> back) | (v << ((np.uint64(BITS) - back) % np.uint64(BITS))))
            fp = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fp[x]), pa.array(fp[root[x]])], ["a", "b"])

    return keyed.mapInArrow(run, "a long, b long")


def simhash_components(spark: SparkSession, docs: DataFrame, shingle: int = 3, budget: int = 3,
                       id_col: str = "doc_id", text_col: str = "text",
                       hot_rows: int = 1 << 20) -> DataFrame:
    """``(doc_id, text_key, fingerprint, component_id, component_fp)``, one row
    per input row; ``component_fp`` names the component by one fingerprint.

    ``component_id`` is the smallest id reachable over fingerprints that
    differ in at most ``budget`` bits.  Equal fingerprints are one node, so
    copies never form pairs.  Rows with a null id are linked like others (a
    component of null ids only has a null ``component_id``); null and empty
    texts have fingerprint 0; an empty table gives no rows; further columns
    of ``docs`` are ignored, whatever their names.
    """
    fp = cut(spark, fingerprints(docs, shingle, id_col, text_col))
    nodes = cut(spark, fp.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = linked_fingerprints(spark, nodes.select("fp"), budget, hot_rows)
    labels = connected_components(spark, edges)
    named = (nodes.join(labels, nodes.fp == labels.node, "left")
             .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.select("fp", "root").join(least, "root").select("fp", "component_id", "root")
    return fp.join(of, "fp").select(
        "doc_id", "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id", F.col("root").alias("component_fp"))


def keep_one_per_component(spark: SparkSession, docs: DataFrame, shingle: int = 3,
                           budget: int = 3) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: one per component, the
    one with the smallest id (ties: smallest ``text_key``; a null id comes
    last).  Exact repeats of a kept row are dropped too."""
    comp = simhash_components(spark, docs, shingle, budget)
    stay = (comp.groupBy("component_fp")
            .agg(F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("id"),
                                F.col("text_key").alias("key"))).alias("s")).select("s.*"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])      # whatever their names
    keyed = docs.select(row.alias("row"), F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("id"),
                        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key"))
    kept = keyed.join(stay, ["id", "key"], "left_semi")
    return kept.dropDuplicates(["id", "key"]).select("row.*")
