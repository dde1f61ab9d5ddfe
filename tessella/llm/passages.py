"""Substring dedup by collinear chaining of shared k-mer seeds.

1. *Seeds.* Of every window of ``WINDOW`` consecutive ``K``-word shingles the
   one with the smallest hash is kept, so any ``WINDOW + K - 1`` equal words
   share a seed.  Of a run of equal ones the first and the last are kept.
2. *Matches.* Occurrences of a seed are ordered by document; each is joined
   to the first and to the previous document that has it, never to all of
   them: whatever its number of occurrences, a seed makes at most two
   matches for each, and every occurrence but the first meets an earlier one.
   The documents between may be the only ones that hold a whole passage:
   every stretch of ``min_words`` words with common seeds only (in three or
   more documents) is therefore hashed as a whole and joined to the first
   document that has it, so no exact repeat is missed.
   One match is enough for a pair of documents.  Pairs of few matches are
   first told by the words around them: a banded alignment must reach
   ``MIN_WORDS`` words at ``IDENTITY`` before whole texts are moved.
3. *Chains.* The matches of a pair of documents are chained: the best chain
   ending in a match is the best over all matches before it in both texts,
   less a cost for the words skipped, found by prefix maxima in a Fenwick
   tree.
4. *Alignment.* Chains are aligned word by word (between seeds by edit
   distance, at the ends until too few words agree); parts of at
   least ``MIN_WORDS`` words with at least ``IDENTITY`` of the aligned words
   equal are repeated passages.

Documents are ordered by id; the first occurrence of a passage stays.  Exact
copies of a text are one node: only the first takes part in the search, the
others are its copies.
"""

from __future__ import annotations

import zlib
from itertools import chain
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import bucketed, discard, text_bytes, text_slices, worker_trim, written

K, WINDOW = 5, 8
MIN_WORDS = 50
IDENTITY = 0.8
SKIP_COST = 0.05        # of a chain, for each word skipped in either text
MAX_GAP = 64            # words between two seeds of a chain
AHEAD, DROP = 8, 8.0    # words that tell how an alignment goes on; its loss at the end
WAYS = ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2), (3, 3))     # words passed in either text
FEW, AROUND, BAND = 3, 64, 8    # matches of a pair told by the words around them; words to each side; shift
HOT_SHARE, HOT_ROWS, SALTS, SAMPLE = 1e-4, 1024, 64, 16
NO_ID = (1 << 63) - 1   # stands for a null id: such rows come last
SENT = 1024             # rows with texts sent to a Python worker at a time


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc, h, t)``: id (null last), a hash of the text and its bytes."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.xxhash64(F.lit(3), F.coalesce(F.col("text"), F.lit(""))).alias("h"),
                       text_bytes("text").alias("t"))


def smallest_in_windows(h, width: int):
    """Marks the values that are the smallest of some window of ``width``."""
    import numpy as np

    n = len(h)
    if n == 0:
        return np.zeros(0, bool)
    width = min(width, n)

    def run(x, best):                     # best over [i, i + width)
        done, size = x, 1
        while size < width:
            step = min(size, width - size)
            done = best(done[:len(done) - step], done[step:])
            size += step
        return done

    least = run(h, np.minimum)            # of each window
    pad = np.zeros(width - 1, h.dtype)
    covered = run(np.concatenate((pad, least, pad)), np.maximum)
    return h == covered


def word_hashes(texts: list[bytes]):
    """``(x, lengths)``: hashes of the words of all texts in a row, and the
    texts' numbers of words."""
    import numpy as np
    import xxhash

    # hashing a word costs less than finding it among remembered ones
    digest = xxhash.xxh64_intdigest
    words = [t.lower().split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    return np.fromiter(map(digest, chain.from_iterable(words)), np.uint64, int(lengths.sum())), lengths


def shingles(x, k: int):
    """Hashes of all ``k`` words in a row of ``x``."""
    import numpy as np

    n = max(0, len(x) - k + 1)
    mer = np.zeros(n, np.uint64)
    for j in range(k):
        mer += x[j:n + j] * np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) | 1)
    mer ^= mer >> np.uint64(31)
    mer *= np.uint64(0xBF58476D1CE4E5B9)
    return mer ^ (mer >> np.uint64(29))


def seeds_of(x, lengths, k: int, window: int):
    """``(seed, text, place in x)`` of the kept shingles.  Of a run of equal
    ones in a row the first and the last are kept."""
    import numpy as np

    mer = shingles(x, k)
    n = len(mer)
    at = np.repeat(np.arange(len(lengths)), lengths)[:n]
    inside = np.arange(n) + k <= np.cumsum(lengths)[at]
    mer[~inside] = np.uint64((1 << 64) - 1)
    i = np.flatnonzero(smallest_in_windows(mer, window) & inside)
    fresh = np.ones(len(i), bool)
    fresh[1:] = (mer[i[1:]] != mer[i[:-1]]) | (at[i[1:]] != at[i[:-1]])
    i = i[fresh | np.append(fresh[1:], True)]
    return mer[i], at[i], i


def contexts(x, lengths, at, i, min_words: int):
    """``(start, hash)`` of the ``min_words`` words around each place ``i`` of
    texts ``at``, moved to stay inside the text; the place in them is part of
    the hash, which is 0 in shorter texts."""
    import numpy as np

    starts = np.cumsum(lengths) - lengths
    last = (starts + lengths)[at] - min_words
    begin = np.maximum(np.minimum(i - min_words // 2, last), starts[at])
    mer = shingles(x, min_words)
    if not len(mer):
        return begin, np.zeros(len(i), np.uint64)
    h = mer[np.minimum(begin, len(mer) - 1)] + np.uint64(0x9E3779B97F4A7C15) * (i - begin).astype(np.uint64)
    return begin, np.where(last >= starts[at], h | np.uint64(1), np.uint64(0))


def seeds(texts: DataFrame, k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """``(seed, doc, h, pc)``: kept k-word shingles; ``pc`` holds their first
    word's number and, in its lower 32 bits, the hash of the ``min_words``
    words around (0: none)."""

    def run(batches):
        import numpy as np

        worker_trim()
        for b in batches:
            for part in text_slices(b, 2):
                x, lengths = word_hashes(part.column(2).to_pylist())
                mer, at, i = seeds_of(x, lengths, k, window)
                starts = np.cumsum(lengths) - lengths
                _, ctx = contexts(x, lengths, at, i, min_words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mer.view(np.int64)), part.column(0).take(pa.array(at)),
                     part.column(1).take(pa.array(at)),
                     pa.array(((i - starts[at]) << 32) | (ctx & np.uint64(0xFFFFFFFF)).astype(np.int64))],
                    ["seed", "doc", "h", "pc"])

    return texts.mapInArrow(run, "seed long, doc long, h long, pc long")


def stretches(texts: DataFrame, placed: DataFrame, min_words: int, k: int = K, window: int = WINDOW) -> DataFrame:
    """``(hash, doc, h, pos, before, after)``: every ``min_words`` words in a
    row that hold no seed of fewer than three documents, and hashes of the
    words next to them (0: none).  The others meet all documents that have
    them by such a seed.  Only seeds that depend on none but these words
    count, so that equal stretches are treated alike.

    Left out are stretches that meet the first document that has them by
    their seeds already: those whose seeds occur first at this very place
    (all others that have them are matched to it), and those inside words
    that stand unchanged around the first occurrences of a row of seeds in
    one document.
    """
    often = placed.where("common").groupBy("doc", "h").agg(F.collect_list(F.struct("pos", "line")).alias("often"))

    def run(batches):
        import numpy as np

        worker_trim()
        for b in batches:
            for part in text_slices(b, 2):
                x, lengths = word_hashes(part.column(2).to_pylist())
                starts = np.cumsum(lengths) - lengths
                seed, at, i = seeds_of(x, lengths, k, window)
                lists = part.column(3)
                told = lists.flatten()
                of_told = np.repeat(np.arange(len(lengths)), lists.value_lengths().to_numpy())
                places = told.field("pos").to_numpy().astype(np.int64) + starts[of_told]
                common, lines = np.zeros(len(x), bool), np.zeros(len(x), np.int64)
                common[places], lines[places] = True, told.field("line").to_numpy()
                mer = shingles(x, min_words)
                w = np.arange(len(mer))
                of = np.repeat(np.arange(len(lengths)), lengths)[:len(mer)]
                inner = max(window - 1, min_words - k - window + 2)

                def upto(marked):                         # marked seeds before a place
                    out = np.zeros(len(x) + 1, np.int64)
                    out[i[marked] + 1] = 1
                    return np.cumsum(out)

                # of a row of equal seeds, whose ends other words can move, none
                # counts as this document's own
                twin = (seed[1:] == seed[:-1]) & (at[1:] == at[:-1])
                alone = ~(np.append(twin, False) | np.append(False, twin)) if len(i) else np.zeros(0, bool)
                rare, first_here, any_ = upto(~common[i]), upto((lines[i] == 1) & alone), upto(np.ones(len(i), bool))
                # rows of seeds on one line: what stands around them is covered
                line_of = lines[i]
                begin, _ = contexts(x, lengths, at, i, min_words)
                new = np.append(True, (line_of[1:] != line_of[:-1]) | (at[1:] != at[:-1])
                                | (begin[1:] - begin[:-1] > min_words)) if len(i) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                end = np.append(first[1:], len(i)) - 1
                kept = (line_of[first] & 2) != 0 if len(i) else np.zeros(0, bool)
                cover = np.zeros(len(x) + 2, np.int64)
                np.add.at(cover, begin[first[kept]], 1)
                np.add.at(cover, begin[end[kept]] + 1, -1)
                covered = np.cumsum(cover)[:len(mer)] > 0
                inside = w + min_words <= (starts + lengths)[of]
                w, of, covered = w[inside], of[inside], covered[inside]
                at_first, at_last = w + window - 1, w + inner
                n_seeds = any_[at_last] - any_[at_first]
                known = (n_seeds > 0) & (first_here[at_last] - first_here[at_first] == n_seeds)
                wanted = (rare[at_last] == rare[at_first]) & ~covered & ~known
                w, of = w[wanted], of[wanted]
                y = np.concatenate(([0], x, [0])).astype(np.uint64).view(np.int64)
                before = np.where(w > starts[of], y[w], 0)
                after = np.where(w + min_words < (starts + lengths)[of], y[w + min_words + 1], 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mer[w].view(np.int64)), part.column(0).take(pa.array(of)),
                     part.column(1).take(pa.array(of)), pa.array((w - starts[of]).astype(np.int32)),
                     pa.array((before >> 32).astype(np.int32)), pa.array((after >> 32).astype(np.int32))],
                    ["hash", "doc", "h", "pos", "before", "after"])

    return texts.join(often, ["doc", "h"]).select("doc", "h", "t", "often").mapInArrow(
        run, "hash long, doc long, h long, pos int, before int, after int")


def whole_matches(stretch: DataFrame, min_words: int) -> DataFrame:
    """Like ``matches``: each stretch and the first document that has it.  Of
    stretches that meet the same document at the same distance, the first and
    the last of each ``min_words // 2`` places are enough: they cover all
    between them, and every pair of documents keeps a match."""
    first = stretch.groupBy("hash").agg(F.min(F.struct("doc", "h", "pos")).alias("m"))
    met = stretch.join(first, "hash")       # one row on this side: a common stretch can be split over tasks
    return (met.where((F.col("doc") != F.col("m.doc")) | (F.col("h") != F.col("m.h")))
            .groupBy("doc", "h", F.col("m.doc").alias("doc2"), F.col("m.h").alias("h2"),
                     (F.col("m.pos") - F.col("pos")).alias("shift"),
                     F.floor(F.col("pos") / max(1, min_words // 2)).alias("block"))
            .agg(F.array_distinct(F.array(F.min("pos"), F.max("pos"))).alias("ends"))
            .select("doc", "h", F.explode("ends").alias("pos"), "doc2", "h2", "shift")
            .select("doc", "h", "pos", "doc2", "h2", (F.col("pos") + F.col("shift")).alias("pos2")))


def places(found: DataFrame, n_docs: int) -> DataFrame:
    """``(doc, h, pos, common, ends, line)`` of the occurrences that another
    document has, too: whether three or more have the seed, the first and the
    previous occurrence in other documents, and the line to the first one
    (1: it is this one; 0: the words around differ).  Seeds of a
    share of all documents are dealt to ``SALTS`` tasks each; their first
    occurrence is found beforehand, the previous one inside the salt."""
    # seeds in at least HOT_SHARE of the documents, told by a sample of them;
    # at most (seeds per document / HOT_SHARE) rows; only places work, not results
    least = max(HOT_ROWS, HOT_SHARE * n_docs) / SAMPLE
    often = F.broadcast(found.where(F.pmod("h", F.lit(SAMPLE)) == 0).groupBy("seed").count()
                        .where(F.col("count") >= least).select("seed"))
    here = F.struct("doc", "h", "pc")
    hot = F.broadcast(found.join(often, "seed").groupBy("seed").agg(F.min(here).alias("top")))
    dealt = (found.join(hot, "seed", "left")
             .withColumn("salt", F.when(F.col("top").isNotNull(), F.pmod(F.shiftright("h", 8), F.lit(SALTS))).otherwise(-1)))
    w = Window.partitionBy("seed", "salt").orderBy("doc", "h", "pc")
    placed = dealt.select("seed", "salt", "doc", "h", "pc", F.coalesce("top", F.first(here).over(w)).alias("head"),
                          F.lag(here).over(w).alias("prev"), F.lead("doc").over(w).alias("next"))
    # most seeds occur once: they need not be looked at again
    placed = placed.where(F.col("prev").isNotNull() | F.col("next").isNotNull() | (F.col("salt") >= 0)).drop("next")

    def pos(pc):
        return F.shiftright(pc, 32).cast("int")

    def at(x):
        return F.struct(F.col(f"{x}.doc").alias("doc"), F.col(f"{x}.h").alias("h"), pos(f"{x}.pc").alias("pos"))

    new = F.col("prev").isNull() | (F.col("prev.doc") != F.col("doc")) | (F.col("prev.h") != F.col("h"))
    docs = F.sum(new.cast("int")).over(Window.partitionBy("seed", "salt"))
    common = (F.col("salt") >= 0) | (docs > 2)

    def other(x):
        return x.isNotNull() & ((x["doc"] != F.col("doc")) | (x["h"] != F.col("h")))

    apart = (F.col("prev.doc") != F.col("head.doc")) | (F.col("prev.h") != F.col("head.h"))
    ends = F.filter(F.array(at("head"), F.when(apart, at("prev"))), other)
    own = (F.col("head.doc") == F.col("doc")) & (F.col("head.h") == F.col("h")) & (F.col("head.pc") == F.col("pc"))
    low = F.lit(0xFFFFFFFF)
    same = ((F.col("pc").bitwiseAND(low) == F.col("head.pc").bitwiseAND(low)) & (F.col("pc").bitwiseAND(low) != 0))
    line = F.xxhash64("head.doc", "head.h", pos("head.pc") - pos("pc")).bitwiseOR(F.lit(2))
    return (placed.select("doc", "h", pos("pc").alias("pos"), common.alias("common"), ends.alias("ends"),
                          F.when(own, F.lit(1)).when(same, line).otherwise(F.lit(0)).cast("long").alias("line"))
            .where(F.col("common") | (F.size("ends") > 0)))


def matches(placed: DataFrame) -> DataFrame:
    """``(doc, h, pos, doc2, h2, pos2)``: occurrence and earlier occurrence."""
    return placed.select("doc", "h", "pos", F.explode("ends").alias("m")).select(
        "doc", "h", "pos", F.col("m.doc").alias("doc2"), F.col("m.h").alias("h2"), F.col("m.pos").alias("pos2"))


def chains(pairs: list[tuple[int, int]], k: int = K) -> list[list[tuple[int, int]]]:
    """Best collinear chains of matches ``(x, y)``, each match used once.

    ``f(i) = k + max(0, max f(j) - SKIP_COST * (words skipped))`` over ``j``
    before ``i`` in both texts; the skipped words add up to differences of
    ``x + y``, so the maximum over ``y_j < y_i`` is a prefix maximum.
    """
    pairs = sorted(set(pairs))
    ys = sorted({y for _, y in pairs})
    rank = {y: r + 1 for r, y in enumerate(ys)}
    tree = [(-1.0, -1)] * (len(ys) + 1)
    score, back = [0.0] * len(pairs), [-1] * len(pairs)
    waiting, x_now = [], None
    for i, (x, y) in enumerate(pairs):
        if x != x_now:                       # equal x may not follow each other
            for r, value in waiting:
                while r <= len(ys):
                    if value > tree[r]:
                        tree[r] = value
                    r += r & -r
            waiting, x_now = [], x
        best, r = (-1.0, -1), rank[y] - 1
        while r:
            if tree[r] > best:
                best = tree[r]
            r -= r & -r
        gain = best[0] - SKIP_COST * (x + y) if best[1] >= 0 else 0.0
        if gain > 0:
            score[i], back[i] = k + gain, best[1]
        else:
            score[i] = float(k)
        waiting.append((rank[y], (score[i] + SKIP_COST * (x + y), i)))
    used, out = [False] * len(pairs), []
    for i in sorted(range(len(pairs)), key=lambda i: (-score[i], i)):
        if used[i]:
            continue
        row = []
        while i >= 0 and not used[i]:
            used[i] = True
            row.append(pairs[i])
            i = back[i]
        row.reverse()
        part = [row[0]]
        for p, q in zip(row, row[1:]):
            if max(q[0] - p[0], q[1] - p[1]) > MAX_GAP:
                out.append(part)
                part = []
            part.append(q)
        out.append(part)
    return out


def aligned(a, b) -> tuple[int, int]:
    """(equal words, columns) of the best alignment of two short word lists."""
    if len(a) == len(b):
        same = sum([x == y for x, y in zip(a, b)])
        if same >= len(a) - 1:
            return same, len(a)
    # words equal at either end are so in some best alignment
    lo, na, nb = 0, len(a), len(b)
    while lo < min(na, nb) and a[lo] == b[lo]:
        lo += 1
    ends = lo
    while min(na, nb) > lo and a[na - 1] == b[nb - 1]:
        na, nb, ends = na - 1, nb - 1, ends + 1
    a, b = a[lo:na], b[lo:nb]
    if len(a) < 2 or len(b) < 2:
        same = bool(a) and bool(b) and (a[0] in b if len(a) == 1 else b[0] in a)
        return ends + same, ends + max(len(a), len(b))
    one = 1 << 32                                    # equal words, less columns
    row = [-j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        left, new, diagonal = -i, [-i], row[0]
        for y, up in zip(b, row[1:]):
            best = diagonal + one if x == y else diagonal
            if up > best:
                best = up
            if left > best:
                best = left
            diagonal = up
            left = best - 1
            new.append(left)
        row = new
    same = (row[-1] + one - 1) // one
    return ends + same, ends + same * one - row[-1]


def extend(a, b, i: int, j: int) -> list[tuple[int, int, int]]:
    """Runs ``(i, j, n)`` of ``n`` equal words from ``(i, j)`` onwards.  An
    edit is passed the way most of the next ``AHEAD`` words agree, or as one
    changed word if less than half of them do; ends at a weight ``DROP`` under
    the best so far."""
    out, lost = [], 0.0
    na, nb = len(a), len(b)

    while i < na and j < nb:
        if a[i] == b[j]:
            n, most = 1, min(na - i, nb - j)
            while n + 32 <= most and a[i + n:i + n + 32] == b[j + n:j + n + 32]:
                n += 32
            while n + 4 <= most and a[i + n:i + n + 4] == b[j + n:j + n + 4]:
                n += 4
            while n < most and a[i + n] == b[j + n]:
                n += 1
            out.append((i, j, n))
            for _ in range(n):
                if not lost:
                    break
                lost = max(0.0, lost - (1 - IDENTITY))
            i, j = i + n, j + n
            continue
        best, way = 0, (1, 1)
        if not {*a[i:i + 4]}.isdisjoint(b[j:j + 4]):     # else no way leads on to equal words
            for di, dj in WAYS:
                x, y = i + di, j + dj
                if x >= na or y >= nb or a[x] != b[y]:
                    continue
                n = min(AHEAD, na - x, nb - y)
                same = sum(map(eq, a[x:x + n], b[y:y + n]))
                if same > best and 2 * same >= n:
                    best, way = same, (di, dj)
                    if same >= AHEAD - 1:
                        break
        lost += max(way) * IDENTITY
        if lost > DROP:
            break
        i, j = i + way[0], j + way[1]
    return out


def points_of(runs):
    """Places ``(x, y)`` of all words of some runs, as two arrays."""
    import numpy as np

    if not runs:
        return np.zeros((2, 0), np.int64)
    x, y, n = np.array(runs, np.int64).T
    ends = np.cumsum(n)
    on = np.arange(ends[-1]) - np.repeat(ends - n, n)
    return np.stack((np.repeat(x, n) + on, np.repeat(y, n) + on))


def around(texts, at, places, k: int = K):
    """``(hashes, words)`` of surroundings: 16-bit hashes of ``AROUND`` words
    before (nearest first) and after the seeds at ``places`` of texts ``at``
    (ascending), and how many words there are on either side."""
    import numpy as np

    parts, last, words = [], None, []
    for n, pos in zip(at, places):
        if n != last:
            if last is None or texts[n] != texts[last]:
                words = texts[n].lower().split()
            last = n
        parts.append(words[max(0, pos - AROUND):pos][::-1])
        parts.append(words[pos + k:pos + k + AROUND])
    sides = np.array([len(p) for p in parts], np.uint16).reshape(-1, 2)
    flat = np.fromiter(map(zlib.crc32, chain.from_iterable(parts)), np.uint32, int(sides.sum(dtype=np.int64)))
    out = np.zeros((len(sides), 2, AROUND), np.uint16)
    out[np.arange(AROUND) < sides[:, :, None]] = flat.astype(np.uint16)
    return out.reshape(-1, 2 * AROUND), sides


def beyond(hashes, sides):
    """Surroundings as ``may_hold`` takes them: -1 beyond the text."""
    import numpy as np

    out = hashes.reshape(-1, 2, AROUND).astype(np.int32)
    out[np.arange(AROUND) >= sides[:, :, None]] = -1
    return out.reshape(-1, 2 * AROUND)


def reach(a, b, identity: float):
    """Best weight of an alignment (equal words ``1 - identity``, other
    columns ``-identity``) that uses the first 0, 1, ... words of a row of
    ``a`` and, ``BAND`` more or fewer, of ``b``: one row for each row."""
    import numpy as np

    n, width = a.shape
    worst = np.float32(-1e9)
    row = np.full((2 * BAND + 1, n), worst, np.float32)      # [shift of b, row]
    row[BAND] = 0
    for o in range(BAND + 1, 2 * BAND + 1):
        row[o] = row[o - 1] - identity
    out = np.empty((width + 1, n), np.float32)
    out[0] = 0
    shifted = np.full((width + 2 * BAND, n), -2, np.int32)
    shifted[BAND:BAND + width] = np.where(b < 0, -2, b).T
    a = np.ascontiguousarray(a.T)
    for i in range(width):
        new = row + np.where(shifted[i:i + 2 * BAND + 1] == a[i], np.float32(1 - identity), np.float32(-identity))
        np.maximum(new[:-1], row[1:] - np.float32(identity), out=new[:-1])
        for o in range(max(0, BAND - i - 1)):
            new[o] = worst
        for o in range(1, 2 * BAND + 1):
            np.maximum(new[o], new[o - 1] - np.float32(identity), out=new[o])
        row = new
        out[i + 1] = row.max(0)
    return out


def near_equal(a, b):
    """Which words of rows of ``a`` may stand in ``b`` up to ``BAND`` away."""
    import numpy as np

    n, width = a.shape
    a, x = a >= 0, a.astype(np.uint16)
    y = np.zeros((n, width + 2 * BAND), np.uint16)           # a place beyond a text can only seem equal
    y[:, BAND:BAND + width] = b.astype(np.uint16)
    met = np.zeros((n, width), bool)
    for o in range(2 * BAND + 1):
        met |= x == y[:, o:o + width]
    return met & a


def may_hold(a, b, min_words: int, identity: float, k: int = K):
    """Which pairs of surroundings ``(n, 2 * AROUND)`` can hold a passage."""
    import numpy as np

    need = np.clip(min_words - k - np.arange(AROUND + 1), 0, None)
    fits = need <= AROUND
    if not fits.any():                                        # longer than what is seen
        return np.ones(len(a), bool)

    def holds(left, right, slack):                            # one row for each number of words
        best = np.maximum.accumulate(right[::-1])[::-1]       # of at least so many words
        return (left[fits] + best[need[fits]]).max(0) + k * (1 - identity) >= -slack

    def bound(x, y):
        """No alignment in the band is better: each word of ``x`` costs a column."""
        out = np.zeros((x.shape[1] + 1, len(x)), np.float32)
        np.cumsum(near_equal(x, y).T - np.float32(identity), axis=0, out=out[1:])
        return out

    sides = slice(0, AROUND), slice(AROUND, None)
    out = holds(*(bound(a[:, s], b[:, s]) for s in sides), 1e-2)
    at = np.flatnonzero(out)                                  # most are told by the bound
    if len(at):
        out[at] = holds(*(reach(a[at][:, s], b[at][:, s], identity) for s in sides), 1e-3)
    return out


def whole_passage(a, b, before, row, after, identity: float, k: int):
    """The passage ``(start, end, start2, end2, equal, columns)`` of a whole
    alignment, if no part of it is as good; None if that has to be looked up.

    ``before`` and ``after`` are the runs on both sides of the seeds ``row``.
    Every step but a gap's raises the weight, so the weight before and after
    each gap tells: what stands on either side must outweigh nothing by more
    than rounding.
    """
    na, nb = len(a), len(b)
    runs = [(na - i - n, nb - j - n, n) for i, j, n in reversed(before)]
    (x0, y0), (x1, y1) = row[0], row[-1]
    if x1 - x0 == y1 - y0 and a[x0:x1 + k] == b[y0:y1 + k] and all([x - y == x0 - y0 for x, y in row]):
        runs.append((x0, y0, x1 + k - x0))
    else:
        runs += [(x, y, 1) for x, y in row]
        runs.append((x1 + k - 1, y1 + k - 1, 1))
    runs += after
    x, y, equal = runs[0]
    start, start2, columns = x, y, equal
    x, y = x + equal, y + equal
    gain, loss = 1 - identity, identity
    most, margin = -1.0, 1e-6                       # weight before any gap
    if gain <= margin:                              # a longer one is no better
        return None
    for i, j, n in runs[1:]:
        if i > x or j > y:
            gx, gy = a[x:i], b[y:j]
            if gx == gy:
                equal, columns = equal + len(gx), columns + len(gx)
            else:
                same, wide = aligned(gx, gy)
                most = max(most, equal * gain - (columns - equal) * loss)
                equal, columns = equal + same, columns + wide
                # with the word that ends the step
                if (equal + 1) * gain - (columns - equal) * loss <= margin:
                    return None
        equal, columns, x, y = equal + n, columns + n, i + n, j + n
    if equal * gain - (columns - equal) * loss <= most + margin:
        return None
    return start, x, start2, y, equal, columns


def passages_of(a, b, pairs, min_words: int = MIN_WORDS, identity: float = IDENTITY, k: int = K):
    """Repeated passages ``(start, end, start2, end2, equal, columns)`` of two
    word lists from their seed matches."""
    import numpy as np

    back_a, back_b = a[::-1], b[::-1]
    out, covered = [], {}                                # of a shift: (start, end) of passages
    for row in chains(pairs, k):
        (x0, y0), (x1, y1) = row[0], row[-1]
        if covered and any([s <= x0 and x1 + k <= e for d in range(-2, 3) for s, e in covered.get(x0 - y0 + d, ())]):
            continue
        before, after = extend(back_a, back_b, len(a) - x0, len(b) - y0), extend(a, b, x1 + k, y1 + k)
        begins = len(a) - before[-1][0] - before[-1][2] if before else x0
        if (after[-1][0] + after[-1][2] if after else x1 + k) - begins < min_words:
            continue
        if k > 1 and (found := whole_passage(a, b, before, row, after, identity, k)):
            out.append(found)
            covered.setdefault(found[0] - found[2], []).append(found[:2])
            continue
        px, py = np.concatenate((
            (np.array([[len(a) - 1], [len(b) - 1]]) - points_of(before))[:, ::-1],
            np.array(row + [(x1 + k - 1, y1 + k - 1)]).T, points_of(after)), 1)
        if k == 1:                                       # a seed's last word is its first
            once = np.append(True, px[1:] > px[:-1])
            px, py = px[once], py[once]
        # steps of the alignment: (start, end, start2, end2, equal, columns)
        same = np.maximum(px - np.append(px[0] - 1, px[:-1]), 1)
        columns = same.copy()
        gaps = np.flatnonzero((px[1:] - px[:-1] > 1) | (py[1:] - py[:-1] > 1)) + 1
        for n, s, e, s2, e2 in zip(gaps.tolist(), *((q[gaps - 1 + m] + 1 - m).tolist() for q in (px, py) for m in (0, 1))):
            gx, gy = a[s:e], b[s2:e2]
            if gx != gy:
                equal, wide = aligned(gx, gy)
                same[n], columns[n] = equal + 1, wide + 1
        start, start2 = np.append(px[0], px[:-1] + 1), np.append(py[0], py[:-1] + 1)
        end, end2 = px + 1, py + 1
        todo = [(0, len(px))]
        while todo:
            first, last = todo.pop()
            if first == last or end[last - 1] - start[first] < min_words:
                continue
            # best run of steps of at least ``min_words`` words; a run at
            # exactly ``identity`` weighs nothing
            part = slice(first, last)
            weights = np.zeros(2 * (last - first) + 1)
            weights[1::2] = same[part] * (1 - identity)
            weights[2::2] = -((columns[part] - same[part]) * identity)
            sums = np.cumsum(weights)[::2]
            # the first smallest sum before any step that may open a run
            smallest = np.minimum.accumulate(sums)
            fresh = np.append(True, smallest[1:] < smallest[:-1])
            least = np.maximum.accumulate(np.where(fresh, np.arange(len(sums)), 0))
            opened = np.searchsorted(start[part], end[part] - min_words, "right")
            gain = np.where(opened > 0, sums[1:] - smallest[opened - 1], -np.inf)
            hi = int(gain.argmax())
            if not gain[hi] > -1e-9:
                continue
            lo, hi = first + int(least[opened[hi] - 1]), first + hi + 1
            found = (start[lo], end[hi - 1], start2[lo], end2[hi - 1], same[lo:hi].sum(), columns[lo:hi].sum())
            out.append(tuple(int(q) for q in found))
            covered.setdefault(out[-1][0] - out[-1][2], []).append(out[-1][:2])
            todo += [(first, lo), (hi, last)]
    return out


def promising(pairs: DataFrame, texts: DataFrame, min_words: int, identity: float) -> DataFrame:
    """``pairs`` without those of at most ``FEW`` matches whose surroundings
    cannot hold a passage; only these words are moved, not the texts."""
    few = pairs.where(F.size("m") <= FEW).select("doc", "h", "doc2", "h2", "m")

    def seen_in(part, column, place):
        """``around`` of a slice's matches, and the number of each row's."""
        import numpy as np

        m = part.column(4)
        each = m.value_lengths().to_numpy()
        at = np.repeat(np.arange(len(each)), each)
        return *around(part.column(column).to_pylist(), at.tolist(), m.flatten().field(place).to_pylist()), each, at

    def collected(batches):
        import numpy as np

        worker_trim()
        for b in batches:
            for part in text_slices(b, 5, 256):
                hashes, sides, each, _ = seen_in(part, 5, "pos")
                raw, size = np.hstack((hashes, sides)).tobytes(), 2 * (2 * AROUND + 2)
                ends = np.cumsum(each) * size
                seen = [raw[e - n * size:e] for e, n in zip(ends.tolist(), each.tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(seen, pa.binary())],
                                                 ["doc", "h", "doc2", "h2", "m", "c"])

    def told(batches):
        import numpy as np

        worker_trim()
        for b in batches:
            for part in text_slices(b, 6, 1024, 1 << 22):
                *two, _, at = seen_in(part, 6, "pos2")
                raw = np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint16).reshape(-1, 2 * AROUND + 2)
                one = raw[:, :-2], raw[:, -2:]
                keep = np.unique(at[may_hold(beyond(*one), beyond(*two), min_words, identity)])
                if len(keep):
                    yield pa.RecordBatch.from_arrays([c.take(pa.array(keep)) for c in part.columns[:5]],
                                                     ["doc", "h", "doc2", "h2", "m"])

    kind = "doc long, h long, doc2 long, h2 long, m array<struct<pos: int, pos2: int>>"
    seen = few.join(texts, ["doc", "h"]).select("doc", "h", "doc2", "h2", "m", "t").mapInArrow(
        collected, f"{kind}, c binary")
    other = texts.select(F.col("doc").alias("doc2"), F.col("h").alias("h2"), F.col("t").alias("t2"))
    kept = seen.join(other, ["doc2", "h2"]).select("doc", "h", "doc2", "h2", "m", "c", "t2").mapInArrow(told, kind)
    return pairs.where(F.size("m") > FEW).select("doc", "h", "doc2", "h2", "m").unionByName(kept)


def word_counts(rows: DataFrame) -> DataFrame:
    """``(doc, h, n_words)`` of all rows ``(doc, h, t)``."""

    def run(batches):
        worker_trim()
        for b in batches:
            n = [len(t.split()) for part in text_slices(b, 2) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc", "h", "n_words"])

    return rows.select("doc", "h", "t").mapInArrow(run, "doc long, h long, n_words long")


def repeated_passages(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS,
                      identity: float = IDENTITY) -> tuple[DataFrame, DataFrame]:
    """``(copies, spans)``.

    ``copies(doc, h, first, n_words)``: every row of ``docs`` with its text's
    first document.  ``spans(doc, h, start, end, doc2, start2, end2, equal,
    columns)``: words [start, end) of a first document that an earlier one
    has, too.
    """
    rows = keyed(docs)
    ids = written(spark, rows.select("doc", "h"), "ids")
    firsts = written(spark, ids.groupBy("h").agg(F.min("doc").alias("first"), F.count("*").alias("n")), "firsts")
    # all but the copies; where there are none every row is its own first
    copied, lone = firsts.where("n > 1"), rows
    if not copied.isEmpty():
        lone = (rows.join(copied.select("h", "first"), "h", "left")
                .where("first is null or doc = first").select("doc", "h", "t"))
        if not ids.groupBy("doc", "h").count().where("count > 1").isEmpty():
            lone = lone.dropDuplicates(["doc", "h"])
    # every later join takes the texts as they lie here
    lone = bucketed(spark, lone, ("doc", "h"), "texts")
    found = written(spark, seeds(lone, min_words=min_words), "seeds", SENT)
    placed = written(spark, places(found, firsts.count()), "places")
    discard(spark, found)
    stretch = written(spark, stretches(lone, placed, min_words), "stretches", SENT)
    whole = whole_matches(stretch, min_words)
    pairs = (matches(placed).unionByName(whole).groupBy("doc", "h", "doc2", "h2")
             .agg(F.collect_list(F.struct("pos", "pos2")).alias("m")))
    pairs = written(spark, pairs, "pairs")
    discard(spark, placed)
    discard(spark, stretch)
    texts = lone
    all_pairs, pairs = pairs, written(spark, promising(pairs, texts, min_words, identity), "promising", SENT)
    discard(spark, all_pairs)
    later = pairs.join(texts, ["doc", "h"])
    both = later.join(texts.select(F.col("doc").alias("doc2"), F.col("h").alias("h2"), F.col("t").alias("t2")),
                      ["doc2", "h2"]).select("doc", "h", "doc2", "m", "t", "t2")

    def run(batches):
        worker_trim()
        for b in batches:
            for part in text_slices(b, 4, 64):
                out = []
                for doc, h, doc2, m, t, t2 in zip(*(part.column(c).to_pylist() for c in range(6))):
                    got = passages_of(t.lower().split(), t2.lower().split(),
                                      [(p["pos"], p["pos2"]) for p in m], min_words, identity)
                    out += [(doc, h, s, e, doc2, s2, e2, same, cols) for s, e, s2, e2, same, cols in got]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*out)],
                        ["doc", "h", "start", "end", "doc2", "start2", "end2", "equal", "columns"])

    spans = written(spark, both.mapInArrow(
        run, "doc long, h long, start long, end long, doc2 long, start2 long, end2 long, equal long, columns long"),
        "spans", SENT)
    discard(spark, pairs)
    discard(spark, lone)
    copies = word_counts(rows).join(firsts, "h").select("doc", "h", "first", "n_words")
    return copies, spans


def merged_spans(spans: DataFrame) -> DataFrame:
    """``(doc, h, cuts, sources)``: disjoint removed ranges of words, in
    order, and the documents they repeat."""
    joined = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "end"))),
        F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
            F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"),
                             F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(x))))
    return spans.groupBy("doc", "h").agg(joined.alias("cuts"), F.array_sort(F.collect_set("doc2")).alias("sources"))


def dedup(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS,
          identity: float = IDENTITY) -> DataFrame:
    """``(doc_id, n_words, copy_of, dup_words, cuts, sources)`` per row.

    ``cuts``: word ranges that an earlier document has, too; ``dup_words``
    counts them; ``sources``: those documents.  A later copy of a whole text
    of at least ``min_words`` words names the first in ``copy_of`` and all
    its words are one cut.  Null and empty texts have no words; rows with a
    null id come after all others (their id stays null; ``sources`` may name
    them by ``NO_ID``); further rows with the same id and text are copies of
    that id; an empty table gives no rows; further columns are ignored.
    """
    copies, spans = repeated_passages(spark, docs, min_words, identity)
    copies = written(spark, copies, "copies", SENT)
    once = Window.partitionBy("h", "doc").orderBy(F.lit(0))
    numbered = copies.withColumn("again", F.row_number().over(once) > 1)
    copy = (F.col("n_words") >= min_words) & ((F.col("doc") != F.col("first")) | F.col("again"))
    m = merged_spans(spans)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    out = (numbered.join(m, ["doc", "h"], "left")
           .withColumn("copy_of", F.when(copy, F.col("first")))
           .withColumn("cuts", F.when(copy, whole).otherwise(F.coalesce("cuts", none)))
           .withColumn("sources", F.when(copy, F.array("first")).otherwise(
               F.coalesce("sources", F.expr("cast(array() as array<bigint>)")))))
    dup = F.aggregate("cuts", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_words", "copy_of",
                      dup.alias("dup_words"), "cuts", "sources", "h")


def without_passages(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS,
                     identity: float = IDENTITY) -> DataFrame:
    """The rows of ``docs`` (all columns) without repeated passages; the text
    between them stays as it is.  Rows that lose all their words go; rows
    that lose none are untouched.  ``n_chars`` follows the text."""
    _, spans = repeated_passages(spark, docs, min_words, identity)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])      # whatever their names
    base = docs.select(row.alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.xxhash64(F.lit(3), F.coalesce(F.col("text"), F.lit(""))).alias("h"))
    m = merged_spans(spans).select("doc", "h", "cuts")
    # copies by id and hash alone, then one join that moves the texts
    ids = base.select("doc", "h")
    copied = ids.groupBy("h").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = (ids.join(copied, "h").groupBy("doc", "h", "first").agg(F.count("*").alias("same")))
    facts = written(spark, m.join(again, ["doc", "h"], "full"), "cuts")
    joined = base.join(facts, ["doc", "h"], "left")
    text = F.col("row.text")
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    long_copy = F.when(F.col("first").isNotNull(), words >= min_words).otherwise(False)
    kept = joined.where(~long_copy | (F.col("doc") == F.col("first")))
    if not facts.where("same > 1").isEmpty():       # the same id and text more than once
        kept = (kept.withColumn("number", F.row_number().over(Window.partitionBy("doc", "h").orderBy(F.lit(0))))
                .where(~long_copy | (F.col("number") == 1)))

    @F.pandas_udf("string")
    def cut(text, cuts):
        import re

        out = []
        for t, c in zip(text, cuts):
            if t is None or c is None:
                out.append(None)
                continue
            spans_ = [m_.span() for m_ in re.finditer(r"[^\x20\x09-\x0D]+", t)]
            keep, at = [], 0
            for r in c:
                keep.append(t[at:spans_[r["start"]][0]])
                at = spans_[r["end"]][0] if r["end"] < len(spans_) else len(t)
            keep.append(t[at:])
            out.append("".join(keep))
        import pandas as pd

        return pd.Series(out)

    touched = F.col("cuts").isNotNull()
    # once a row: a deterministic function would be moved into the filter below
    # as well, and every task would hold a second Python worker from then on
    cut = cut.asNondeterministic()
    out = kept.select("row", "cuts", cut(F.when(touched, text), F.col("cuts")).alias("less"))
    out = out.where(~touched | F.col("less").rlike(r"[^\x20\x09-\x0D]"))
    done = F.col("row").withField("text", F.when(touched, F.col("less")).otherwise(text))
    if "n_chars" in docs.columns:
        done = done.withField("n_chars", F.when(touched, F.char_length("less").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return out.select(done.alias("row")).select("row.*")
