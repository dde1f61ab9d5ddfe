"""Brown class-based bigram model: clustering by exchange, then scoring.

Words belong to classes; a text is scored by class transitions times word
emissions, ``P(w | previous) = P(class(w) | class(previous)) * P(w | class(w))``.

1. *Coding.* Texts become blocks of about ``BLOCK_TOKENS`` tokens: a block
   keeps its distinct words once and its tokens as small codes, so later
   passes neither split texts nor ship words again.
2. *Counts.* Words of all training texts are counted.  Words with at least
   ``CLASS_SHARE`` of all training tokens (at most ``1 / CLASS_SHARE`` words,
   whatever the corpus) are exchanged in the sweeps; the many rarer ones
   share one class meanwhile.
3. *Exchange.* Sweeps over all training bigrams gather, for every
   class-bearing word, how often each class stands before and after it.  Each
   word is then exchanged into the class that gains the most likelihood,
   taken out of its own class first.  After the first sweep a third of the words
   stays, another in each sweep, so that words which attract each other do
   not swap places for ever.
4. *Scoring.* Transitions are interpolated with class frequencies (Witten and
   Bell), emissions are smoothed; an unknown word is emitted by the rare
   class.  Each block meets the counts and classes of its rare words through
   a join.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import discard, drop_shuffles, text_bytes, worker_trim, written

CLASSES = 32            # exchange classes; two more: rare words, text ends
SWEEPS = 4
CLASS_SHARE = 2e-6
BLOCK_TOKENS = 600_000
BLOCK_DOCS = 16_384
SLICE = 100_000         # tokens of a block counted at a time
DOCS_SENT = 1_000       # texts or words sent to a Python worker at a time; blocks go one by one
ADD = 0.1               # added to counts in emissions and in the base score
FOLDS, HELD_OUT = 10, 0
END = b""               # the end token among the words of a block
PAIRS = [("p", "<u2"), ("c", "<u4")]    # a class before or after a word and its count


def coded_blocks(docs: DataFrame) -> DataFrame:
    """Blocks ``(block, doc_ids, lengths, held, words, counts, codes)``: the
    distinct words of some texts (joined by line ends, which no word holds),
    their training counts and the tokens as codes into the words, all three
    packed; word 0 is the end token, written as the empty word."""
    rows = docs.select("doc_id", text_bytes("text").alias("t"),
                       (F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")),
                               F.lit(FOLDS)) == HELD_OUT).alias("held"))
    kind = rows.schema["doc_id"].dataType

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        worker_trim()
        part, number = TaskContext.get().partitionId(), 0
        ids, held, codes, index, n = [], [], [], {END: 0}, 0

        def block():
            flat = np.concatenate(codes)
            lengths = np.array([len(c) for c in codes])
            train = np.repeat(~np.array(held), lengths)
            counts = np.bincount(flat[train], minlength=len(index))
            return pa.RecordBatch.from_arrays([
                pa.array([(part << 32) + number], pa.int64()), pa.array([ids]), pa.array([lengths]),
                pa.array([held]), *(pa.array([x], pa.binary()) for x in (
                    packed(b"\n".join(index)), packed(counts.astype("<u4")), packed(flat.astype("<u4"))))],
                ["block", "doc_ids", "lengths", "held", "words", "counts", "codes"])

        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part_of = b.slice(lo, 512)
                for d, t, h in zip(*(part_of.column(k).to_pylist() for k in range(3))):
                    words = t.lower().split()
                    ids.append(d)
                    held.append(h)
                    add = index.setdefault
                    codes.append(np.array([add(w, len(index)) for w in words] + [0], np.int32))
                    n += len(words) + 1
                    if n >= BLOCK_TOKENS or len(ids) >= BLOCK_DOCS:
                        yield block()
                        number += 1
                        ids, held, codes, index, n = [], [], [], {END: 0}, 0
        if ids:
            yield block()

    return rows.mapInArrow(run, f"block long, doc_ids array<{kind.simpleString()}>, lengths array<long>, "
                                "held array<boolean>, words binary, counts binary, codes binary")


def packed(raw) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(raw if isinstance(raw, bytes) else raw.tobytes())


def unpacked(value) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(value.as_buffer())


def numbers(value):
    """A packed u32 column value as int64 array."""
    import numpy as np

    return np.frombuffer(unpacked(value), "<u4").astype(np.int64)


def entries(blocks: DataFrame) -> DataFrame:
    """``(word, block, at, c)``: the words of every block with their training
    counts there."""

    def run(batches):
        worker_trim()
        for b in batches:
            for block, words, counts in zip(*(b.column(k) for k in range(3))):
                w, c = unpacked(words).split(b"\n"), numbers(counts)
                for lo in range(0, len(w), 50_000):
                    n = len(w[lo:lo + 50_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(w[lo:lo + n], pa.binary()), pa.array([block.as_py()] * n, pa.int64()),
                         pa.array(range(lo, lo + n), pa.int32()), pa.array(c[lo:lo + n])],
                        ["word", "block", "at", "c"])

    return blocks.select("block", "words", "counts").mapInArrow(run, "word binary, block long, at int, c long")


def neighbours(blocks: DataFrame, index: dict, classes, n_classes: int) -> DataFrame:
    """``(word, pairs)`` partial counts: for each class-bearing word a sparse
    vector of the classes before (0..) and after (n_classes..) it, as one
    binary of (u16 place, u32 count) rows; ``word`` -1 holds the class bigrams."""
    width = 2 * n_classes
    n_words = len(index)
    rare = n_classes - 1

    def run(batches):
        import numpy as np

        worker_trim()
        end, one = index[END], np.uint32(1)
        total = None                             # a count per word and place: 4 * width bytes a word
        bigrams = np.zeros(n_classes * n_classes, np.int64)
        for b in batches:
            for words, codes, lengths, held in zip(*(b.column(k) for k in range(4))):
                if total is None:
                    total = np.zeros(n_words * width, np.uint32)
                words = unpacked(words).split(b"\n")
                number = np.fromiter((index.get(w, -1) for w in words), np.int64, len(words))
                del words
                cls = np.where(number >= 0, classes[number], rare)
                code = np.frombuffer(unpacked(codes), "<u4")
                train = np.repeat(~np.array(held.as_py()), np.array(lengths.as_py()))
                for lo in range(0, len(code), SLICE):
                    # the end class stands before a text's first token, too
                    part, mine = code[lo:lo + SLICE], train[lo:lo + SLICE]
                    token, of = number[part], cls[part]
                    first = code[lo - 1] if lo else None
                    before = np.concatenate(([classes[end] if first is None else cls[first]], of[:-1]))
                    bigrams += np.bincount((before * n_classes + of)[mine], minlength=n_classes ** 2)
                    left = mine & (token >= 0)
                    np.add.at(total, token[left] * width + before[left], one)
                    previous = np.concatenate(([end if first is None else number[first]], token[:-1]))
                    right = mine & (previous >= 0)
                    np.add.at(total, previous[right] * width + n_classes + of[right], one)
        if total is None:
            return
        all_ = np.empty(n_classes ** 2, dtype=PAIRS)
        all_["p"], all_["c"] = np.arange(n_classes ** 2), bigrams
        out_w, out_p = [-1], [all_.tobytes()]
        for a in range(0, n_words, 10_000):
            counts = total[a * width:(a + 10_000) * width]
            at = np.flatnonzero(counts)
            word = at // width
            pairs = np.empty(len(at), dtype=PAIRS)
            pairs["p"], pairs["c"] = at - word * width, counts[at]
            raw = pairs.tobytes()
            met, lo = np.unique(word, return_index=True)
            hi = np.append(lo[1:], len(word))
            out_w += (met + a).tolist()
            out_p += [raw[6 * s:6 * e] for s, e in zip(lo.tolist(), hi.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(out_w, pa.int64()), pa.array(out_p, pa.binary())],
                                             ["word", "pairs"])
            out_w, out_p = [], []

    return blocks.select("words", "codes", "lengths", "held").mapInArrow(run, "word long, pairs binary")


def gains(place, c, first, after, now, bigrams, n_classes: int):
    """For each word (entries [first, after) of ``place`` and ``c``: how often
    a class stands before or after it), taken out of its class ``now``, what
    the likelihood gains from it in each class: the sum of ``f(bigram
    count)`` less ``f`` of both class counts, with ``f(x) = x log x``.  Yields
    ``(lo, hi, gain)`` for words [lo, hi); ties are for the present class."""
    import numpy as np

    chunk = 10_000                            # vector entries at a time

    def grown(x, n):
        """f(x + n) - f(x), accurate in single precision too."""
        up = x + n
        return n * np.log(np.maximum(up, 1)) + x * np.log(np.maximum(up, 1) / np.maximum(x, 1))

    # place before: row of it; after: column of it
    both = np.concatenate((bigrams, bigrams.T)).astype(np.float32)
    into, out_of = bigrams.sum(0), bigrams.sum(1)
    lo = 0
    while lo < len(now):
        hi = max(int(np.searchsorted(after, first[lo] + chunk, "right")), lo + 1)
        s, e = first[lo], after[hi - 1]
        here = np.repeat(np.arange(hi - lo), after[lo:hi] - first[lo:hi])
        own, k = now[lo:hi], np.arange(hi - lo)
        p, n = place[s:e], c[s:e].astype(np.float32)
        base = both[p]
        at = np.arange(len(p))
        base[at, own[here]] = np.maximum(base[at, own[here]] - n, 0)
        gain = np.add.reduceat(grown(base, n[:, None]), first[lo:hi] - s, dtype=np.float64)
        for total, side in ((into, p < n_classes), (out_of, p >= n_classes)):
            m = np.bincount(here[side], n[side], minlength=hi - lo)
            rest = np.repeat(total[None, :], hi - lo, axis=0)
            rest[k, own] = np.maximum(rest[k, own] - m, 0)
            gain -= grown(rest, m[:, None])
        gain[k, own] += 1e-9 * np.abs(gain[k, own])
        yield lo, hi, gain
        lo = hi


def exchange(partials: DataFrame, classes, n_classes: int, bigrams, moves) -> DataFrame:
    """``(word, class)``: each word of ``moves(word)`` is taken out of its
    class and put where the likelihood of all class bigrams grows most
    (``gains``).  Ties keep the present class, then the first.  The rare
    words' turn is ``placed_rare``."""
    free = n_classes - 2                      # the rare and the end class are fixed

    def run(batches):
        import numpy as np

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        raw = t.column(1).to_pylist()
        flat = np.frombuffer(b"".join(raw), dtype=PAIRS)
        row = np.repeat(t.column(0).to_numpy(), [len(r) // 6 for r in raw])
        flat, row = flat[moves(row)], row[moves(row)]
        if not len(row):
            return
        # one entry per word and place
        key, at = np.unique(row * (2 * n_classes) + flat["p"], return_inverse=True)
        c = np.bincount(at, flat["c"])
        row, place = key // (2 * n_classes), key % (2 * n_classes)
        words, first = np.unique(row, return_index=True)
        after = np.append(first[1:], len(row))
        now = classes[words]
        for lo, hi, gain in gains(place, c, first, after, now, bigrams, n_classes):
            own = now[lo:hi]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[lo:hi]), pa.array(np.where(own < free, gain[:, :free].argmax(1), own))], ["word", "class"])

    # a word's partial counts meet in one task: at most one row per coding task
    return partials.where("word >= 0").repartition("word").mapInArrow(run, "word long, class long")


def rare_entries(blocks: DataFrame, index: dict, classes, n_classes: int) -> DataFrame:
    """``(word, block, at, near)``: the rare words of every block and, of
    their training tokens there, the class before (0..) and after
    (n_classes..) each, as one binary of u16 numbers."""
    rare = n_classes - 1

    def run(batches):
        import numpy as np

        worker_trim()
        end = classes[index[END]]
        for b in batches:
            for block, words, codes, lengths, held in zip(*(b.column(k) for k in range(5))):
                w = unpacked(words).split(b"\n")
                number = np.fromiter((index.get(x, -1) for x in w), np.int64, len(w))
                code = numbers(codes)
                of = np.where(number >= 0, classes[number], rare)[code]
                mine = np.repeat(~np.array(held.as_py()), np.array(lengths.as_py())) & (number[code] < 0)
                before, after = np.concatenate(([end], of[:-1])), np.concatenate((of[1:], [end]))
                # by word, both classes of a token side by side
                order = np.argsort(code[mine], kind="stable")
                word = code[mine][order]
                near = np.empty((len(word), 2), "<u2")
                near[:, 0], near[:, 1] = before[mine][order], after[mine][order] + n_classes
                raw, at = near.tobytes(), np.flatnonzero(number < 0)
                lo, hi = 4 * np.searchsorted(word, at), 4 * np.searchsorted(word, at, "right")
                del code, of, mine, before, after, order, word, near       # a worker's memory is small
                for x in range(0, len(at), 8_000):
                    part = at[x:x + 8_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([w[q] for q in part.tolist()], pa.binary()),
                         pa.array(np.full(len(part), block.as_py(), np.int64)), pa.array(part.astype(np.int32)),
                         pa.array([raw[s:e] for s, e in zip(lo[x:x + 8_000].tolist(), hi[x:x + 8_000].tolist())],
                                  pa.binary())], ["word", "block", "at", "near"])

    return blocks.select("block", "words", "codes", "lengths", "held").mapInArrow(
        run, "word binary, block long, at int, near binary")


def placed_rare(entries: DataFrame, n_classes: int, bigrams) -> DataFrame:
    """``(n, class, block, at)`` per rare word of the training texts: its
    count, the class that gains the most from it (the rare class if none
    gains more) and its places (arrays).  A rare word is in fewer blocks than
    it has tokens."""
    import numpy as np

    rare = n_classes - 1
    # all rare words move at once: none opens an empty class, where they would meet
    closed = (bigrams.sum(0) + bigrams.sum(1) == 0) | (np.arange(n_classes) == n_classes - 2)
    closed[rare] = False
    words = (entries.groupBy("word").agg(F.collect_list(F.struct("block", "at", "near")).alias("e"))
             .select("e.block", "e.at", "e.near"))

    def run(batches):
        worker_trim()
        for b in (b.slice(lo, 2_000) for b in batches for lo in range(0, b.num_rows, 2_000)):
            lists = b.column(2)
            raw = lists.flatten()
            size = pc.binary_length(raw).to_numpy() // 2
            word = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            tokens = np.bincount(word, size, minlength=b.num_rows).astype(np.int64) // 2
            trained = np.flatnonzero(tokens)              # the others are in held-out texts only
            if not len(trained):
                continue
            number = np.cumsum(tokens > 0) - 1
            flat = np.frombuffer(b"".join(raw.to_pylist()), "<u2")
            key, c = np.unique(number[np.repeat(word, size)] * (2 * n_classes) + flat, return_counts=True)
            first = np.searchsorted(key, np.arange(len(trained)) * (2 * n_classes))
            b, tokens = b.take(pa.array(trained)), tokens[trained]
            best = np.empty(b.num_rows, np.int64)
            for lo, hi, gain in gains(key % (2 * n_classes), c, first, np.append(first[1:], len(key)),
                                      np.full(b.num_rows, rare), bigrams, n_classes):
                gain[:, closed] = -np.inf
                best[lo:hi] = gain.argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(best), b.column(0), b.column(1)],
                                             ["n", "class", "block", "at"])

    return words.mapInArrow(run, "n long, class long, block array<long>, at array<int>")


def class_bigrams(partials: DataFrame, n_classes: int):
    """The class-bigram matrix (one small row per task is summed)."""
    import numpy as np

    total = np.zeros(n_classes ** 2)
    for raw in partials.where("word = -1").select("pairs").toArrow().column(0).to_pylist():
        total += np.frombuffer(raw, dtype=PAIRS)["c"]
    return total.reshape(n_classes, n_classes)


def all_bigrams(coded: DataFrame, end: int, n_classes: int):
    """The class-bigram matrix of blocks ``(cls, codes, lengths, held)`` whose
    words all have their class."""
    import numpy as np

    def run(batches):
        total = np.zeros(n_classes ** 2, np.int64)
        for b in batches:
            for cls, codes, lengths, held in zip(*(b.column(k) for k in range(4))):
                of = np.frombuffer(unpacked(cls), np.uint8).astype(np.int64)[numbers(codes)]
                train = np.repeat(~np.array(held.as_py()), np.array(lengths.as_py()))
                total += np.bincount((np.concatenate(([end], of[:-1])) * n_classes + of)[train], minlength=n_classes ** 2)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    spark = coded.sparkSession
    parts = written(spark, coded.select("cls", "codes", "lengths", "held").mapInArrow(run, "total binary"), "brown-bigrams", 1)
    parts = parts.toArrow()
    total = sum((np.frombuffer(x, np.int64) for x in parts.column(0).to_pylist()), np.zeros(n_classes ** 2))
    return total.reshape(n_classes, n_classes)


def score(spark: SparkSession, docs: DataFrame, n_free: int = CLASSES, sweeps: int = SWEEPS) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score)`` per row of ``docs``.

    Learns from texts whose ``crc32(doc_id as text) mod 10`` is not 0, scores
    all, whole.  Null and empty texts are one end token; a null id counts as
    the empty text in the split; repeated rows are texts of their own; an
    empty table gives no rows; with no training text at all every token has
    the same small probability; further columns are ignored.
    """
    import numpy as np

    blocks = written(spark, coded_blocks(docs), "brown-blocks", DOCS_SENT)
    counted = written(spark, entries(blocks).where("c > 0").groupBy("word").agg(F.sum("c").alias("c")), "brown-words", 1)
    n, v = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # at most 1 / CLASS_SHARE rows
    table = counted.where((F.col("c") >= max(CLASS_SHARE * n, 2)) | (F.col("word") == F.lit(END))).toArrow()
    frequent = list(zip(table.column("word").to_pylist(), table.column("c").to_pylist()))
    frequent.sort(key=lambda x: (-x[1], x[0]))
    if END not in {w for w, _ in frequent}:
        frequent.append((END, 0))
    index = {w: k for k, (w, _) in enumerate(frequent)}
    count = np.array([c for _, c in frequent], np.int64)
    n_classes = n_free + 2
    rare, end = n_classes - 1, n_classes - 2
    # start: the most frequent words alone, all others in the last free class
    classes = np.minimum(np.arange(len(frequent)), n_free - 1)
    classes[index[END]] = end
    for turn in range(sweeps):
        partials = written(spark, neighbours(blocks, index, classes, n_classes), "brown-sweep", 1)
        bigrams = class_bigrams(partials, n_classes)
        # first every word but the classes' first ones leaves the start's heap
        moves = (lambda w: w >= n_free - 1) if turn == 0 else (lambda w, third=turn % 3: w % 3 != third)
        moved = classes.copy()
        found = exchange(partials, classes, n_classes, bigrams, moves).toArrow()   # class-bearing words only
        moved[found.column("word").to_numpy()] = found.column("class").to_numpy()
        classes = moved
        discard(spark, partials)

    def numbered(batches):
        worker_trim()
        for b in batches:
            for k in range(b.num_rows):
                words = unpacked(b.column(1)[k]).split(b"\n")
                number = np.fromiter((index.get(w, -1) for w in words), "<i4", len(words))
                cls = np.where(number >= 0, classes[number], rare).astype(np.uint8)
                part = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([packed(number)], pa.binary()), pa.array([packed(cls)], pa.binary()),
                     *part.columns[2:]], ["block", "number", "cls", *b.schema.names[2:]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    bigrams = all_bigrams(blocks.select("block", "words", "lengths", "held", "codes").mapInArrow(
        numbered, "block long, number binary, cls binary, lengths array<long>, held array<boolean>, codes binary"),
        end, n_classes)
    near = rare_entries(blocks, index, classes, n_classes)
    placed = written(spark, placed_rare(near, n_classes, bigrams), "brown-rare", DOCS_SENT)
    discard(spark, counted)
    rares = (placed.select("n", "class", F.explode(F.arrays_zip("block", "at")).alias("e"))
             .groupBy(F.col("e.block").alias("block"))
             .agg(F.collect_list(F.struct(F.col("e.at").alias("at"), "n", "class")).alias("rares")))

    def joined(batches):
        worker_trim()
        for b in batches:
            for k in range(b.num_rows):
                cls, found = np.frombuffer(unpacked(b.column(2)[k]), np.uint8).copy(), numbers(b.column(3)[k])
                at, n_all, of = (b.column(m)[k].values for m in (4, 5, 6))
                if at is not None and len(at):
                    at = at.to_numpy()
                    found[at], cls[at] = n_all.to_numpy(), of.to_numpy()
                part = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array([packed(cls)], pa.binary()),
                     pa.array([packed(found.astype("<u4"))], pa.binary())], ["block", "number", "cls", "found"])

    # only a block's words meet their places here; the tokens stay in ``blocks``
    # and are not written a second time
    light = blocks.select("block", "words", "counts").mapInArrow(
        numbered, "block long, number binary, cls binary, counts binary")
    tables = written(spark, light.join(rares, "block", "left").select(
        "block", "number", "cls", "counts", "rares.at", "rares.n", "rares.class").mapInArrow(
        joined, "block long, number binary, cls binary, found binary"), "brown-tables", 1)
    kinds_of = [(r["class"], r["count"]) for r in placed.groupBy("class").count().collect()]
    discard(spark, placed)
    ready = blocks.select("block", "doc_ids", "lengths", "held", "codes").join(tables.hint("merge"), "block").select(
        "number", "cls", "doc_ids", "lengths", "held", "found", "codes")
    bigrams = all_bigrams(ready, end, n_classes)
    drop_shuffles(spark)
    # transitions: Witten-Bell with add-one class frequencies
    seen = bigrams.sum(1, keepdims=True)
    kinds = (bigrams > 0).sum(1, keepdims=True)
    apart = (bigrams.sum(0) + 1.0) / (bigrams.sum() + n_classes)
    weight = np.where(seen > 0, seen / np.maximum(seen + kinds, 1), 0.0)
    transition = np.log10(weight * bigrams / np.maximum(seen, 1) + (1 - weight) * apart[None, :])
    of_class = bigrams.sum(0)
    n_class = np.bincount(classes, minlength=n_classes).astype(float)
    for c, n_of in kinds_of:
        n_class[c] += n_of
    n_class[rare] += 1                                   # the unknown word
    below = of_class + ADD * n_class
    emission = np.log10((count + ADD) / below[classes])

    kind_pa = blocks.limit(0).select(F.explode("doc_ids")).toArrow().schema.field(0).type

    def run(batches):
        worker_trim()
        for b in batches:
            for k in range(b.num_rows):
                number, cls, ids, lengths, held, found, codes = (b.column(m)[k] for m in range(7))
                lengths = np.array(lengths.as_py())
                number = np.frombuffer(unpacked(number), "<i4").astype(np.int64)
                cls = np.frombuffer(unpacked(cls), np.uint8).astype(np.int64)
                found = np.where(number >= 0, count[number], numbers(found))
                emit = np.where(number >= 0, emission[number], np.log10((found + ADD) / below[cls]))
                base = np.log10((found + ADD) / (n + ADD * (v + 1)))
                code = numbers(codes)
                of = cls[code]
                before = np.concatenate(([end], of[:-1]))
                starts = np.cumsum(lengths) - lengths
                model = emit[code] + transition[before, of]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids.as_py(), kind_pa), pa.array(held.as_py()), pa.array(lengths),
                    pa.array(np.add.reduceat((found[code] > 0).astype(np.int64), starts)),
                    pa.array(np.full(len(lengths), n, np.int64)),
                    pa.array(np.add.reduceat(base[code], starts)),
                    pa.array(np.add.reduceat(model, starts))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return written(spark, ready.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, "
                                                "train_tokens long, base_score double, score double"), "brown-scores", 1)
