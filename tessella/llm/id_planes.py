"""Token ids as bit-plane or byte-plane shuffled files.

Ids are cut into blocks of ``BLOCK`` ids.  A block of little-endian unsigned
32-bit ids is transposed into byte planes (all lowest bytes, then all second
bytes, ...) or bit planes, and each plane is compressed with zstandard on its
own: high planes are nearly constant and shrink to a few bytes.  Planes of
zeros only are stored as length 0.

A file image is::

    b"IDPL" version=1 kind(8 or 1) planes zero        4 + 4 bytes
    plane bytes of block 0, block 1, ...              zstandard frames
    document table: ids (zigzag 0 = null) and lengths  two zstandard frames
    chunk index: per block (offset u64, first id u64, ids u32, plane lengths u32 * planes)
    footer: n_blocks u64, index offset u64, doc ids offset u64, lengths offset u64,
            n_docs u64, n_ids u64, b"IDPL"

Images are the ``payload`` column of a Parquet table, one row per file, so
Spark's committer places them on any file system and a lost executor's task
is simply written again.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import id_bounds, range_of, worker_cache, written

MAGIC = b"IDPL"
BLOCK = 1 << 16
SHARD_IDS = 1 << 22        # a file is closed after the document that reaches this many ids
FOOTER = "<6Q4s"
END_ID = 0
TOGETHER = 32              # texts encoded at a time
MAX_PIECES = 1_250_000     # remembered pieces per worker, then the memo starts anew


class PieceEncoder:
    """Whole texts to ids with the tokenizers library.

    A byte-level file never joins a non-blank run with the white space after
    it, so a text is cut there and every distinct piece goes through the
    library once.  Texts that hold a special token go through it whole.
    """

    # Unicode White_Space, as the library's pattern sees it.  [fixed values]
    GAP = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

    MARKS = ".,;:!?%&$*#|()[]{}<>/\\\"'-+=~_@^`"

    def __init__(self, path: str):
        import os
        import re

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        g = self.GAP
        self.find = re.compile(f" ?[^{g}]+|[{g}]+(?![^{g}])|[{g}]").findall
        # a byte-level label has one character for each byte
        self.n_bytes = np.zeros(self.tok.get_vocab_size() + 1, np.int64)
        for label, i in self.tok.get_vocab().items():
            self.n_bytes[i] = len(label)
        self.odd = re.compile("[" + g.replace(" ", "").replace("\\t-\\r", "\\t\\x0b-\\r") + "]").search
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}     # by the piece without its space

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def plain(self, text: str) -> bool:
        """Only single spaces and single line ends: ``split`` finds the pieces."""
        return not ("  " in text or "\n\n" in text or " \n" in text or text[-1:] in (" ", "\n")
                    or self.odd(text) or any([s in text for s in self.special]))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        known, spaced = self.known, self.spaced
        if len(known) + len(spaced) >= MAX_PIECES:
            known.clear()
            spaced.clear()
        cut, new, after = [], set(), set()
        for t in texts:
            if self.plain(t):
                # a line's first piece stands alone, the others follow a space
                lines = [line.split(" ") for line in t.split("\n")]
                for line in lines:
                    after.update(line[1:])
                new.update([line[0] for line in lines])
                cut.append((True, lines))
            elif any([s in t for s in self.special]):
                cut.append((None, t))
            else:
                pieces = self.find(t)
                new.update(pieces)
                cut.append((False, pieces))
        new.add("\n")
        # letters followed by marks are two runs to the file's pattern: only
        # unknown letters and marks need the library
        missing, ended = after.difference(spaced), []
        for p in list(missing):
            core = p.rstrip(self.MARKS)
            if core is not p and core.isalpha():
                missing.discard(p)
                ended.append((p, core, p[len(core):]))
        missing.update([c for _, c, _ in ended if c not in spaced])
        new.update([m for _, _, m in ended])
        self.learn(list(missing))
        rest = list(new.difference(known))
        for p, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False)):
            known[p] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        for p, core, marks in ended:
            spaced[p] = spaced[core] + known[marks]
        out = []
        follow, end = spaced.__getitem__, known["\n"]
        for plain, got in cut:
            if plain:
                out.append(end.join([known[line[0]] + b"".join(map(follow, line[1:])) for line in got]))
            elif plain is None:
                ids = self.tok.encode(got, add_special_tokens=False).ids
                out.append(struct.pack(f"<{len(ids)}I", *ids))
            else:
                out.append(b"".join([known[p] for p in got]))
        return out

    def learn(self, new: list[str]) -> None:
        """Encodes pieces that follow a space: as one text, where each one's
        ids are told by the bytes they stand for, or else one by one."""
        import numpy as np

        if not new:
            return
        text = [" " + p for p in new]
        ids = np.array(self.tok.encode_batch_fast(["".join(text)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum([len(p.encode()) for p in text])
        reach = np.cumsum(self.n_bytes[ids])
        at = np.searchsorted(reach, ends)
        if at[-1] == len(ids) - 1 and np.array_equal(reach[at], ends):
            raw, lo = ids.tobytes(), 0
            for p, hi in zip(new, (4 * (at + 1)).tolist()):
                self.spaced[p] = raw[lo:hi]
                lo = hi
        else:
            for p, e in zip(new, self.tok.encode_batch_fast(text, add_special_tokens=False)):
                self.spaced[p] = struct.pack(f"<{len(e.ids)}I", *e.ids)


def planes_of(ids, kind: int) -> list[bytes]:
    """Byte planes (kind 8) or bit planes (kind 1) of a uint32 block; planes
    above the largest id's highest bit are empty."""
    import numpy as np

    ids = np.ascontiguousarray(ids, dtype="<u4")
    used = int(ids.max(initial=0)).bit_length()     # higher planes are all zeros
    flat = ids.view(np.uint8).reshape(-1, 4)
    out = []
    for k in range(4):
        p = flat[:, k] if 8 * k < used else None
        if kind == 8:
            out.append(b"" if p is None else p.tobytes())
        else:
            out += [np.packbits((p >> b) & 1, bitorder="little").tobytes() if 8 * k + b < used else b""
                    for b in range(8)]
    return out


def block_of(planes: list[bytes], n: int, kind: int):
    """Inverse of ``planes_of``; an empty plane is all zeros."""
    import numpy as np

    out = np.zeros((n, 4), np.uint8)
    for k, p in enumerate(planes):
        if not p:
            continue
        if kind == 8:
            out[:, k] = np.frombuffer(p, np.uint8)
        else:
            bits = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
            out[:, k // 8] |= bits << (k % 8)
    return out.view("<u4").reshape(-1)


def write_image(doc_ids, lengths, ids, kind: int = 8, block: int = BLOCK, level: int = 1) -> bytes:
    """One file image; ``doc_ids`` may hold None."""
    import numpy as np
    import zstandard

    z = zstandard.ZstdCompressor(level=level, write_content_size=True)
    ids = np.asarray(ids, dtype="<u4")
    n_planes = 32 // kind
    out = [MAGIC, bytes([1, kind, n_planes, 0])]
    at = 8
    index = []
    for lo in range(0, len(ids), block):
        part = ids[lo:lo + block]
        packed = [z.compress(p) if p.count(0) < len(p) else b"" for p in planes_of(part, kind)]
        index.append(struct.pack(f"<QQI{n_planes}I", at, lo, len(part), *map(len, packed)))
        out += packed
        at += sum(map(len, packed))
    zig = b"".join(struct.pack("<?q", d is not None, d or 0) for d in doc_ids)
    docs, lens = z.compress(zig), z.compress(np.asarray(lengths, dtype="<u8").tobytes())
    docs_at, lens_at = at, at + len(docs)
    index_at = lens_at + len(lens)
    out += [docs, lens, *index, struct.pack(FOOTER, len(index), index_at, docs_at, lens_at,
                                            len(lengths), len(ids), MAGIC)]
    return b"".join(out)


def read_image(data: bytes, blocks=None):
    """``(doc_ids, lengths, ids)``; ``blocks`` picks chunk numbers by the index."""
    import numpy as np
    import zstandard

    n_blocks, index_at, docs_at, lens_at, n_docs, n_ids, magic = struct.unpack(FOOTER, data[-struct.calcsize(FOOTER):])
    if data[:4] != MAGIC or magic != MAGIC or data[4] != 1:
        raise ValueError("not an id-plane file")
    kind, n_planes = data[5], data[6]
    z = zstandard.ZstdDecompressor()
    entry = struct.Struct(f"<QQI{n_planes}I")
    got = []
    for k in range(n_blocks) if blocks is None else blocks:
        at, _, n, *sizes = entry.unpack_from(data, index_at + k * entry.size)
        planes = []
        for s in sizes:
            planes.append(z.decompress(data[at:at + s]) if s else b"")
            at += s
        got.append(block_of(planes, n, kind))
    ids = np.concatenate(got) if got else np.zeros(0, "<u4")
    doc_ids = [d if there else None for there, d in struct.iter_unpack("<?q", z.decompress(data[docs_at:lens_at]))]
    lengths = np.frombuffer(z.decompress(data[lens_at:index_at]), "<u8").astype(np.int64)
    return doc_ids, lengths, ids


def write_ids(spark: SparkSession, docs: DataFrame, path: str, kind: int = 8,
              shard_ids: int = SHARD_IDS, end_id: int | None = END_ID) -> DataFrame:
    """Encodes whole texts in ascending ``doc_id`` order (null first, ties by
    text), appends ``end_id`` to each and writes file images; returns the
    table ``(part, seq, n_ids, payload)`` that was written.

    Null and empty texts give just the end id; an empty table gives no file.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("t"))
    # ranges of ids from the id column alone: sampling whole rows would read every text twice
    bounds = id_bounds(docs.select(F.col("doc_id").cast("long").alias("doc_id")),
                       int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = (rows.repartitionById(len(bounds) + 1, range_of(bounds).cast("int"))
               .sortWithinPartitions("doc_id", "t"))
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        enc = worker_cache(f"pieces:{path}", lambda: PieceEncoder(path))
        part = TaskContext.get().partitionId()
        seq, ids, docs_, lens, n = 0, [], [], [], 0

        def image():
            flat = np.frombuffer(b"".join(ids), "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([n], pa.int64()),
                 pa.array([write_image(docs_, lens, flat, kind)], pa.binary())],
                ["part", "seq", "n_ids", "payload"])

        for b in batches:
            for lo in range(0, b.num_rows, TOGETHER):
                some = b.slice(lo, TOGETHER)
                for d, e in zip(some.column(0).to_pylist(), enc.encode_many(some.column(1).to_pylist())):
                    ids.append(e + end)
                    docs_.append(d)
                    lens.append((len(e) + len(end)) // 4)
                    n += lens[-1]
                    if n >= shard_ids:
                        yield image()
                        seq, ids, docs_, lens, n = seq + 1, [], [], [], 0
        if docs_:
            yield image()

    images = ordered.mapInArrow(run, "part int, seq int, n_ids long, payload binary")
    return written(spark, images, "id-planes")


def read_documents(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` read back from the files:
    ``start`` counts the ids of all documents before, ``ids_crc32`` is the
    unsigned CRC-32 of the document's ids as little-endian u32."""
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))        # one row per write task
    before = totals.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("p"))
    base = (files.select("part", "seq", "n_ids").withColumn("s", F.coalesce(F.sum("n_ids").over(
        Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(before, "part").select("part", "seq", (F.col("p") + F.col("s")).alias("base")))

    def run(batches):
        import zlib

        import numpy as np

        for b in batches:
            for part, seq, payload in zip(*(b.column(i) for i in range(3))):
                doc_ids, lengths, ids = read_image(payload.as_py())
                stop = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n:e].tobytes()) for n, e in zip(lengths.tolist(), stop.tolist())]
                k = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * k, pa.int32()), pa.array([seq.as_py()] * k, pa.int32()),
                     pa.array(doc_ids, pa.int64()), pa.array(stop - lengths), pa.array(lengths),
                     pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"])

    read = files.select("part", "seq", "payload").mapInArrow(
        run, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return read.join(base, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
