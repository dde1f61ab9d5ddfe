"""BPE as a tokenization automaton.

The automaton reads *tokens*: from its single start state every base symbol
loops.  For each merge ``(u, v) -> x``, in order, the merge gadget takes the
state reached by ``u``, gives ``u`` a state of its own without the ``v`` arc
(the merge would have fired) and adds an ``x`` arc wherever ``u v`` could be
read before, ending where ``v`` ended.  What remains accepts, for every word,
exactly its BPE segmentation.

So a state is known by the last token read.  It is stored as its *cuts* (the
arcs removed, with the merge that removed them) plus the state it was copied
from; an arc ``x`` exists where ``u`` existed when the gadget ran, hence an
arc is present unless a cut hits ``x`` now or its left part at the time ``x``
was added.

``encode_word`` makes the automaton deterministic over characters: a
configuration is the set of partly spelled arcs, and character transitions
are tabled when first taken.  Each prefix of a word has one accepted
segmentation, so walking the last tokens back from the end gives the ids.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Memo, worker_cache, worker_trim

# Pieces between white space that a worker remembers, with 3/8 as many words
# and 1/8 as many tabled configurations (after which the table starts anew):
# about 300 MB a worker; a job that shares its workers' memory asks for fewer.
MEMO = 800_000
OUTPUT_ROWS = 64               # rows of ids handed back at a time


class TokenizationAutomaton:
    """Deterministic BPE automaton over single-character symbols.

    ``symbols``: text of each base token -> id; ``merges``: (left, right,
    joined) ids in order of priority.  ``suffix`` marks the symbol that ends
    a word, as in ``a</w>``.
    """

    def __init__(self, labels: dict[int, str], merges, suffix: str = "", configurations: int = MEMO // 8):
        self.labels, self.suffix, self.most = labels, suffix, max(configurations, 1)
        self.cuts: dict[int, dict[int, int]] = {}      # state of token -> {arc: merge that cut it}
        self.copied: dict[int, tuple[int, int]] = {}   # state of token -> (state copied, when)
        self.left: dict[int, tuple[int, int]] = {}     # arc -> (arc it followed, when added)
        made = set()
        for when, (u, v, x) in enumerate(merges):
            if x not in made:
                self.copied[x] = (v, when)
                self.left[x] = (u, when)
                made.add(x)
            self.cuts.setdefault(u, {}).setdefault(v, when)
        # spelling tree: node -> {character: node}; the last character of a
        # word carries the suffix
        self.tree: list[dict[str, int]] = [{}]
        self.token_at: list[int | None] = [None]
        self.length = {}
        for token, label in labels.items():
            if token not in made and len(label.removesuffix(suffix) if suffix else label) != 1:
                continue                                # neither a symbol nor made by a merge
            node, chars = 0, self.spell(label)
            for c in chars:
                nxt = self.tree[node].get(c)
                if nxt is None:
                    nxt = self.tree[node][c] = len(self.tree)
                    self.tree.append({})
                    self.token_at.append(None)
                node = nxt
            self.token_at[node] = token
            self.length[token] = len(chars)
        self.allowed: dict[tuple[int, int], bool] = {}
        self.reset()

    def spell(self, label: str) -> list[str]:
        s = self.suffix
        if s and label.endswith(s) and len(label) > len(s):
            body = label[:-len(s)]
            return [*body[:-1], body[-1] + s]
        return list(label)

    def reset(self) -> None:
        """Configurations: tuple of (state, spelling-tree node) in progress."""
        self.number = {((None, 0),): 0}
        self.parts = [((None, 0),)]
        self.last: list[int | None] = [None]
        self.table: list[dict[str, int]] = [{}]
        self.allowed.clear()

    def cut_at(self, state: int, arc: int) -> int | None:
        """When ``arc`` was cut from ``state`` or from what it copies."""
        limit, first = float("inf"), None
        while True:
            t = self.cuts.get(state, {}).get(arc)
            if t is not None and t < limit:
                first = t
            if state not in self.copied:
                return first
            state, copied = self.copied[state]
            limit = min(limit, copied)

    def has_arc(self, state: int | None, arc: int) -> bool:
        if state is None:
            return True
        key = (state, arc)
        known = self.allowed.get(key)
        if known is None:
            known, at, limit = True, arc, float("inf")
            while known:
                t = self.cut_at(state, at)
                known = t is None or t > limit
                if at not in self.left:
                    break
                at, limit = self.left[at]
            if len(self.allowed) > 4 * self.most:
                self.allowed.clear()
            self.allowed[key] = known
        return known

    def step(self, at: int, c: str) -> int:
        """Transition that is not tabled yet; -1: no symbol ``c``."""
        parts, last = [], None
        for state, node in self.parts[at]:
            nxt = self.tree[node].get(c)
            if nxt is None:
                continue
            token = self.token_at[nxt]
            if token is not None and self.has_arc(state, token):
                last = token
            if self.tree[nxt]:
                parts.append((state, nxt))
        if last is None:
            self.table[at][c] = -1
            return -1
        key = (*parts, (last, 0))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.parts)
            self.parts.append(key)
            self.last.append(last)
            self.table.append({})
        self.table[at][c] = to
        return to

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one pre-split word, along the one accepted path."""
        if not word:
            return []
        if len(self.parts) > self.most:
            self.reset()
        chars = [*word[:-1], word[-1] + self.suffix]
        table, at, seen = self.table, 0, []
        for c in chars:
            to = table[at].get(c)
            if to is None:
                to = self.step(at, c)
            if to < 0:
                raise ValueError(f"no symbol {c!r} in the vocabulary")
            seen.append(to)
            at = to
        ids, i, last, length = [], len(seen), self.last, self.length
        while i:
            t = last[seen[i - 1]]
            ids.append(t)
            i -= length[t]
        ids.reverse()
        return ids


class BpeCodec:
    """Encodes whole texts as a tokenizer file says, decodes by arc labels.

    The file's normalizer and pre-tokenizer split a text into words; the
    automaton does the rest.  White space never reaches a word, so the text
    is first cut at it and every piece is split and encoded once, then
    remembered.
    """

    # Unicode White_Space beyond what str.split() and the file agree on.  [fixed values]
    CONTROLS = "\x1c\x1d\x1e\x1f"

    def __init__(self, path: str, memo: int = MEMO):
        import re

        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["decoder"] is not None:
            raise ValueError("expects a BPE file whose decoder joins labels by a space")
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.label_of = {str(i): s for i, s in self.labels.items()}
        specials = set(self.special.values())
        self.automaton = TokenizationAutomaton(
            {i: s for i, s in self.labels.items() if i not in specials},
            [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs],
            model.get("end_of_word_suffix") or "", memo // 8)
        self.normalize = tok.normalizer.normalize_str if tok.normalizer else (lambda s: s)
        self.split = tok.pre_tokenizer.pre_tokenize_str
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.gap = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
        self.plain_words = self.plain_splitter(spec)
        self.pieces, self.words = Memo(memo), Memo(memo * 3 // 8)

    @staticmethod
    def plain_splitter(spec):
        """Splitter of pieces below U+0250 (already NFC, lower-cased one by
        one, no U+0130) for files whose rules are lower case, one splitting
        pattern and bytes; None for others, which go through the library."""
        import regex

        if [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])] != [
                "NFC", "Replace", "Lowercase"]:
            return None
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if [x["type"] for x in steps] != ["Split", "ByteLevel"] or steps[1]["use_regex"] \
                or steps[1]["add_prefix_space"] or not steps[0]["invert"]:
            return None
        find = regex.compile(steps[0]["pattern"]["Regex"]).findall
        # printable bytes stand for themselves, the others follow U+0100 in order
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        moved = (b for b in range(256) if b not in kept)
        shown = {b: chr(0x100 + n) for n, b in enumerate(moved)}

        def split(piece: str):
            lower = piece.lower()
            if lower.isalpha():
                found = [lower]
            else:
                found = find(lower)
            if lower.isascii() and lower.isprintable():
                return found
            return [w.encode().decode("latin-1").translate(shown) for w in found]

        return split

    def cut_text(self, text: str) -> list[str]:
        if any(c in text for c in self.CONTROLS):
            return [p for p in self.gap.split(text) if p]
        return text.split()

    def word(self, w: str):
        got = self.words.young.get(w) or self.words.get(w)
        if got is None:
            got = tuple(self.automaton.encode_word(w))
            self.words.put(w, got)
        return got

    def piece_ids(self, piece: str) -> list[int]:
        ids: list[int] = []
        parts = self.at_special.split(piece) if self.at_special and "<" in piece else [piece]
        for part in parts:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                if self.plain_words and max(part) < "\u0250" and "\u0130" not in part:
                    words = self.plain_words(part)
                else:
                    words = [w for w, _ in self.split(self.normalize(part))]
                for w in words:
                    ids.extend(self.word(w))
        return ids

    def rendered(self, piece: str) -> str:
        """Decimal ids of a piece, joined by spaces."""
        out = self.pieces.get(piece)
        if out is None:
            out = " ".join(map(str, self.piece_ids(piece)))
            self.pieces.put(piece, out)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for p in self.cut_text(text) for i in self.piece_ids(p)]

    def decode(self, ids) -> str:
        labels = self.labels
        return " ".join([labels[i] for i in ids])

    def digest(self, text: str):
        """(n_tokens, sha256 of the decimal ids, sha256 of the decoded text)."""
        import hashlib

        known, render = self.pieces.young, self.rendered      # the young generation, as of now
        ids = " ".join([g for g in [known.get(p) or render(p) for p in self.cut_text(text)] if g])
        each = ids.split()
        decoded = " ".join(map(self.label_of.__getitem__, each))
        return (len(each), hashlib.sha256(ids.encode()).hexdigest(),
                hashlib.sha256(decoded.encode()).hexdigest())


def _codec(path: str, memo: int) -> BpeCodec:
    return worker_cache(f"bpe:{memo}:{path}", lambda: BpeCodec(path, memo))


def encode_digests(docs: DataFrame, path: str, memo: int = MEMO) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row.

    Null and empty texts have no tokens and the digests of the empty string;
    rows with a null id and repeated rows are kept; further columns are
    ignored; an empty table gives no rows.  Texts are read whole, one at a
    time; memos and tables of a worker are bounded.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))

    def run(batches):
        codec = _codec(path, memo)
        worker_trim()                      # what building it took, too
        for b in batches:
            got = [codec.digest(t) for t in b.column(1).to_pylist()]
            n, i, d = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str, memo: int = MEMO) -> DataFrame:
    """All columns of ``docs`` but ``text``, plus ``ids array<int>`` and
    ``decoded string``: the training form of every row.  A column of ``docs``
    with one of these names is replaced."""
    keep = [f.name for f in docs.schema if f.name not in ("text", "ids", "decoded")]
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)
    schema = ", ".join(["ids array<int>", "decoded string"] + [
        f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep])

    def run(batches):
        codec = _codec(path, memo)
        worker_trim()                      # what building it took, too
        for b in batches:
            for lo in range(0, b.num_rows, OUTPUT_ROWS):      # bounded output batches
                part = b.slice(lo, OUTPUT_ROWS)
                ids = [codec.encode(t) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(i) for i in ids], pa.string()),
                     *part.columns[1:]], ["ids", "decoded", *keep])

    return rows.mapInArrow(run, schema).select(*keep, "ids", "decoded")
