"""Secret scans through a trigram inverted index.

Every rule's regex is turned into a Boolean query over trigrams that each
match must contain (the published trigram-index method: sets of possible
strings, prefixes and suffixes are combined along the regex's syntax tree).
The index holds, per shard of documents, the positions of the documents that
contain each trigram the rules can ask for, in ASCII lower case.  Postings are
intersected and united shard by shard; the documents found are verified with
the regex over their whole texts.  Rules without a mandatory trigram scan all
documents.

Candidates go by a 64-bit hash of row and text: a collision adds a candidate
and verification removes it, so results are exact.  Only documents whose bit
is set in a bitmap of fixed size are joined with the candidates; all others
are scanned where they were read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial
from re import _constants as sre
from re import _parser as sre_parse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import written

SHARD_ROWS = 1 << 13        # documents of a shard at most
SLICE_BYTES = 1 << 22       # text bytes looked at at a time (and one text)
SET_LIMIT = 16              # strings a set may hold while a query is derived
BITMAP_BITS = 1 << 26       # bits of the candidate bitmap: 2^20 longs
WORD_BITS = 64


@dataclass(frozen=True)
class Rule:
    """``least`` characters of ``group`` (0: the whole match) make a match
    count; matches are leftmost and do not overlap, failing ones take part."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Code-point spans, end exclusive."""
        return [m.span() for m in self.compiled().finditer(text) if len(m.group(self.group)) >= self.least]


# The base rules, in the order of their kinds.  A run of 32 or more is the
# same match as a longest run whose length is tested afterwards.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, least=8, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# Formats that announce themselves.
RULES = BASE + (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("hub_token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,})"),
    Rule("chat_token", r"\bxox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("live_key", r"\b[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("map_key", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("login_url", r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x09-\x0D\x20/:@]{1,64}:[^\x09-\x0D\x20/@]{4,128}@[A-Za-z0-9]"),
)

# ------------------------------------------------------------ trigram queries
# A query is True (anything may match), a trigram, or ("and"/"or", queries).


def _needs(q) -> frozenset:
    """The parts that must all hold; none known of an alternative."""
    if isinstance(q, tuple):
        return q[1] if q[0] == "and" else frozenset()
    return frozenset({q})


def _join(op: str, parts) -> object:
    flat = set()
    for q in parts:
        if q is True:
            if op == "or":
                return True
        elif isinstance(q, tuple) and q[0] == op:
            flat |= q[1]
        else:
            flat.add(q)
    if op == "or":       # a or (a and b) is a
        flat = {q for q in flat if not any(_needs(q) > _needs(x) for x in flat if _needs(x))}
    if not flat:
        return True
    return flat.pop() if len(flat) == 1 else (op, frozenset(flat))


def _grams(s: str):
    return _join("and", [s[i:i + 3] for i in range(len(s) - 2)])


def _any_of(strings):
    return _join("or", [_grams(s) if len(s) >= 3 else True for s in strings])


@dataclass(frozen=True)
class _Info:
    """What is known of a piece of regex: all its strings, if few, or else
    how its matches begin and end, and a query that each of them meets."""

    exact: frozenset | None
    prefix: frozenset = frozenset({""})
    suffix: frozenset = frozenset({""})
    query: object = True

    def starts(self):
        return self.prefix if self.exact is None else self.exact

    def stops(self):
        return self.suffix if self.exact is None else self.exact


def _short(strings, end: bool):
    """At most two characters of each: enough to make trigrams across."""
    cut = frozenset(s[-2:] if end else s[:2] for s in strings)
    return cut if len(cut) <= SET_LIMIT else frozenset({""})


_NOTHING = _Info(frozenset({""}))
_ANY = _Info(None)


def _concat(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= SET_LIMIT:
        return _Info(frozenset(x + y for x in a.exact for y in b.exact))
    parts = [a.query, b.query] + [_any_of(i.exact) for i in (a, b) if i.exact is not None]
    ends, begins = a.stops(), b.starts()
    if len(ends) * len(begins) <= SET_LIMIT:
        parts.append(_any_of(x + y for x in ends for y in begins))
    if a.exact is not None and len(a.exact) * len(begins) <= SET_LIMIT:
        prefix = frozenset(x + y for x in a.exact for y in begins)
    else:
        prefix = a.starts()
    if b.exact is not None and len(ends) * len(b.exact) <= SET_LIMIT:
        suffix = frozenset(x + y for x in ends for y in b.exact)
    else:
        suffix = b.stops()
    return _Info(None, _short(prefix, False), _short(suffix, True), _join("and", parts))


def _either(infos: list[_Info]) -> _Info:
    if all(i.exact is not None for i in infos):
        every = frozenset().union(*[i.exact for i in infos])
        if len(every) <= SET_LIMIT:
            return _Info(every)
    queries = [i.query if i.exact is None else _any_of(i.exact) for i in infos]
    return _Info(None, _short(frozenset().union(*[i.starts() for i in infos]), False),
                 _short(frozenset().union(*[i.stops() for i in infos]), True), _join("or", queries))


def _characters(items) -> frozenset | None:
    """Lower-case characters of a class, or None if they are too many."""
    out = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(arg)
        elif op is sre.RANGE and arg[1] - arg[0] < 2 * SET_LIMIT:
            out |= set(range(arg[0], arg[1] + 1))
        else:            # negated sets and categories
            return None
    low = frozenset(chr(c).lower() if c < 128 else chr(c) for c in out)
    return low if len(low) <= SET_LIMIT else None


def _info(node) -> _Info:
    op, arg = node
    if op is sre.LITERAL:
        return _Info(frozenset({chr(arg).lower() if arg < 128 else chr(arg)}))
    if op is sre.IN:
        chars = _characters(arg)
        return _ANY if chars is None else _Info(chars)
    if op is sre.AT:                       # \b, ^, $: no characters
        return _NOTHING
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        return _either([_sequence(x) for x in arg[1]])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, body = arg
        once = _sequence(body)
        if most == 1:
            return once if least else _either([_NOTHING, once])
        if least == 0:
            return _ANY
        # once or more: the first and the last time are known
        whole = once
        for _ in range(min(least, 3) - 1):
            whole = _concat(whole, once)
        if least == most and least <= 3:
            return whole
        q = whole.query if whole.exact is None else _any_of(whole.exact)
        return _Info(None, _short(whole.starts(), False), _short(whole.stops(), True), q)
    return _ANY                            # lookarounds, back references, any character


def _sequence(nodes) -> _Info:
    out = _NOTHING
    for node in nodes:
        out = _concat(out, _info(node))
    return out


def trigram_query(rule: Rule):
    """The Boolean trigram query of a rule over ASCII lower-case text; True
    where no trigram is mandatory."""
    i = _sequence(sre_parse.parse(rule.pattern, re.ASCII))
    q = i.query if i.exact is None else _any_of(i.exact)
    return _bytes_query(q)


def _bytes_query(q):
    """Trigrams of characters as trigrams of their UTF-8 bytes."""
    if q is True:
        return True
    if isinstance(q, tuple):
        return _join(q[0], [_bytes_query(x) for x in q[1]])
    b = q.encode()
    return _join("and", [b[i:i + 3] for i in range(len(b) - 2)])


def grams_of(q) -> set[bytes]:
    if q is True:
        return set()
    return set().union(*[grams_of(x) for x in q[1]]) if isinstance(q, tuple) else {q}


# ------------------------------------------------------------------- the index
INDEX = "shard long, gram binary, data binary"
KEYS = b""      # the row that holds a shard's document keys


def _lower_table():
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return low


def _postings(texts: list[bytes], table: np.ndarray, low: np.ndarray):
    """``(trigram number, text number)`` of all that occur, distinct."""
    grams, owners, at = [], [], 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (size == 0 or size + len(texts[stop]) <= SLICE_BYTES):
            size += len(texts[stop]) + 3
            stop += 1
        # zero bytes between texts keep trigrams inside them; one long text
        # is cut with two bytes of overlap
        joined = low[np.frombuffer(b"\0\0\0".join(texts[at:stop]), np.uint8)]
        ends = np.cumsum(np.array([len(t) + 3 for t in texts[at:stop]]))
        for lo in range(0, max(len(joined) - 2, 0), SLICE_BYTES):
            b = joined[lo:lo + SLICE_BYTES + 2].astype(np.uint32)
            found = table[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]]
            hits = np.flatnonzero(found)
            grams.append(found[hits].astype(np.int64) - 1)
            owners.append(np.searchsorted(ends, hits + lo, side="right") + at)
        at = stop
    if not grams:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    both = np.unique(np.concatenate(grams) * len(texts) + np.concatenate(owners))
    return both // len(texts), both % len(texts)


def _index_batches(batches, grams: list[bytes]):
    codes = np.array([int.from_bytes(g, "big") for g in grams], np.int64)
    table = np.zeros(1 << 24, np.uint16)
    table[codes] = np.arange(1, len(grams) + 1)
    low = _lower_table()
    task = TaskContext.get().partitionId() << 32
    number = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, SHARD_ROWS):
            part = batch.slice(lo, SHARD_ROWS)
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(1)]
            g, owner = _postings(texts, table, low)
            cuts = np.flatnonzero(np.diff(g)) + 1
            names = [KEYS] + [grams[x] for x in g[np.r_[0, cuts]]] if len(g) else [KEYS]
            data = [part.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()]
            if len(g):
                data += [x.astype("<u2").tobytes() for x in np.split(owner, cuts)]
            yield pa.record_batch([pa.array([task | number] * len(names), pa.int64()), pa.array(names, pa.binary()),
                                   pa.array(data, pa.binary())], ["shard", "gram", "data"])
            number += 1


def row_key():
    return F.xxhash64("doc_id", "text")


def build_index(spark: SparkSession, docs: DataFrame, rules=RULES) -> DataFrame:
    """Postings ``(shard, gram, data)`` of ``docs(doc_id, text)``, written:
    ``data`` holds the positions in the shard of the documents with the
    trigram (two bytes each); the row of the empty trigram holds the shard's
    keys.  Every byte of every text is looked at."""
    grams = sorted(set().union(*[grams_of(trigram_query(r)) for r in rules]))
    rows = docs.select(row_key().alias("key"), F.col("text").cast("binary").alias("text"))
    return written(spark, rows.mapInArrow(partial(_index_batches, grams=grams), INDEX), "trigram-index")


def _found(q, postings, size: int) -> np.ndarray:
    """Positions that meet a query: postings intersected and united."""
    if isinstance(q, bytes):
        return postings.get(q, np.empty(0, np.uint16))
    parts = [_found(x, postings, size) for x in q[1]]
    if q[0] == "or":
        return np.unique(np.concatenate(parts))
    parts.sort(key=len)
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True)
    return out


def _candidates_of_shard(pdf: pd.DataFrame, queries) -> pd.DataFrame:
    postings = {bytes(g): np.frombuffer(d, "<u2") for g, d in zip(pdf["gram"], pdf["data"]) if bytes(g) != KEYS}
    keys = np.frombuffer(next(d for g, d in zip(pdf["gram"], pdf["data"]) if bytes(g) == KEYS), "<i8")
    mask = np.zeros(len(keys), np.int64)
    for bit, q in queries:
        mask[_found(q, postings, len(keys))] |= 1 << bit
    hit = mask != 0
    return pd.DataFrame({"key": keys[hit], "mask": mask[hit]})


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """``(key, mask)``: documents that may match, bit ``r`` for rule ``r``.
    Rules without mandatory trigrams are not asked.  A group is one shard."""
    queries = [(r, q) for r, q in enumerate(trigram_query(x) for x in rules) if q is not True]
    asked = sorted({KEYS}.union(*[grams_of(q) for _, q in queries]))

    def of_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        return _candidates_of_shard(pdf, queries)

    return (index.where(F.col("gram").isin([F.lit(g) for g in asked])).groupBy("shard")
            .applyInPandas(of_shard, "key long, mask long")
            .groupBy("key").agg(F.bit_or("mask").alias("mask")))


def _bitmap(found: DataFrame) -> DataFrame:
    """Candidate keys as at most ``BITMAP_BITS / 64`` rows ``(word, bits)``:
    small enough to broadcast whatever the number of candidates."""
    at = F.pmod("key", F.lit(BITMAP_BITS))
    return (found.select(F.floor(at / WORD_BITS).alias("word"), F.expr(f"shiftleft(1L, int(pmod(key, {WORD_BITS})))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")))


SPANS = "array<struct<kind: string, start: int, stop: int>>"
FOUND = f"doc_id long, spans {SPANS}"


def _verify(batches, rules, full: int):
    tests = [(r.kind, 1 << k, r.compiled(), r.group, r.least) for k, r in enumerate(rules)]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        ids, masks = batch.column(0), batch.column(2).to_pylist()
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            out = []
            for text, mask in zip(part.column(1), masks[lo:lo + 1024]):
                t, spans = text.as_py() or "", []
                for order, (name, bit, regex, group, least) in enumerate(tests):
                    if (mask | full) & bit:
                        spans += [(m.start(), order, name, m.end()) for m in regex.finditer(t)
                                  if len(m.group(group)) >= least]
                out.append([{"kind": n, "start": s, "stop": e} for s, _, n, e in sorted(spans)])
            yield pa.record_batch([part.column(0).cast(pa.int64()), pa.array(out, kind)], ["doc_id", "spans"])


def scan(spark: SparkSession, docs: DataFrame, rules=RULES) -> DataFrame:
    """``(doc_id, spans)``, one row per document: all spans of all rules in
    code points, end exclusive, by start and then rule.

    Null texts are empty; null and repeated ids and repeated rows are
    documents of their own; columns beside id and text are ignored; an empty
    table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    full = sum(1 << k for k, r in enumerate(rules) if trigram_query(r) is True)
    found = written(spark, candidates(build_index(spark, docs, rules), rules), "secret-candidates")
    keyed = docs.withColumn("key", row_key())
    at = F.pmod("key", F.lit(BITMAP_BITS))
    marked = (keyed.withColumn("word", F.floor(at / WORD_BITS)).join(F.broadcast(_bitmap(found)), "word", "left")
              .withColumn("maybe", F.coalesce(F.expr(f"getbit(bits, int(pmod(key, {WORD_BITS})))"), F.lit(0).cast("tinyint"))))
    check = partial(_verify, rules=rules, full=full)
    apart = marked.where("maybe = 0").select("doc_id", "text", F.lit(0).cast("long").alias("mask"))
    joined = (marked.where("maybe = 1").select("doc_id", "text", "key").join(found, "key", "left")
              .select("doc_id", "text", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")))
    return apart.mapInArrow(check, FOUND).unionAll(joined.mapInArrow(check, FOUND))


def digests(found: DataFrame, base=BASE) -> DataFrame:
    """Spans as text ``kind:start:end``, comma-joined, and counts and hash of
    those of the base kinds."""
    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    kinds = [r.kind for r in base]
    plain = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select(
        "doc_id", *[count(k) for k in kinds],
        F.sha2(text(plain), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def oracle(rules=RULES, base=BASE) -> str:
    """DuckDB SQL with the rows of ``digests(scan(documents))``: a span
    starts after all pieces and matches before it."""
    def pattern(r: Rule) -> str:
        if not r.any_case:
            return r.pattern
        words, rest = r.pattern.split(")", 1)        # letters of the leading words only, ASCII ones
        return re.sub("[a-z]", lambda m: f"[{m.group()}{m.group().upper()}]", words) + ")" + rest

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    spans = []
    for order, r in enumerate(rules):
        p = quoted(pattern(r))
        spans.append(f"""
SELECT rid, {order} AS ord, '{r.kind}' AS kind, (list_sum(list_transform(ps[1:k], lambda x: length(x)))
         + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))::BIGINT AS start, ms[k] AS m
FROM (SELECT rid, ms, ps, unnest(range(1, len(ms) + 1)) AS k FROM (
        SELECT rid, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS ps FROM d) WHERE len(ms) > 0)
WHERE length(regexp_extract(ms[k], {p}, {r.group})) >= {r.least}""")
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{r.kind}'), 0) AS n_{r.kind}" for r in base)
    one = "kind || ':' || start || ':' || (start + length(m))"
    kinds = ", ".join(f"'{r.kind}'" for r in base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(spans)}),
g AS (SELECT rid, {counts}, string_agg({one}, ',' ORDER BY start, ord) FILTER (kind IN ({kinds})) AS plain,
             string_agg({one}, ',' ORDER BY start, ord) AS spans FROM s GROUP BY rid)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in base)},
       sha256(coalesce(plain, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""
