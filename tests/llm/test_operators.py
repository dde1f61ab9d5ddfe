"""The training-data operators against brute-force versions on small tables,
with nulls, empty texts, repeats, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash

from tessella.llm import (bpe_automaton, brown_lm, components, id_planes, imatch, mixing, passages, pivot_index,
                          queries, quotes, simhash_trie, toxicity)

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "fp long, label int, size long, start long, word string, block long, t string")


def words(n, seed, vocab=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocab)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    a = " ".join(words(120, 1))
    b = a.replace("w1 ", "zz ", 1)
    shared = " ".join(words(70, 2))
    return [a, a, b, "", None, "one", "ONE", " \n\t ", "x y", " ".join(words(5000, 3)),
            " ".join(words(40, 4)) + "\n" + shared + " " + " ".join(words(30, 5)),
            " ".join(words(60, 6)) + " " + shared, "Straße ÉÉ don't 12½ <|endoftext|> 　z\x85q", "the " * 300,
            " ".join(words(90, 7)) + "  " + " ".join(words(50, 8))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en", f"s{k % 4}" if k % 5 else None, None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[0], rows[3], (None, "a null id", "en", "s1", 9)]
    return spark.createDataFrame([r + (1, 2, 3, 4, "w", 5, "t") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_simhash_matches_all_pairs(spark, docs, empty):
    def fingerprint(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        n = max(len(w) - 2, 1)
        h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(n)]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > n)

    rows = docs.select("doc_id", "text").collect()
    fps = [fingerprint(r.text) for r in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    least = collections.defaultdict(list)
    for r, c in zip(rows, comp):
        least[c].append(r.doc_id)
    want = sorted((str(r.doc_id), f"{f:016x}", str(min((x for x in least[c] if x is not None), default=None)))
                  for r, f, c in zip(rows, fps, comp))
    for hot in (1 << 20, 0):      # 0: every subtree is cut again
        got = simhash_trie.simhash_components(spark, docs, hot_rows=hot).collect()
        assert sorted((str(g.doc_id), g.fingerprint, str(g.component_id)) for g in got) == want
    assert simhash_trie.simhash_components(spark, empty).count() == 0
    kept = simhash_trie.keep_one_per_component(spark, docs)
    assert kept.columns == docs.columns and kept.count() == len(set(comp))


def test_trie_join_finds_every_pair_of_random_values():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    v = base.copy()
    for _ in range(6):
        v = np.concatenate([v, base ^ (np.uint64(1) << r.integers(0, 64, 60, dtype=np.uint64))
                            ^ (np.uint64(1) << r.integers(0, 64, 60, dtype=np.uint64))])
    v = np.unique(v)
    got = set()
    for x, y in simhash_trie.trie_pairs(v, (np.array([0]), np.array([len(v)])), 0, 3):
        got |= set(zip(x.tolist(), y.tolist()))
    d = np.bitwise_count(v[:, None] ^ v[None, :])
    assert got == {(i, j) for i, j in zip(*np.nonzero(d <= 3)) if i < j}


def test_memo_drops_the_unused_half():
    from tessella.llm.common import Memo

    memo = Memo(8)
    for k in range(20):
        memo.put(k, str(k))
        assert memo.get(0) in ("0", None) and memo.get(k) == str(k)
        assert len(memo.young) + len(memo.old) <= 8
    memo = Memo(8)
    for k in range(100):
        memo.put(k, k + 1)
        assert k == 0 or memo.get(0) == 1         # what is asked for stays


def test_tokens_do_not_depend_on_the_memo(texts):
    path = queries.tokenizer_path("word_bpe_49k.json")
    large, small = bpe_automaton.BpeCodec(path), bpe_automaton.BpeCodec(path, 16)
    for t in texts * 2:
        assert small.encode(t or "") == large.encode(t or "") and small.digest(t or "") == large.digest(t or "")


def test_components(spark):
    e = spark.createDataFrame([(9, 8), (8, 7), (7, 3), (5, 5), (20, 30), (30, 20), (None, 4)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(spark, e).collect()}
    assert got == {9: 3, 8: 3, 7: 3, 3: 3, 20: 20, 30: 20}


def test_tokens_equal_the_library(spark, docs, empty, texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    codec = bpe_automaton.BpeCodec(path)
    r = random.Random(3)
    bits = [*"abcdeaaabbéÉΣσİß'st 1²½３中文́\x1c\x85 \n<|>.,!—", "<|endoftext|>", "'re", " don't", "the", "ing"]
    many = [t or "" for t in texts] + ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(500)]
    for t in many:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids
        assert codec.decode(ids) == tok.decode(ids, skip_special_tokens=False)
    got = bpe_automaton.encode_digests(docs, path).collect()
    assert len(got) == docs.count()
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    by_id = {g.doc_id: g for g in got}
    for k, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert (by_id[k].n_tokens, by_id[k].ids_sha256) == (len(ids), h(" ".join(map(str, ids))))
        assert by_id[k].decoded_sha256 == h(tok.decode(ids, skip_special_tokens=False))
    assert bpe_automaton.encode_digests(empty, path).count() == 0
    assert bpe_automaton.encode_documents(docs, path).count() == docs.count()
    many = spark.range(1000).selectExpr("id as doc_id", "concat('text ', id) as text").repartition(2)
    out = bpe_automaton.encode_documents(many, path).collect()       # more rows than one output batch
    assert sorted(r.doc_id for r in out) == list(range(1000))
    assert all(r.ids == tok.encode(f"text {r.doc_id}", add_special_tokens=False).ids for r in out)


def test_automaton_on_repeated_symbols():
    labels = {0: "a", 1: "b", 2: "aa", 3: "ab", 4: "aaab"}
    auto = bpe_automaton.TokenizationAutomaton(labels, [(0, 0, 2), (0, 1, 3), (2, 3, 4)])
    assert auto.encode_word("aaa") == [2, 0]
    assert auto.encode_word("aaab") == [4]
    assert auto.encode_word("abaa") == [3, 2]
    with pytest.raises(ValueError):
        auto.encode_word("c")


@pytest.mark.parametrize("kind", [8, 1])
def test_id_files_round_trip(kind):
    r = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (70_000, 50_257), (5, 1 << 32)):
        ids = r.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        image = id_planes.write_image([3, None], [n, 0], ids, kind, block=1 << 10)
        got, lengths, back = id_planes.read_image(image)
        assert got == [3, None] and lengths.tolist() == [n, 0] and np.array_equal(back, ids)
        if n > 4096:
            assert np.array_equal(id_planes.read_image(image, [2])[2], ids[2048:3072])


def test_id_files_match_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    enc = id_planes.PieceEncoder(path)
    r = random.Random(4)
    bits = [*"abé'st 1½本\x1c\x85　  \n\n\t\r<|>.,!", "<|endoftext|>", "'re", " the"]
    for _ in range(1500):
        t = "".join(r.choice(bits) for _ in range(r.randrange(25)))
        ids = tok.encode(t, add_special_tokens=False).ids
        assert enc.encode(t) == struct.pack(f"<{len(ids)}I", *ids), repr(t)
    got = id_planes.read_documents(id_planes.write_ids(spark, docs, path, shard_ids=500)).orderBy("start").collect()
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda x: (x.doc_id is not None, x.doc_id or 0, x.text or ""))
    at = 0
    for g, row in zip(got, rows, strict=True):
        ids = tok.encode(row.text or "", add_special_tokens=False).ids + [0]
        assert (g.doc_id, g.start, g.n_tokens) == (row.doc_id, at, len(ids))
        assert g.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        at += len(ids)
    assert id_planes.read_documents(id_planes.write_ids(spark, empty, path)).count() == 0


def test_brown_scores(spark, docs, empty):
    got = brown_lm.score(spark, docs, 4, 2).collect()
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.select("doc_id", "text").collect()]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = collections.Counter()
    for d, w in rows:
        if not held(d):
            c.update([*w, "END"])
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(w) + 1, sum(c[x] > 0 for x in [*w, "END"]), n, round(sum(
        math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, "END"]), 6)) for d, w in rows)
    assert sorted((str(g.doc_id), g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6))
                  for g in got) == want
    assert all(g.score <= 0 and math.isfinite(g.score) for g in got)
    assert brown_lm.score(spark, empty, 4, 1).count() == 0


def test_brown_rare_words_take_the_class_of_their_neighbours(spark, monkeypatch):
    # a, b, P and Q are frequent; P and p words stand after a, Q and q words after b
    monkeypatch.setattr(brown_lm, "CLASS_SHARE", 0.05)
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    train = [d for d in range(300) if not held(d)][:200]
    rows = [(d, ("a p" if n % 2 else "b q") + (f"{n // 2 % 20}" if n % 5 < 2 else "")) for n, d in enumerate(train)]
    asked = [d for d in range(300) if held(d)][:2]
    number = next(n // 2 % 20 for n in range(200) if n % 5 < 2 and n % 2 and f"b q{n // 2 % 20}" in {t for _, t in rows})
    rows += [(asked[0], f"a p{number}"), (asked[1], f"a q{number}")]
    got = {r.doc_id: r.score for r in brown_lm.score(spark, spark.createDataFrame(rows, "doc_id long, text string"), 6, 2).collect()}
    assert got[asked[0]] > got[asked[1]] + 0.3


def test_passages(spark, docs, empty, texts):
    got = {r.doc_id: r for r in passages.dedup(spark, docs).where("doc_id is not null").collect()}
    assert got[1].copy_of == 0 and got[1].dup_words == 120
    assert got[2].sources == [0] and got[2].dup_words >= 115           # near copy
    assert [(c.start, c.end) for c in got[11].cuts] == [(60, 130)] and got[11].sources == [10]
    assert got[10].dup_words == got[14].dup_words == got[9].dup_words == 0
    assert passages.dedup(spark, empty).count() == 0
    left = {r.doc_id: r.text for r in passages.without_passages(spark, docs).collect()}
    assert 1 not in left and left[11] == " ".join(words(60, 6)) + " "
    assert left[9] == texts[9] and left[3] == "" and left[4] is None
    assert passages.without_passages(spark, docs).columns == docs.columns


def test_passages_with_changed_words_and_repeated_lines(spark):
    r = random.Random(8)

    def new(n):
        return [f"w{r.randrange(3000)}" for _ in range(n)]

    rows, held = [], {}
    for n in range(120):
        share, size = ((0.85, 55), (0.85, 80), (0.9, 55), (0.95, 55))[n % 4]
        old = new(size)
        changed = set(r.sample(range(size), int(size * (1 - share))))
        rows += [(2 * n, new(150) + old + new(100)),
                 (2 * n + 1, new(90) + [f"x{r.randrange(3000)}" if k in changed else w for k, w in enumerate(old)] + new(120))]
        held[2 * n + 1] = (90, 90 + size)
    for n in range(120, 150):
        line = new(12)
        rows += [(2 * n, new(60) + line * 6 + new(60)), (2 * n + 1, new(90) + line * 6 + new(50))]
        held[2 * n + 1] = (90, 162)
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    got = {g.doc_id: g for g in passages.dedup(spark, df).collect()}
    found = {k for k, (s, e) in held.items() if got[k].sources == [k - 1] and sum(
        max(0, min(e, c.end) - max(s, c.start)) for c in got[k].cuts) >= passages.MIN_WORDS}
    assert all(got[k].dup_words == 0 for k in range(0, 300, 2))
    assert len([k for k in held if k < 240 and k in found]) >= 0.95 * 120
    assert len([k for k in held if k > 240 and k in found]) == 30


def test_passages_whole_only_in_a_document_between(spark):
    p = words(60, 22, 5000)
    parts = [p[:40], p[20:], p, p[:40], p[20:], p]          # 40 words each in all but 2 and 5
    rows = [(n, " ".join(words(60, 30 + n, 5000) + p + words(60, 40 + n, 5000))) for n, p in enumerate(parts)]
    own = words(60, 50, 5000)
    rows += [(6, " ".join(own)), (7, " ".join(own + words(20, 51, 5000) + own))]     # twice in one document
    got = {g.doc_id: g for g in passages.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(c.start, c.end) for c in got[5].cuts] == [(60, 120)] and got[5].sources == [2]
    assert all(got[k].dup_words == 0 for k in (0, 1, 2, 3, 4, 6))
    assert [(c.start, c.end) for c in got[7].cuts] == [(0, 60), (80, 140)]


def test_every_document_a_stretch_is_first_in_is_linked(spark):
    # document 9 shares a stretch with 1, 2 and 3; the middle one agrees on both sides
    rows = [(10, 1, 1, 0, 7, 5), (11, 2, 2, 3, 6, 8), (12, 3, 3, 5, 4, 9)]
    rows += [(hash_, 9, 9, 10 + n, 6, 8) for n, hash_ in enumerate((10, 11, 12))]
    kind = "hash long, doc long, h long, pos int, before int, after int"
    got = passages.whole_matches(spark.createDataFrame(rows, kind), 50)
    assert got.columns == ["doc", "h", "pos", "doc2", "h2", "pos2"]
    assert {(r.pos, r.doc2, r.pos2) for r in got.collect()} == {(10, 1, 0), (11, 2, 3), (12, 3, 5)}
    # a long copy keeps the first and the last place of each 25
    rows = [(k, doc, doc, k + 5 * doc, 1, 1) for k in range(60) for doc in (1, 2)]
    got = passages.whole_matches(spark.createDataFrame(rows, kind), 50).collect()
    assert sorted(r.pos for r in got) == [10, 24, 25, 49, 50, 69] and all(r.pos - r.pos2 == 5 for r in got)


def test_chain_prefers_the_collinear_matches():
    best = passages.chains([(0, 100), (10, 110), (20, 5), (22, 122), (40, 140)])[0]
    assert best == [(0, 100), (10, 110), (22, 122), (40, 140)]


def test_pivot_index_against_all_pairs(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(60, 16))
    vec = np.concatenate([base, base + r.normal(size=base.shape) * 0.03, base[:20] + r.normal(size=(20, 16)) * 0.2])
    rows = [(k, [float(x) for x in v], int(k % 2)) for k, v in enumerate(vec)]
    rows += [(200, rows[0][1], 0), (201, None, 0), (202, [0.0] * 16, 0), (203, [float("nan")] * 16, 0),
             (204, rows[0][1], None), (205, [None] * 16, 0), (206, [1e308] * 16, 1), (207, [1e308] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as node", "2 as n")
    got = {g.vec_id: g for g in pivot_index.near_duplicates(spark, df).collect()}
    ok = [(k, pivot_index.unit(np.array([v]))[0], lab) for k, v, lab in rows
          if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    true = {(a, b) for a, u, x in ok for b, w, y in ok if a < b and x == y and u @ w >= 0.98}
    count = collections.Counter(x for p in true for x in p)
    found = sum(g.n_links for g in got.values())
    assert len(got) == len(rows) and 0.9 * 2 * len(true) <= found <= 2 * len(true)
    assert all(g.n_links <= count[k] for k, g in got.items())
    for k in (201, 202, 203, 204, 205):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert got[200].component_id == 0 and not got[200].kept
    assert got[207].component_id == 206 and got[207].n_links == 1
    assert pivot_index.near_duplicates(spark, df.where("false")).count() == 0


def test_pivot_index_in_a_dense_group(spark):
    r = np.random.default_rng(5)
    group = r.normal(size=64) + 0.1 * r.normal(size=(1000, 64))
    vec = pivot_index.unit(np.concatenate([group, r.normal(size=(2000, 64))]))
    vec[2500:] = pivot_index.unit(vec[2000:2500] + 0.02 * r.normal(size=(500, 64)))
    df = spark.createDataFrame([(k, [float(x) for x in v], 0) for k, v in enumerate(vec)],
                               "vec_id long, embedding array<double>, label int")
    got = {g.vec_id: g.n_links for g in pivot_index.near_duplicates(spark, df).collect()}
    true = (vec @ vec.T >= 0.98).sum(1) - 1
    assert true[:1000].sum() > 100_000 and true[1000:].sum() > 900
    for part in (range(1000), range(1000, 3000)):
        assert 0.9 * sum(true[k] for k in part) <= sum(got[k] for k in part) <= sum(true[k] for k in part)


@pytest.mark.parametrize("mean", [0.0, 0.5, 0.8, 0.9])
def test_pivot_index_prunes_at_every_mean_cosine(spark, mean):
    r = np.random.default_rng(11)
    n, planted = 2400, 300
    vec = r.normal(size=(n, 64))
    vec[:, 0] = 0
    vec = np.sqrt(1 - mean) * pivot_index.unit(vec)
    vec[:, 0] = np.sqrt(mean)
    for k, angle in enumerate(r.uniform(0.02, np.arccos(0.98), planted)):      # links, near the bound ones, too
        u = r.normal(size=64)
        u -= (u @ vec[k]) * vec[k]
        vec[n - 1 - k] = np.cos(angle) * vec[k] + np.sin(angle) * u / np.linalg.norm(u)
    df = spark.createDataFrame([(k, [float(x) for x in v], 0) for k, v in enumerate(vec)],
                               "vec_id long, embedding array<double>, label int")
    unit = pivot_index.unit(vec)
    true = (unit @ unit.T >= 0.98).sum(1) - 1
    got = {g.vec_id: g.n_links for g in pivot_index.near_duplicates(spark, df).collect()}
    assert all(got[k] <= true[k] for k in got) and sum(got.values()) >= 0.95 * true.sum() > 500
    # candidates: pairs that meet in a sub-list, that is for two shared pivots
    wanted = math.ceil(pivot_index.PIVOTS_PER_ROOT * math.sqrt(n))
    pivots = pivot_index.spread(unit[r.permutation(n)[:2 * wanted]], wanted, 0.98)
    near = np.argsort(-(unit @ pivots.T), axis=1)[:, :pivot_index.PREFIX]
    sizes = collections.Counter((a, b) for x in np.sort(near, axis=1).tolist() for n_, a in enumerate(x) for b in x[n_ + 1:])
    assert sum(c * (c - 1) // 2 for c in sizes.values()) < 0.06 * n * (n - 1) / 2


def test_candidate_pairs_share_two_pivots_and_have_one_owner():
    r = np.random.default_rng(4)
    near = np.sort(np.array([r.permutation(9)[:4] for _ in range(300)]), axis=1).astype(np.int32)
    v = np.ones((300, 2)) / np.sqrt(2)                       # all close: every candidate comes out
    want = {(i, j): sorted(set(near[i]) & set(near[j]))[:2] for i in range(300) for j in range(i)
            if len(set(near[i]) & set(near[j])) > 1}
    got = collections.Counter()
    for pivot in range(9):
        members = np.flatnonzero((near == pivot).any(1))
        block = members % 2
        for x, y in ((0, 0), (0, 1), (1, 1)):
            for i, j, second in pivot_index.candidate_pairs(near[members], block, pivot, x, y, v[members], 0.98):
                own = pivot_index.owners(near[members], i, j) == (pivot, second)
                for a, b, s in zip(members[i[own]], members[j[own]], second[own]):
                    assert want[max(a, b), min(a, b)] == [pivot, s]
                    got[max(a, b), min(a, b)] += 1
    assert set(got) == set(want) and set(got.values()) == {1}


def test_mixed_blocks_follow_the_schedule(spark):
    rows = [(k, " ".join(words(20 + k % 50, k)), "ab"[k % 2]) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((g.slot, g["at"], g.source, g.doc_id, g.word, g.n) for g in mixing.mixed_blocks(spark, df, (3, 1), 0.8, 8).collect())
    size = {k: len(t.split()) for k, t, _ in rows}
    slots, taken, stream = {}, collections.Counter(), {"a": [], "b": []}
    for slot, at, source, doc, word, n in got:
        filled = slots.setdefault(slot, [source, 0])
        assert filled == [source, at] and 0 <= word and word + n <= size[doc]     # one source, without gaps
        filled[1] += n
        taken[doc] += n
        stream[source].append((doc, word, n))
    assert sorted(slots) == list(range(1, len(slots) + 1)) and all(n == 8 for _, n in slots.values())
    for s in stream.values():                               # every stream is read in order
        assert all(w == v + n if d == e else w == 0 and v + n == size[e] for (e, v, n), (d, w, _) in zip(s, s[1:]))
    kinds = [slots[k][0] for k in sorted(slots)]
    share = kinds.count("a") / len(kinds)
    assert all(abs(kinds[lo:lo + 40].count("a") - 40 * share) <= 4 for lo in range(len(kinds) - 40))
    assert {m.doc_id: m.taken for m in mixing.mix(spark, df, (3, 1), 0.8, 8).collect() if m.taken} == dict(taken)


def test_mixing_targets(spark, docs, empty):
    got = mixing.mix(spark, docs, block=4).collect()
    assert len(got) == docs.count()
    size, took, target = collections.Counter(), collections.Counter(), {}
    for g in got:
        assert 0 <= g.taken <= 2 * g.size
        size[g.source] += g.size
        took[g.source] += g.taken
        target[g.source] = g.target
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    for s in size:
        assert target[s] <= 2 * size[s] and abs(took[s] - target[s]) <= 16
    key = lambda rows: sorted(map(str, rows))
    assert key(mixing.mix(spark, docs.repartition(7), block=4).collect()) == key(got)
    assert mixing.mix(spark, empty).count() == 0
    mixed = mixing.mixed_documents(spark, docs, block=4)
    assert mixed.columns == docs.columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in mixed.collect()) == sum(took.values())


def test_imatch_edges(spark, docs, empty):
    got = imatch.fingerprints(spark, docs).collect()
    assert len(got) == docs.count()
    by = collections.defaultdict(set)
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    for g in got:
        by[rows[g.doc_id]].add(g.fingerprint)
        assert g.n_chars == len(rows[g.doc_id]) and 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
    assert all(len(f) == 1 for f in by.values())
    assert imatch.fingerprints(spark, empty).count() == 0


def test_toxicity_chain(spark):
    r = random.Random(9)
    rows = []
    for k in range(400):
        w = words(r.randrange(5, 60), k)
        bad = k % 5 == 0
        if bad:
            w[r.randrange(len(w))] = r.choice(["vile", "awful"])
        rows.append((k, " ".join(w), int(k % 7 != 0), int(bad)))
    d = spark.createDataFrame([(k, t, "x") for k, t, _, _ in rows] + [(None, None, "x"), (900, "", "x")],
                              "doc_id long, text string, p_toxic string")
    lab = spark.createDataFrame([(k, q, t) for k, _, q, t in rows if k < 300] + [(None, 1, 1), (5, None, None)],
                                "doc_id long, quality int, toxic int")
    model = toxicity.fit(spark, d, lab)
    got = {g.doc_id: g.toxic for g in toxicity.score(d, model).collect()}
    held = [(got[k], bool(t)) for k, _, _, t in rows if k >= 300]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert toxicity.fit(spark, d, lab.where("false")) is None
    assert not any(g.toxic for g in toxicity.score(d, None).collect())
    kept = toxicity.without_toxic(d, model)
    assert kept.columns == d.columns and kept.count() == sum(not x for x in got.values())
    assert toxicity.score(d.where("false"), model).count() == 0


def test_quotes(spark):
    rows = [(1, 0, "u", "Hello World.\n\nSecond para."), (1, 1, "a", "> hello   world.\nAnswer one"),
            (1, 2, "u", "Bob wrote:\n> Answer one\n>> Hello world.\n\nOk thanks"),
            (2, 0, "u", "> Second PARA.\nreply"), (2, 1, "a", "> nothing like it\nfoo"),
            (None, None, None, None), (3, 5, "u", ""), (3, 700, "u", "x")]
    df = spark.createDataFrame([r + (1, 2) for r in rows], "conv_id long, turn long, role string, text string, hash int, key int")
    got = {(g.conv_id, g.turn): (g.position, g.text, g.parent_conv, g.parent_turn, g.link, g.n_quotes)
           for g in quotes.link_quotes(df).collect()}
    assert got[1, 1] == (1, "Answer one", 1, 0, "quote", 1)
    assert got[1, 2] == (2, "Ok thanks", 1, 1, "quote", 2)
    assert got[2, 0] == (0, "reply", 1, 0, "quote", 1)
    assert got[2, 1] == (1, "foo", 2, 0, "previous", 1)
    assert got[3, 700] == (1, "x", 3, 5, "previous", 0)
    assert got[None, None][4] == "none" and quotes.link_quotes(df.where("false")).count() == 0


@pytest.mark.parametrize("slice_", [1, 7, 100_000])
def test_brown_neighbours_are_counted_in_slices(spark, docs, monkeypatch, slice_):
    """op1: classes before and after each word, whatever the slices of a block."""
    monkeypatch.setattr(brown_lm, "SLICE", slice_)
    blocks = brown_lm.coded_blocks(docs.repartition(2)).localCheckpoint()
    index = {w: k for k, w in enumerate([b"w1", b"w2", b"w3", b"the", brown_lm.END])}
    classes, n_classes = np.array([0, 1, 0, 2, 3]), 5
    want = collections.Counter()
    for b in blocks.collect():
        import zstandard

        names = zstandard.ZstdDecompressor().decompress(b["words"]).split(b"\n")
        codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b["codes"]), "<u4")
        held = [h for h, n in zip(b["held"], b["lengths"]) for _ in range(n)]
        last = brown_lm.END
        for c, h in zip(codes, held):
            w = names[c]
            one, two = (classes[index[x]] if x in index else 4 for x in (last, w))
            if not h:
                want[-1, one * n_classes + two] += 1
                if w in index:
                    want[index[w], one] += 1
                if last in index:
                    want[index[last], n_classes + two] += 1
            last = w
    got = collections.Counter()
    for word, raw in brown_lm.neighbours(blocks, index, classes, n_classes).collect():
        for p, c in np.frombuffer(raw, brown_lm.PAIRS):
            got[word, int(p)] += int(c)
    assert +got == want


def test_brown_neighbours_take_the_memory_of_a_slice(monkeypatch):
    """op1: what a task holds beside the counts does not grow with the block."""
    import tracemalloc

    import pyarrow as pa

    class Blocks:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return run

    r, n = np.random.default_rng(4), 600_000
    codes = r.integers(1, 20_000, n).astype("<u4")
    names = [brown_lm.END] + [b"w%d" % k for k in range(1, 20_000)]
    block = pa.RecordBatch.from_arrays(
        [pa.array([brown_lm.packed(b"\n".join(names))], pa.binary()), pa.array([brown_lm.packed(codes)], pa.binary()),
         pa.array([[n]]), pa.array([[False]])], ["words", "codes", "lengths", "held"])
    index = {w: k for k, w in enumerate(names)}
    run = brown_lm.neighbours(Blocks(), index, r.integers(0, 32, 20_000), 34)
    tracemalloc.start()
    try:
        for _ in run(iter([block, block, block])):
            pass
        assert tracemalloc.get_traced_memory()[1] < 32 << 20
    finally:
        tracemalloc.stop()


def test_written_sends_batches_of_the_size_asked_for(spark):
    """pipeline, op1, op2: long rows go to Python workers a few at a time."""
    from tessella.llm import common

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    before = spark.conf.get(common.BATCH)
    got = common.written(spark, spark.range(0, 1000, 1, 2).mapInArrow(sizes, "n long"), "sizes", 30).agg({"n": "max"})
    assert got.first()[0] <= 30 and spark.conf.get(common.BATCH) == before


def test_brown_writes_tokens_once(spark, monkeypatch):
    """op1: only the blocks hold the tokens; what is written later has the
    words of a block at most."""
    made, write = {}, brown_lm.written

    def seen(spark, df, name, batch=None):
        made.setdefault(name, set()).update(df.columns)
        return write(spark, df, name, batch)

    monkeypatch.setattr(brown_lm, "written", seen)
    rows = [(k, " ".join(f"w{(k * j) % 23}" for j in range(k % 9))) for k in range(60)]
    got = brown_lm.score(spark, spark.createDataFrame(rows, "doc_id long, text string"), 4, 2)
    assert got.count() == len(rows)
    assert [name for name, columns in made.items() if "codes" in columns] == ["brown-blocks"]


def test_passages_unlike_surroundings_are_told_without_alignment(spark, monkeypatch):
    """op2: only surroundings that may be alike in the band are aligned."""
    import numpy as np

    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 16, (300, 2 * passages.AROUND)).astype(np.int32)
    b = r.integers(0, 1 << 16, a.shape).astype(np.int32)
    b[:20] = a[:20]
    b[10:20, ::9] = 7                                    # one word of nine changed
    a[20, 40:], b[20, 40:] = -1, -1                      # texts that end
    seen, reach = [], passages.reach
    monkeypatch.setattr(passages, "reach", lambda x, y, identity: seen.append(len(x)) or reach(x, y, identity))
    assert np.flatnonzero(passages.may_hold(a, b, 50, 0.8)).tolist() == list(range(20))
    assert max(seen) <= 20


def test_passages_alignment_of_gaps():
    """op2: the most equal words, then the fewest columns, whatever the way."""
    def plain(a, b):
        row = [(0, -j) for j in range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            new = [(0, -i)]
            for j, y in enumerate(b, 1):
                d, u, v = row[j - 1], row[j], new[j - 1]
                new.append(max((d[0] + (x == y), d[1] - 1), (u[0], u[1] - 1), (v[0], v[1] - 1)))
            row = new
        return row[-1][0], -row[-1][1]

    r = random.Random(5)
    for _ in range(500):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(8))] for _ in range(2))
        assert passages.aligned(a, b) == plain(a, b)
