"""op2_passages: alignments told from their runs, surroundings in one go."""

import random
import zlib

import numpy as np
import pytest

from tessella.llm import passages


def edited(words, rate, rng):
    out = []
    for w in words:
        r = rng.random()
        if r < rate:
            out += rng.choice(([], [b"zz%d" % rng.randrange(9)], [w, b"yy"]))
        else:
            out.append(w)
    return out


def seed_matches(a, b, k, rng, share):
    places = {}
    for j in range(len(b) - k + 1):
        places.setdefault(tuple(b[j:j + k]), []).append(j)
    return [(i, j) for i in range(len(a) - k + 1) for j in places.get(tuple(a[i:i + k]), []) if rng.random() < share]


@pytest.mark.parametrize("identity", [0.8, 0.5, 1.0])
def test_whole_alignments_are_told_without_points(monkeypatch, identity):
    """Most alignments are one passage: told from their runs, with the same
    result as by the search for the best part."""
    rng, points = random.Random(5), []
    real_points, real_whole = passages.points_of, passages.whole_passage
    monkeypatch.setattr(passages, "points_of", lambda runs: points.append(1) or real_points(runs))
    told = 0
    for n in range(120):
        vocabulary = [b"w%d" % i for i in range(rng.choice((30, 400)))]
        def some(n):
            return [rng.choice(vocabulary) for _ in range(n)]
        shared = some(rng.choice((30, 60, 200)))
        a = some(rng.randrange(80)) + shared + some(rng.randrange(80)) + shared[:70]
        b = some(rng.randrange(80)) + edited(shared, rng.choice((0, 0.02, 0.1, 0.2)), rng) + some(rng.randrange(80))
        pairs = seed_matches(a, b, 5, rng, rng.choice((1, 0.3)))
        points.clear()
        monkeypatch.setattr(passages, "whole_passage", real_whole)
        got = passages.passages_of(a, b, pairs, 50, identity)
        told += bool(got and not points)
        monkeypatch.setattr(passages, "whole_passage", lambda *x: None)
        assert got == passages.passages_of(a, b, pairs, 50, identity)
    assert told > 20 or identity == 1.0


def test_surroundings_of_many_matches_at_once():
    texts = [b"", b" A b\x0bC  d E f g ", b"one two three four five", b" A b\x0bC  d E f g ", b"x " * 300]
    at, places = [1, 1, 2, 3, 4, 4], [0, 2, 0, 1, 0, 150]
    hashes, sides = passages.around(texts, at, places)
    full = passages.beyond(hashes, sides)
    for row, n, pos in zip(full, at, places):
        words = [zlib.crc32(w) & 0xFFFF for w in texts[n].lower().split()]
        left, right = words[max(0, pos - passages.AROUND):pos][::-1], words[pos + passages.K:][:passages.AROUND]
        want = [x + [-1] * (passages.AROUND - len(x)) for x in (left, right)]
        assert row.tolist() == want[0] + want[1]
    assert passages.around([b""], [], [])[0].shape == (0, 2 * passages.AROUND)
    assert full.dtype == np.int32


def test_seeds_of_one_document_stay_out_of_places(spark):
    rows = [(1, 10, 1, 5 << 32), (2, 10, 1, 9 << 32), (2, 11, 2, 4 << 32), (3, 10, 1, 1 << 32), (3, 11, 2, 1 << 32),
            (3, 12, 3, 2 << 32), (4, 12, 3, 7 << 32), (4, 12, 3, 8 << 32)]
    got = passages.places(spark.createDataFrame(rows, "seed long, doc long, h long, pc long"), 3).collect()
    # a seed of two documents: its later place; of three: all places
    assert sorted((r.doc, r.pos, r.common, len(r.ends)) for r in got) == [
        (10, 1, True, 0), (11, 1, True, 1), (11, 4, False, 1), (12, 2, True, 2)]
