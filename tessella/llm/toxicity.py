"""Toxicity by a classifier chain.

Categories are predicted one after the other: the linear model of a category
sees the document's features and the probabilities of all earlier
categories.  In training these earlier probabilities are out-of-fold (each
document's comes from models that did not see it), so later models learn
from probabilities as good as they will get, not from overfitted ones.

Features are words (A-Z lower-cased, runs outside space and U+0009..U+000D)
and their first ``PREFIXES`` bytes, as log2(1 + occurrences), chosen by the
chi-square of their presence, plus the logarithm of the number of words.
Presence is counted by Spark over a bounded sample of labelled documents;
one task then fits the models on the sample's few hundred chosen features.
Every document is scored.
"""

from __future__ import annotations

import json
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import text_bytes, worker_release, written

SAMPLE = 10_000     # labelled documents used for fitting at most: bounds the fitting task
FEATURES = 512      # features kept
PREFIXES = (4, 6)
COUNTED = 100_000   # terms a counting task holds before it hands them on
FOLDS = 3
RIDGE = 1.0
THRESHOLD = 0.5
# category -> SQL condition on the label columns, in chain order
CHAIN = (("junk", "quality = 0"), ("toxic", "toxic = 1"))


def features_of(text: bytes, prefixes=PREFIXES):
    """(occurrences of every word and prefix, number of words); a prefix is
    marked by a leading space, which no word holds."""
    words = text.lower().split()
    found = Counter(words)
    for w, c in list(found.items()):
        for n in prefixes:
            if len(w) > n:
                found[b" " + w[:n]] += c
    return found, len(words)


def hits_of(text: bytes, index: dict, starts: set, prefixes=PREFIXES):
    """({feature number: occurrences}, number of words): ``features_of`` for
    the features of a model only."""
    words = text.lower().split()
    found = Counter(words)
    hits = {index[w]: found[w] for w in found.keys() & index.keys()}
    least = min(prefixes)
    for w, c in found.items():
        if w[:least] in starts:
            for n in prefixes:
                i = index.get(b" " + w[:n]) if len(w) > n else None
                if i is not None:
                    hits[i] = hits.get(i, 0) + c
    return hits, len(words)


def fit_linear(x, y, rows, ridge: float = RIDGE, rounds: int = 25):
    """Ridge logistic regression by Newton steps on the ``rows`` (0/1) of
    ``x``; its last column is the unpenalised constant."""
    import numpy as np

    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = predict(x, w)
        g = x.T @ (rows * (y - p)) - keep * w
        h = np.zeros((x.shape[1], x.shape[1]))
        spread = rows * np.maximum(p * (1 - p), 1e-6)
        for lo in range(0, len(x), 1000):                # no second copy of x
            part = x[lo:lo + 1000]
            h += (part * spread[lo:lo + 1000, None]).T @ part
        h[np.diag_indices_from(h)] += keep
        step = np.linalg.solve(h, g)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def predict(x, w):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def fit_chain(hits, lengths, labels, folds, features: list[str], n_folds: int = FOLDS) -> dict:
    """Model of the whole chain.  ``hits``: (feature numbers, occurrences) of
    each document; ``labels``: documents x categories (0/1); ``folds``: fold
    number of each document."""
    import numpy as np

    labels = np.asarray(labels, float)
    n, k = labels.shape
    f = len(features)
    # features, length, a column for each earlier category's probability, constant;
    # a category's column is zero, so without weight, until it has been predicted
    x = np.zeros((n, f + k + 1))
    for row, (at, often) in enumerate(hits):
        x[row, at] = np.log2(1.0 + np.asarray(often))
    x[:, f] = np.log1p(lengths)
    x[:, -1] = 1
    weights, accuracy = [], []
    folds = np.asarray(folds)
    for c in range(k):
        y = labels[:, c]
        w = fit_linear(x, y, np.ones(n))
        weights.append([*w[:f + 1 + c].tolist(), float(w[-1])])
        out = np.zeros(n)
        for held in (folds == i for i in range(n_folds)):
            if held.any():
                out[held] = predict(x, fit_linear(x, y, (~held).astype(float)))[held]
        accuracy.append(float(np.mean((out >= THRESHOLD) == (y > 0))))
        if c + 1 < k:
            x[:, f + 1 + c] = out
    return {"features": features, "weights": weights, "held_out_accuracy": accuracy}


def chosen_features(rows: DataFrame, ys: list[str], n_features: int = FEATURES) -> list[str]:
    """The ``n_features`` terms of at least 3 documents whose presence tells
    most about a label, by chi-square, in order of their bytes.  ``rows``:
    ``(t, y0, y1, ...)``."""
    def count(batches):
        worker_release()
        found: dict[bytes, list[int]] = {}

        def flush():
            cols = list(zip(*found.values()))
            return pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.binary()), *(pa.array(c, pa.int64()) for c in cols)], ["w", "n", *ys])

        for b in batches:
            for t, *y in zip(*(c.to_pylist() for c in b.columns)):
                for w in features_of(t)[0]:
                    got = found.get(w)
                    if got is None:
                        got = found[w] = [0] * (1 + len(ys))
                    got[0] += 1
                    for i, v in enumerate(y, 1):
                        got[i] += v
                if len(found) >= COUNTED:
                    yield flush()
                    found = {}
        if found:
            yield flush()

    terms = (rows.select("t", *[F.col(y).cast("long") for y in ys])
             .mapInArrow(count, "w binary, n long, " + ", ".join(f"{y} long" for y in ys))
             .groupBy("w").agg(*[F.sum(c).alias(c) for c in ("n", *ys)]).where("n >= 3"))
    every = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in ys]).first()
    n, chi = every["n"], [F.lit(0.0)]
    for y in ys:
        pos = every[y] or 0
        if 0 < pos < n:
            expect = F.col("n") * F.lit(pos / n)
            spread = expect * F.lit(1 - pos / n) * (1 - F.col("n") / F.lit(n + 1))
            chi.append((F.col(y) - expect) ** 2 / F.greatest(spread, F.lit(1e-9)))
    best = (terms.select("w", F.greatest(*chi, F.lit(0.0)).alias("chi")).where("chi > 0")
            .orderBy(F.desc("chi"), "w").limit(n_features).collect())     # bounded: the model's own size
    return [w.decode("latin-1") for w in sorted(bytes(r["w"]) for r in best)]


def index_of(features: list[str], prefixes=PREFIXES):
    """What ``hits_of`` needs to find the features."""
    index = {f.encode("latin-1"): i for i, f in enumerate(features)}
    return index, {f[1:1 + min(prefixes)] for f in index if f[:1] == b" "}


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, chain=CHAIN,
        sample: int = SAMPLE) -> dict | None:
    """Fits the chain on at most ``sample`` labelled documents, chosen by a
    hash of their id; None if there are no labelled documents.  Rows with a
    null id or a null label are not used; of repeated ids one row counts."""
    cats = [F.max(F.expr(f"cast({cond} as int)")).alias(f"y{k}") for k, (_, cond) in enumerate(chain)]
    ys = [f"y{k}" for k in range(len(chain))]
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(*cats).dropna(subset=ys)
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    # ids first, texts after: ids without a document must not use up the sample
    there = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = written(spark, texts.join(F.broadcast(chosen), "doc_id")     # at most ``sample`` small rows
                   .groupBy("doc_id").agg(F.min("text").alias("text"), *[F.max(y).alias(y) for y in ys])
                   .select(text_bytes("text").alias("t"),
                           F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"),
                           "doc_id", *ys), "toxicity-sample")
    features = chosen_features(rows.select("t", *ys), ys)

    def find(batches):
        worker_release()
        index, starts = index_of(features)
        for b in batches:
            hits = [hits_of(t, index, starts) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(h) for h, _ in hits], pa.list_(pa.int32())),
                 pa.array([list(h.values()) for h, _ in hits], pa.list_(pa.int32())),
                 pa.array([n for _, n in hits], pa.int64()), *b.columns[1:]],
                ["at", "often", "n", "fold", "doc_id", *ys])

    def run(batches):
        worker_release()
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got).sort_by("doc_id")
            model = fit_chain(zip(t.column(0).to_pylist(), t.column(1).to_pylist()), t.column(2).to_numpy(),
                              list(zip(*(t.column(5 + k).to_pylist() for k in range(len(ys))))),
                              t.column(3).to_numpy(), features)
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(model)])], ["model"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(find, f"at array<int>, often array<int>, n long, fold int, doc_id {kind}, "
                            + ", ".join(f"{y} int" for y in ys))
    model = found.repartition(1).mapInArrow(run, "model string").collect()    # one row
    return json.loads(model[0]["model"]) if model else None


def scorer(model: dict | None, n_categories: int):
    """Function from a text's bytes to its probabilities, in chain order."""
    import math

    index, starts = index_of(model["features"] if model else [])
    n = len(index)

    def chain_of(text: bytes) -> list[float]:
        if not model:
            return [0.0] * n_categories
        hits, length = hits_of(text, index, starts)
        hits = [(i, math.log2(1 + c)) for i, c in sorted(hits.items())]
        probs: list[float] = []
        for w in model["weights"]:
            z = w[-1] + w[n] * math.log1p(length) + sum([w[i] * v for i, v in hits])
            z += sum([p * v for p, v in zip(probs, w[n + 1:-1])])
            probs.append(1 / (1 + math.exp(-min(max(z, -30.0), 30.0))))
        return probs

    return chain_of


def score(docs: DataFrame, model: dict | None, chain=CHAIN) -> DataFrame:
    """``(doc_id, text_key, p_<category>..., toxic)`` per row of ``docs``:
    probabilities of all categories and whether the last one reaches
    ``THRESHOLD``.

    Null and empty texts have only the constant feature; without a model all
    probabilities are 0 and nothing is toxic; rows with a null id and
    repeated rows are scored like others; further columns are ignored.
    """
    names = [f"p_{c}" for c, _ in chain]
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"),
                       text_bytes("text").alias("t"))

    def run(batches):
        worker_release()
        chain_of = scorer(model, len(names))
        for b in batches:
            out = [chain_of(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array([o[c] for o in out], pa.float64()) for c in range(len(names)))],
                ["doc_id", "text_key", *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, text_key long, " + ", ".join(f"{p} double" for p in names))
    return scored.withColumn("toxic", F.col(names[-1]) >= THRESHOLD)


def without_toxic(docs: DataFrame, model: dict | None, chain=CHAIN) -> DataFrame:
    """The rows of ``docs`` (all columns) that the chain does not reject."""
    place = docs.columns.index("text")

    def run(batches):
        worker_release()
        chain_of = scorer(model, len(chain))
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                keep = [chain_of((t or "").encode())[-1] < THRESHOLD for t in part.column(place).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
