"""Names that clash, ids that repeat, numbers beyond 2^32, and the whole
pipeline."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import imatch, mixing, passages, queries, simhash_trie
from tessella.session import scratch_path

SF = "/root/testdata/sf0.001"
BASE = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["taken", "n2", "d2", "s2", "z2", "take", "__doc", "__h", "__cuts", "__id", "__key", "__n", "__take", "row",
         "id", "key", "size", "doc", "h", "cuts", "first", "same", "number", "less", "src", "n", "a.b"]


def documents(spark):
    r = random.Random(6)
    shared = " ".join(f"s{r.randrange(900)}" for _ in range(70))
    texts = [" ".join(f"w{r.randrange(500)}" for _ in range(r.choice([3, 40, 120]))) for _ in range(30)]
    texts = [t + " " + shared if k % 4 == 0 else t for k, t in enumerate(texts)] + [None, "", texts[0], texts[1]]
    return spark.createDataFrame([(k, t, "en", f"s{k % 3}" if k % 7 else None, None if t is None else len(t))
                                  for k, t in enumerate(texts)], BASE)


@pytest.mark.parametrize("stage", [mixing.mixed_documents, passages.without_passages, simhash_trie.keep_one_per_component])
def test_columns_of_any_name_pass_through(spark, stage):
    docs = documents(spark)
    more = docs.select("*", *[(F.col("doc_id") * 10 + n).alias(c) for n, c in enumerate(CLASH)])
    plain = sorted(map(str, stage(spark, docs).collect()))
    got = stage(spark, more)
    assert got.columns == docs.columns + CLASH
    assert sorted(map(str, got.select(*docs.columns).collect())) == plain
    for row in got.collect():
        assert [row[c] for c in CLASH] == [row.doc_id * 10 + n for n in range(len(CLASH))]


def test_points_of_slots_beyond_32_bits(spark):
    slots = [1, 65_535, 65_536, (1 << 32) - 1, 1 << 32, 3_500_000_000, (1 << 33) + 12_345, 10**15 + 7, (1 << 62) + 99]
    got = spark.createDataFrame([(s,) for s in slots], "slot long").select("slot", mixing.point_of("slot").alias("p")).collect()
    assert {r.slot: r.p for r in got} == {s: s * mixing.GOLDEN % (1 << 32) for s in slots}


def test_smallest_id_repeated_past_a_bucket(spark):
    rows = [(0, f"t{k % 900:04d}", "en", "s", 5) for k in range(1_500)] + [(k, f"u{k}", "en", "s", 3) for k in range(1, 600)]
    docs = spark.createDataFrame(rows, BASE).withColumn("key", F.md5("text"))
    got = imatch.with_next(docs, docs.count()).collect()
    order = sorted([(r[0], hashlib.md5(r[1].encode()).hexdigest(), r[1]) for r in rows], reverse=True)
    want = sorted((a[0], a[2], b[0], b[2]) for a, b in zip(order, order[1:] + order[:1]))
    assert sorted((g.doc_id, g.text, g.next_id, g.next_text) for g in got) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_pipeline_is_its_stages_one_after_the_other(spark):
    from tokenizers import Tokenizer

    base = scratch_path(spark, "t-pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "src0", 0), (10**9, "", "en", "src0", 0)], BASE)
    docs.unionByName(odd).write.parquet(f"{base}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{base}/labels.parquet")
    got = corpus_pipeline.run(spark, base)
    step = spark.read.parquet(f"{base}/documents.parquet")
    sizes = [step.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_path(spark, f"t-{name}")
        stage(spark, step, base).write.parquet(path)
        step = spark.read.parquet(path)
        assert step.columns == docs.columns
        sizes.append(step.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 100      # toxic ones, near copies
    tok = Tokenizer.from_file(queries.tokenizer_path(corpus_pipeline.TOKENIZER))
    want = []
    for r in step.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want.append(str((r.doc_id, r.source, r.n_chars, ids, tok.decode(ids, skip_special_tokens=False))))
    assert sorted(str((r.doc_id, r.source, r.n_chars, r.ids, r.decoded)) for r in got.collect()) == sorted(want)


def test_pipeline_of_an_empty_table(spark):
    base = scratch_path(spark, "t-pipeline-empty")
    spark.createDataFrame([], BASE).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{base}/labels.parquet")
    assert corpus_pipeline.run(spark, base).count() == 0
