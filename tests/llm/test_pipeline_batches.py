"""pipeline: what its stages send to Python workers at a time."""

import corpus_pipeline

from tessella.llm import bpe_automaton, passages
from tessella.llm.common import BATCH
from tessella.llm.queries import tokenizer_path

TEXT = "doc_id long, source string, lang string, n_chars long, text string"


def test_tokenizer_stage_sends_bounded_batches(spark, monkeypatch):
    """The stage's texts reach a worker at most SENT rows at a time, whoever
    writes its result, and the rows are those of the operator."""
    rows = [(i, "web", "en", 9, None if i % 50 == 0 else f"Ein Text, Nr. {i}\x85 İ x{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, TEXT).coalesce(1)
    sent, before = [], spark.conf.get(BATCH)
    real = bpe_automaton.encode_documents

    def counted(docs, path, memo):
        def pass_on(batches):
            for b in batches:
                assert b.num_rows <= passages.SENT, b.num_rows
                yield b
        sent.append(1)
        return real(docs.mapInArrow(pass_on, docs.schema), path, memo=memo)

    monkeypatch.setattr(bpe_automaton, "encode_documents", counted)
    got = corpus_pipeline.encode(spark, docs, "")
    assert sorted(map(str, got.collect())) == sorted(
        map(str, real(docs, tokenizer_path(corpus_pipeline.TOKENIZER), memo=1000).collect()))
    assert sent and spark.conf.get(BATCH) == before
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()


def test_passages_are_cut_by_one_worker_a_task(spark):
    """The cutting function runs once a row: a second node of it in the same
    stage doubles the Python workers, and all keep the next stage's tables."""
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, "web", "en", 0, text), (2, "web", "en", 0, "a " + text + " b"),
                                  (3, "web", "en", 0, None), (4, "web", "en", 0, text)], TEXT)
    got = passages.without_passages(spark, docs)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.doc_id: r.text for r in got.collect()} == {1: text, 2: "a b", 3: None}
