"""Registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import (bpe_automaton, brown_lm, id_planes, imatch, merkle, mixing, passages, pivot_index, prefix_trie,
                          quotes, secrets, simhash_trie, toxicity)
from tessella.llm.common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f
    return add


def tokenizer_path(name: str) -> str:
    """Vocabulary files come with the ``public_tokenizers`` package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_brown_lm")
def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(spark, documents(spark, sf_dir))


@query("op2_passages")
def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.dedup(spark, documents(spark, sf_dir)).drop("h")


@query("op3_pivot_index", pivot_index.oracle())
def op3_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


@query("op4_toxicity_chain")
def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).drop("text_key")


@query("op5_imatch", imatch.oracle())
def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(spark, documents(spark, sf_dir))


@query("op6_mixing", mixing.oracle())
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op7_bpe_automaton")
def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_digests(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


@query("op8_id_planes")
def op8_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = id_planes.write_ids(spark, documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return id_planes.read_documents(files)


@query("op9_simhash_trie")
def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.simhash_components(
        spark, documents(spark, sf_dir), shingle=3, budget=3).select(
        "doc_id", "fingerprint", "component_id")


@query("op10_quotes", quotes.oracle())
def op10_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


@query("op11_prefix_trie", prefix_trie.oracle())
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(spark, table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(spark, *prefix_trie.rebuilt(turns)).drop("tid")


@query("op12_secrets", secrets.oracle())
def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(spark, documents(spark, sf_dir)))


@query("op13_merkle", merkle.oracle())
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(merkle.manifest(spark, documents(spark, sf_dir)))
