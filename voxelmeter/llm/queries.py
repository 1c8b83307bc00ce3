"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmeter.llm import (decontamination, exact_search, language, lexical_search, near_dedup, oracles, packing, sanitisation, suffix_array, suffix_tree,
                            token_counts, toxicity, whitening, winnowing)
from voxelmeter.llm.io import held_out, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_language")
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    learned = language.profiles(documents.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    return language.identify(documents, learned, keep=(held_out(F.col("doc_id")).alias("held_out"),))


@query("op4_decontaminate", oracles.CONTAMINATION)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(decontamination.hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


@query("op5_pack")
def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    training = toxicity.training_rows(read(spark, sf_dir, "labels"), held_out(F.col("doc_id")))
    model = toxicity.learn(documents, training)
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


@query("op8_near_dedup", oracles.NEAR_GROUPS)
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)


@query("op2_suffix_tree", oracles.WORD_WINDOWS)
def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.dedup_word_windows(read(spark, sf_dir, "documents")).drop("kept")


@query("op10_suffix_array", oracles.BYTE_STRINGS)
def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.dedup_substrings(read(spark, sf_dir, "documents")).drop("kept")


@query("op3_sanitise")
def op3_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitisation.report(sanitisation.find(read(spark, sf_dir, "documents")))


@query("op7_winnow")
def op7_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(read(spark, sf_dir, "documents"))


@query("op11_search", oracles.RANKED_SEARCH)
def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op12_top_k", oracles.INNER_PRODUCTS)
def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.top_k(read(spark, sf_dir, "embeddings"))


@query("op13_whiten")
def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))
