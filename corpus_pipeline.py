"""A corpus made ready for training: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmeter.llm import decontamination, near_dedup, packing, sanitisation, toxicity
from voxelmeter.llm.io import checkpointed, held_out, read, release
from voxelmeter.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts; learned from labels of documents that are not held out."""
    training = toxicity.training_rows(read(spark, sf_dir, "labels"), held_out(F.col("doc_id")))
    model = toxicity.learn(docs, training)
    return toxicity.score(docs, model, name="__score", flag="__predicted", spans="__passages").where("__predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of least doc_id, of each group linked by 0.8 of their five-word shingles.

    Where doc_id is no key of the rows, because some repeat it or lack it, each row is compared under a number of its own; of equal ids any
    one row stays, and a row without id only where no other is in its group.
    """
    keyed = docs.agg(F.count("*") == F.count("doc_id")).first()[0] and docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    if keyed:
        gone = near_dedup.near_duplicates(docs, width=5, percent=80).where("not kept").select(F.col("doc_id").alias("__gone"))
        return docs.join(gone.hint("merge"), F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")  # copies grow with the input: never broadcast
    rows = checkpointed(docs.withColumn("__row", F.monotonically_increasing_id()))  # written, so that each row keeps its number
    groups = near_dedup.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), width=5, percent=80).select(F.col("doc_id").alias("__row"), "component_id")
    best = groups.join(rows.select("__row", "doc_id"), "__row").groupBy("component_id").agg(
        F.min_by("__row", F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("__row"))
    return rows.join(best, "__row", "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly benchmark go."""
    return decontamination.remove_spans(docs, read(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that reveal it, replaced by placeholders."""
    return sanitisation.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in its training sequence."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", decontaminate), ("personal_data", mask_personal_data), ("packing", pack)]

# Toxicity scores and packing cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, checkpointed(stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
