"""A training corpus in five stages: quality rules, SimHash near-dedup, suffix-array dedup, benchmark decontamination,
best-fit packing. Each stage works on all that the one before kept; all but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import scratch, table
from tessella.llm.decontamination import contamination
from tessella.llm.packing import pack_documents
from tessella.llm.quality_rules import rule_verdicts
from tessella.llm.simhash import near_duplicates
from tessella.llm.suffix_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Rows with a null doc_id are judged like any other."""
    return rule_verdicts(docs, carry=docs.columns).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies, once; of several texts with that doc_id the one of
    the least hash. Rows without a doc_id can't stand for a group and stay."""
    keyed = docs.withColumn("_th", F.xxhash64("text"))
    keep = near_duplicates(keyed, carry=["_th"]).where("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "_th")).alias("least")).select("least.*")
    kept = keyed.join(keep, ["doc_id", "_th"], "left_semi").dropDuplicates(["doc_id", "_th"]).select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without the bytes that 200-byte repeats cover; a character that is cut in two goes."""
    return remove_repeats(docs).withColumn("text", F.col("kept")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return contamination(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left and their places in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("suffix_array_dedup", repeat_dedup), ("benchmark_decontamination", decontaminate), ("best_fit_packing", packing)]

#: SQL can't express the fitted rules, fingerprint components or packing; tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's result is written, and what the stage wrote on its way is deleted then."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir))
    return docs
