"""The stages of the corpus pipeline. Each is one operator over all that the stage before kept, and its result is written and read again.

Defined cases: those of the operators. Null texts and null ids go through the first four stages as their operators say (the base rule rejects a text
of no words); an empty table gives an empty result; further columns go along up to the last stage, those of names that an operator makes included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, near_dedup, quality_rules, substring_dedup
from graphloom.llm.common import Workspace, unused_name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned rules keep."""
    model = quality_rules.fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    made = ("__stats", "__base_failed", "__rule", "__kept")
    aside = {c: unused_name(docs, f"aside{k}") for k, c in enumerate(docs.columns) if c.lower() in made}
    kept = quality_rules.judged(docs.withColumnsRenamed(aside), model).where("__kept")
    return kept.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates."""
    space = Workspace(spark, "pipeline-near")
    found = near_dedup.near_duplicates(docs, space=space)
    name = unused_name(docs, "gone")
    gone = space.table(found.where("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col(name), "left_anti")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds."""
    spans, number = unused_name(docs, "removed"), unused_name(docs, "n_removed")
    out = substring_dedup.without_copies(docs, removed_col=spans, number_col=number)
    return out.withColumn("n_chars", F.when(F.col(number) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return bpe.encode_frame(docs, *bpe.default_vocabulary(), keep_ids=False)


STAGES = [("quality rules", quality), ("near duplicates", near), ("substring dedup", repeats), ("decontamination", leaks), ("byte BPE", tokens)]

#: A learned decision list and a tokenizer are no SQL; tests hold run()'s line removal, decontamination and token counts against brute-force versions on sf0.001.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
