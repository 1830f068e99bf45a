"""The corpus pipeline: stages that each apply one operator to what the stage before kept.

Quality rules, exact duplicates, near duplicates, mixing of sources, packing. Every stage but the
last returns the columns of documents; rows that it rejects are gone, and the mix repeats rows.
A row whose lines were cleaned has its remaining lines as text, and n_chars follows. Empty
tables pass through; rows with a null id are never taken for copies.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import exact_dedup, jaccard_join, packing, quality_rules, source_mix
from loomery.llm.common import shared_dir

RULES = quality_rules.LineRules(phrase_share=0.10)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(docs, rules=RULES).where("kept").withColumn("text", F.col("clean_text"))
    return judged.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs).select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed(docs).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("jaccard_join", near), ("source_mix", mix), ("packing", pack)]

#: The ids of the last stage come from a tokenizer, which SQL can't express; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
