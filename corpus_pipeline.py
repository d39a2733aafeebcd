"""A corpus pipeline over ``documents`` made of the training-data operators, and their registered queries."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.mixing import mix_sources
from tidemark.llm.ngram_join import drop_near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality_trees import fit_quality_trees, judge_quality
from tidemark.llm.queries import MIX_LEVELS, MIX_WEIGHTS, domain
from tidemark.llm.queries import ORACLES as LLM_ORACLES
from tidemark.llm.queries import QUERIES as LLM_QUERIES
from tidemark.llm.secret_scan import redact_secrets
from tidemark.llm.tables import stored

TOKENIZER = "word_bpe_49k.json"
SEQUENCE = 2048
MIX_PERCENT = 80  # of the tokens that reach the mixing stage
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"  # of rows handed to Python; an executor holds several per task


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go."""
    trees = fit_quality_trees(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge_quality(docs, trees).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a Jaccard similarity of 0.8 or more on five-word shingles the first document stays."""
    return drop_near_duplicates(docs, width=5, percent=80).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is cut out of its text; all documents stay."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains, languages and sources in the proportions aimed at; no document is taken twice."""
    mixed = mix_sources(docs.withColumn("domain", domain()), MIX_LEVELS, MIX_WEIGHTS, percent=MIX_PERCENT, most_epochs=1)
    return mixed.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids: a row for each piece, with its ids and its place."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER), capacity=SEQUENCE, end_id=0)


def in_batches(stage, size: str):
    """``stage`` with whole texts handed to Python in batches of ``size``; the session keeps the setting, as plans run after the call."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH, size)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality rules", in_batches(quality_rules, "2m")), ("near duplicates", in_batches(near_duplicates, "8m")),
    ("secrets", in_batches(secrets, "2m")), ("source mix", in_batches(source_mix, "2m")), ("packing", in_batches(packing, "2m")),
]

# Trees, n-gram groups, novelty and tokens are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


LLM_QUERIES = {**LLM_QUERIES, "pipeline": run}
__all__ = ["LLM_ORACLES", "LLM_QUERIES", "ORACLE_SQL", "STAGES", "run"]
