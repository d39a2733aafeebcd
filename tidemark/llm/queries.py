"""The registered queries of the operators, with SQL where SQL can express the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import oracles
from tidemark.llm.labelled import held_out
from tidemark.llm.merkle import fold, leaf_of, merkle_manifest, siblings
from tidemark.llm.mixing import estimated_tokens, mix_sources
from tidemark.llm.ngram_join import ngram_groups
from tidemark.llm.packing import pack_documents
from tidemark.llm.periodic import collapse_runs
from tidemark.llm.quality_net import fit_quality_net, score_quality
from tidemark.llm.quality_trees import fit_quality_trees, judge_quality
from tidemark.llm.scan_index import fit_index, nearest_vectors
from tidemark.llm.secret_scan import scan_secrets
from tidemark.llm.substrings import remove_repeats
from tidemark.llm.tables import shared_folder
from tidemark.llm.token_store import read_tokens, write_tokens
from tidemark.llm.url_filter import Rule, judge_urls
from tidemark.llm.vector_join import vector_groups

URL_RULES = [
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))




@query
def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_groups(table(spark, folder, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id")


@query
def op1_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_groups(table(spark, folder, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def count_of(kind: str) -> Column:
    return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind))


@query
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secret_spans", lambda s: s["kind"] != "novel")
    counts = [count_of(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


@query
def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query
def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query
def op10_token_id_output(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_folder(spark)}/llm-tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality_net(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged = judge_quality(docs, fit_quality_trees(docs, table(spark, folder, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def domain() -> Column:
    """The domain of a source: src0 is the crawl, the others belong to one of three by their number."""
    number = F.regexp_extract("source", r"([0-9]+)$", 1).cast("int")
    return F.when(number == 0, "crawl").when(number % 3 == 0, "reference").when(number % 3 == 1, "forum").otherwise("news")


MIX_LEVELS = ["domain", "lang", "source"]
MIX_WEIGHTS = {"domain": {"crawl": 20, "reference": 40, "forum": 15, "news": 25}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}}


@query
def op2_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("domain", domain())
    mixed = mix_sources(docs, MIX_LEVELS, MIX_WEIGHTS, percent=60, most_epochs=2)
    return mixed.select("doc_id", "domain", "lang", "source", "epoch", estimated_tokens().alias("n_tokens"))


def unsigned_crc(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def with_planted_run(docs: DataFrame) -> DataFrame:
    """Every tenth document (by checksum) repeats a stretch of its words from some word to its end."""
    h = unsigned_crc("doc_id")
    docs = docs.withColumn("w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n, g = F.size("w").cast("long"), F.floor(h / 10)
    docs = docs.withColumn("a", F.when(n > 0, g % n)).withColumn("rest", n - F.col("a"))
    docs = docs.withColumn("p", 1 + F.floor(F.col("rest") / (3 + g % 8)))
    stretch = F.slice("w", F.col("a").cast("int") + 1, F.col("p").cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(stretch, F.ceil(F.col("rest") / F.col("p")).cast("int"))), F.lit(1), F.col("rest").cast("int"))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    return docs.withColumn("text", F.when(F.col("rest") > 0, planted).otherwise(F.col("text"))).drop("w", "a", "rest", "p")


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = collapse_runs(with_planted_run(table(spark, folder, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    found = found.withColumn("best", F.array_min(order))
    length = -F.col("best.less")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", length.alias("length"), "best.period",
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op12_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return nearest_vectors(vectors, vectors.where("vec_id % 100 = 0"), fit_index(vectors, k=10), k=10)


MANIFEST = ["doc_id", "source", "lang", "n_chars", "text"]


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that a checker is shown: every third document (by checksum) has its capitals changed."""
    docs = table(spark, folder, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    shown = F.when(unsigned_crc("doc_id") % 3 == 0, leaf_of([*[F.col(c) for c in MANIFEST[:-1]], lower]))
    made = merkle_manifest(docs.withColumn("shown", shown), MANIFEST, "lang", "doc_id", keep=["doc_id", "shown"])
    made = made.withColumn("folded_root", fold(F.coalesce("shown", "leaf"), F.col("path")))
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLES.update({
    "op1_embedding_near_dedup": oracles.VECTOR_JOIN,
    "op11_periodic_runs": oracles.periodic_runs(),
    "op13_merkle_manifest": oracles.merkle(),
    "op2_source_mixing": oracles.mixing(MIX_LEVELS, MIX_WEIGHTS, percent=60, epochs=2, seed=17),
    "op4_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op6_ngram_jaccard_join": oracles.NGRAM_JOIN,
    "op9_url_filter": oracles.url_filter(URL_RULES, rounds=8, damping=0.85, least_distrust=0.01),
})
