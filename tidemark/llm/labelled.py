"""The rows of ``documents`` that a quality model may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out() -> Column:
    """Rows that no model learns from: crc32 of doc_id as text, modulo 5, is 0. A null doc_id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def learning_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, quality) of at most ``most`` labelled rows that are not held out.

    Half of the bound goes to either label (0 and 1; others are left out), drawn by a hash of doc_id, so
    the sample doesn't hang on the order of rows. A doc_id labelled twice takes the lower label. The
    labels' side of the join has ``most`` rows at most and is broadcast.
    """
    usable = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(most // 2) for q in (0, 1)]
    chosen = drawn[0].union(drawn[1])
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
