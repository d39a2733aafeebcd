"""Text helpers: reasoning-block removal and character n-gram vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

# Fixed value: size of the hashed n-gram vector.
BUCKETS = 256


def strip_think(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<think>.*?</think>", "")


def squeeze(text: Column) -> Column:
    """Lower case, runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[\s\x1c-\x1f]+", " "))


def spread(df: DataFrame, key: list[str]) -> DataFrame:
    """Redistribute an input that has fewer splits than the cluster has cores.

    A small table in one file would be worked on by one core; an input with enough
    splits of its own is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *key) if df.rdd.getNumPartitions() < cores else df


PIECE = 1 << 20  # characters counted at a time
KNOWN = 1 << 18  # n-grams whose buckets a task remembers


class _GramBuckets:
    """Buckets of the n-grams at each place of a text; every n-gram is hashed once, as long as it is remembered."""

    def __init__(self, n: int) -> None:
        self.n, self.known = n, {}
        self.ascii = np.full(128 ** n, -1, np.int16) if n <= 3 else None

    def of(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        places = len(points) - self.n + 1
        out, rest = np.empty(places, np.int64), np.arange(places)
        if self.ascii is not None:
            plain = np.logical_and.reduce([points[k:k + places] < 128 for k in range(self.n)])
            codes = sum(points[k:k + places] << 7 * (self.n - 1 - k) for k in range(self.n))
            codes[~plain] = 0
            found = self.ascii[codes]
            missing = np.flatnonzero(plain & (found < 0))
            if len(missing):
                new, at = np.unique(codes[missing], return_index=True)
                self.ascii[new] = [self._hash(text[i:i + self.n]) for i in missing[at].tolist()]
                found = self.ascii[codes]
            out[plain] = found[plain]
            rest = np.flatnonzero(~plain)
        if len(rest):
            out[rest] = self._others(text, points, rest)
        return out

    def _others(self, text: str, points: np.ndarray, rest: np.ndarray) -> np.ndarray:
        codes = points[rest]
        for k in range(1, self.n):  # dense numbers leave room for the next character's 21 bits
            codes = (np.unique(codes, return_inverse=True)[1] << 21) + points[rest + k]
        _, first, which = np.unique(codes, return_index=True, return_inverse=True)
        if len(self.known) > KNOWN:
            self.known.clear()
        grams = [text[i:i + self.n] for i in rest[first].tolist()]
        for gram in grams:
            if gram not in self.known:
                self.known[gram] = self._hash(gram)
        return np.array([self.known[gram] for gram in grams], np.int64)[which]

    @staticmethod
    def _hash(gram: str) -> int:
        return hashlib.md5(gram.encode()).digest()[-1]


def _pieces(texts: pa.Array, group: np.ndarray, n: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The texts joined to strings of about ``PIECE`` characters, with the group of each place and which places start an n-gram."""
    held, size = [], 0
    for text, g in zip(texts, group.tolist()):
        text = text.as_py()
        for i in range(0, len(text) - n + 1, PIECE):  # a long text in parts; each n-gram starts in one of them
            held.append((text[i:i + PIECE + n - 1], g))
            size += len(held[-1][0])
            if size >= PIECE:
                yield _joined(held, n)
                held, size = [], 0
    if held:
        yield _joined(held, n)


def _joined(held: list[tuple[str, int]], n: int) -> tuple[str, np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t, _ in held])
    starts = np.ones(int(lengths.sum()), bool)
    ends = np.cumsum(lengths)
    for k in range(1, n):
        starts[ends - k] = False
    return "".join(t for t, _ in held), np.repeat(np.array([g for _, g in held]), lengths), starts


def _count_grams(keys: list[str], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _GramBuckets(n)
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            plain = not any(pa.types.is_nested(batch.schema.field(k).type) for k in range(len(keys)))
            first = group = np.arange(rows)
            if plain:  # rows of one key go on as one, so a key of very many rows is a few lists
                names = [f"k{k}" for k in range(len(keys))]
                table = pa.table([*batch.columns[:len(keys)], pa.array(first)], names=[*names, "row"])
                lists = table.group_by(names, use_threads=False).aggregate([("row", "list")])["row_list"].combine_chunks()
                sizes, order = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
                group = np.empty(rows, np.int64)
                group[order] = np.repeat(np.arange(len(sizes)), sizes)
                first = order[np.cumsum(sizes) - sizes]
            counts = np.zeros(len(first) * BUCKETS, np.int32)
            for text, owner, starts in _pieces(batch.column(len(keys)), group, n):
                owner = owner[:len(owner) - n + 1][starts[:len(starts) - n + 1]]
                low = int(owner.min())
                found = np.bincount((owner - low) * BUCKETS + buckets.of(text)[starts[:len(starts) - n + 1]])
                counts[low * BUCKETS:low * BUCKETS + len(found)] += found.astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * BUCKETS), pa.array(counts))
            at = pa.array(first)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), lists], names=[*keys, "_counts"])
    return run


def char_ngram_counts(df: DataFrame, key: list[str], text: str, n: int = 3) -> DataFrame:
    """(key…, _counts): the 256 counts of each text of ``n`` characters or more; rows of one key in an Arrow batch are added up."""
    texts = spread(df.select(*key, text), key).select(*key, squeeze(F.col(text)).alias("_text")).where(F.length("_text") >= n)
    schema = StructType([*texts.schema.fields[:-1], StructField("_counts", ArrayType(IntegerType()))])
    return texts.mapInArrow(_count_grams(key, n), schema)


def char_ngram_tf(df: DataFrame, key: list[str], text: str, n: int = 3) -> DataFrame:
    """Sparse hashed n-gram counts: (key…, bucket, tf, weight).

    ``weight`` is tf divided by the length of the text's count vector. The bucket is
    the n-gram's MD5 modulo 256, which is its last byte. n-grams are counted where the text is read, and one
    shuffle by key of 256 counts per text (and of rows of one key in an Arrow batch) adds up the texts of a key.
    """
    counted = char_ngram_counts(df, key, text, n).groupBy(*key).agg(F.collect_list("_counts").alias("_all"))
    none = F.array_repeat(F.lit(0).cast("long"), BUCKETS)
    total = F.aggregate("_all", none, lambda whole, part: F.zip_with(whole, part, lambda x, y: x + y))
    one = F.element_at("_all", 1).cast("array<bigint>")
    summed = counted.select(*key, F.when(F.size("_all") == 1, one).otherwise(total).alias("_tf"))
    norm = F.sqrt(F.aggregate("_tf", F.lit(0).cast("long"), lambda whole, x: whole + x * x))
    normed = summed.select(*key, "_tf", norm.alias("_norm"))  # once per text, below the explode
    each = normed.select(*key, "_norm", F.posexplode("_tf").alias("bucket", "tf")).where("tf > 0")
    return each.select(*key, "bucket", "tf", (F.col("tf") / F.col("_norm")).alias("weight"))


def cosine_of_pairs(pairs: DataFrame, vectors: DataFrame, left: str, right: str, key: str) -> DataFrame:
    """Add ``cosine`` to each listed pair. ``vectors`` comes from :func:`char_ngram_tf`.

    Each text travels as one array of 256 weights, and the work grows with the
    caller's list: nothing here pairs up a whole group.
    """
    entries = F.array_sort(F.collect_list(F.struct("bucket", "weight")))
    # Buckets ascend, so the places between two of them are runs of zeros.
    before = F.concat(F.array(F.lit(-1)), F.slice("_entries.bucket", 1, F.size("_entries") - 1))
    filled = F.flatten(F.zip_with("_entries", before, lambda x, b: F.concat(
        F.array_repeat(F.lit(0.0), x["bucket"] - b - 1), F.array(x["weight"]))))
    dense = vectors.groupBy(key).agg(entries.alias("_entries")).select(
        key, F.concat(filled, F.array_repeat(F.lit(0.0), F.lit(BUCKETS - 1) - F.element_at("_entries", -1)["bucket"])).alias("_vector"))
    both = pairs.join(dense.select(F.col(key).alias(left), F.col("_vector").alias("_a")), left, "left").join(
        dense.select(F.col(key).alias(right), F.col("_vector").alias("_b")), right, "left"
    )
    dot = F.aggregate(F.zip_with("_a", "_b", lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x)
    return both.withColumn("cosine", F.coalesce(dot, F.lit(0.0))).drop("_a", "_b")
