"""All pairs of texts whose character n-gram vectors have a large cosine, as link counts per text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tidemark.functions.text import BUCKETS, char_ngram_counts
from tidemark.session import store_intermediate

BLOCK = 32768  # vectors of one side of a block at most
SMALL = 512  # vectors of a side below which more blocks do not pay
WAVES = 8  # pairs of blocks per core, so that none waits long for the last
TASKS = 4096  # tasks that pairs of blocks are dealt to at most
STRIPE = 252  # rows of a product; at most 255, so that a byte counts them
COLUMNS = 2048  # columns of a product
LEVELS = (16, 48, 112)  # directions whose product bounds the cosine
ERROR = 2e-5  # more than 260 roundings of single precision, 1.6e-5, change a product of unit vectors


def ngram_links(df: DataFrame, key: str, text: str, least: float = 0.9, n: int = 3, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(key, n_links, nearest) of each text that has a vector, and the work done, a row for each block.

    n_links counts the other texts with cosine >= ``least``, nearest is the largest of their cosines (null without any). Texts
    under ``n`` characters have no vector and no row; a null key or a repeated one is a text like others. Cosines are quotients of whole
    numbers: the product of the counts by the root of the product of their square sums. Work: rows, pairs (of different vectors),
    compared (products taken) and linked.

    Texts with equal counts are one vector with a weight, so a group of copies costs one row. Vectors are dealt by a hash to blocks of at most
    about ``block``, and each pair of blocks is one product, so no task holds more than two blocks and a vector is sent once per block. Inside,
    vectors are turned to the main directions of the block; the product over the first of them and the lengths of
    the rest bound the cosine from above (Cauchy-Schwarz), and only vectors that this leaves a partner are multiplied in full, in single
    precision. What its rounding could put on the wrong side of ``least``, or behind the nearest, is taken again in whole numbers. The pairs
    themselves never leave a block: it sends one row per vector that has links.
    """
    spark = df.sparkSession
    texts = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    counts = char_ngram_counts(texts, ["row", "key"], "text", n)  # a row is one text, so a key's texts stay apart
    counts = counts.select("key", "_counts").mapInArrow(_pack, StructType([counts.schema["key"], StructField("tf", BinaryType())]))
    counts = store_intermediate(counts, "gram-counts")
    nodes = counts.groupBy("tf").agg(F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id())
    nodes = store_intermediate(nodes, "gram-vectors")
    size = nodes.count()
    wanted = int(np.ceil(np.sqrt(2 * WAVES * spark.sparkContext.defaultParallelism)))
    blocks = max(1, -(-size // block), min(wanted, size // SMALL))
    own = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    dealt = nodes.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "tf")
    dealt = dealt.repartition(min(TASKS, blocks * (blocks + 1) // 2), "i", "j")
    found = store_intermediate(dealt.groupBy("i", "j").applyInArrow(
        _block_links(least), "node long, links long, nearest double, rows long, pairs long, compared long, linked long"), "gram-links")
    sums = found.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"), F.max("nearest").alias("nearest"))
    weighted = nodes.join(sums, "node", "left")
    alike = F.col("copies") > 1
    result = counts.join(weighted, "tf").select(
        F.col("key").alias(key), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(alike, F.lit(1.0)).otherwise(F.col("nearest")).alias("nearest"))
    return result, found.where("node is null").select("rows", "pairs", "compared", "linked")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts as bytes: 256 numbers of one, two or four bytes each, as the largest needs."""
    for batch in batches:
        counts = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, BUCKETS)
        top = counts.max(axis=1, initial=0)
        packed = [row.astype("u1" if t < 1 << 8 else "<u2" if t < 1 << 16 else "<u4").tobytes() for row, t in zip(counts, top.tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["key", "tf"])


def _unpacked(packed: pa.Array) -> np.ndarray:
    """Counts as rows of a matrix, no wider than the widest vector needs."""
    rows = packed.to_pylist()
    widths = np.array([len(x) // BUCKETS for x in rows], np.int64)
    out = np.empty((len(rows), BUCKETS), f"<u{widths.max(initial=1)}")
    for width in np.unique(widths).tolist():
        which = np.flatnonzero(widths == width)
        out[which] = np.frombuffer(b"".join([rows[k] for k in which.tolist()]), f"<u{width}").reshape(-1, BUCKETS)
    return out


class _Side:
    """Vectors of one block, turned to ``basis`` and ordered so that neighbours have partners in common."""

    def __init__(self, counts: np.ndarray, node: np.ndarray, copies: np.ndarray, basis: np.ndarray) -> None:
        self.counts, self.node, self.copies = counts, node, copies
        self.square = np.empty(len(node))
        self.unit = np.empty((len(node), BUCKETS), np.float32)
        self.levels = [np.empty((len(node), k + 1), np.float32) for k in LEVELS]
        for a in range(0, len(node), COLUMNS):  # double precision only for some at a time
            part = slice(a, a + COLUMNS)
            whole = counts[part].astype(np.float64)
            self.square[part] = (whole * whole).sum(axis=1)
            turned = whole / np.sqrt(self.square[part])[:, None] @ basis
            self.unit[part] = turned
            for k, level in zip(LEVELS, self.levels):
                level[part, :k] = turned[:, :k]
                level[part, k] = np.sqrt((turned[:, k:] ** 2).sum(axis=1))
        order = np.lexsort((self.levels[0][:, -1], self.unit[:, 2] > 0, self.unit[:, 1] > 0))
        self.counts, self.node, self.copies, self.square, self.unit = (
            x[order] for x in (self.counts, self.node, self.copies, self.square, self.unit))
        self.levels = [x[order] for x in self.levels]
        self.links, self.nearest = np.zeros(len(node), np.int64), np.zeros(len(node))


def _basis(counts: np.ndarray) -> np.ndarray:
    """Main directions of some of the vectors, largest first; the bounds hold in any basis, in this one they are tight."""
    some = counts[::max(1, len(counts) // COLUMNS)].astype(np.float64)
    some /= np.sqrt((some * some).sum(axis=1))[:, None]
    return np.linalg.eigh(some.T @ some)[1][:, ::-1]


def _cosines(left: _Side, right: _Side, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (p, q), from whole numbers that double precision holds."""
    rows, x = np.unique(p, return_inverse=True)
    columns, y = np.unique(q, return_inverse=True)
    if len(p) * 16 > len(rows) * len(columns):  # most of a rectangle
        dot = (left.counts[rows].astype(np.float64) @ right.counts[columns].T.astype(np.float64))[x, y]
    else:
        dot = np.concatenate([np.zeros(0), *(np.einsum(
            "ij,ij->i", left.counts[p[a:a + COLUMNS]].astype(np.float64), right.counts[q[a:a + COLUMNS]].astype(np.float64))
            for a in range(0, len(p), COLUMNS))])
    return dot / np.sqrt(left.square[p] * right.square[q])


def _product(a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """a @ b.T in ``room``, which stays in the core's cache."""
    return np.matmul(a, b.T, out=room[:len(a) * len(b)].reshape(len(a), len(b)))


def _partners(left: _Side, right: _Side, rows: slice, columns: slice, least: float, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a product among which no bound rules out a link."""
    p, q = np.arange(rows.start, rows.stop), np.arange(columns.start, columns.stop)
    for k, (a, b) in enumerate(zip(left.levels, right.levels)):
        bound = _product(a[p], b[q], room) if k else _product(a[rows], b[columns], room)
        q = q[bound.max(axis=0, initial=-1) >= least - ERROR]
        p = p[bound.max(axis=1, initial=-1) >= least - ERROR]
    return p, q


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is set; over the flat mask this takes a fraction of the time of ``np.nonzero``."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def _link(left: _Side, right: _Side, p: np.ndarray, q: np.ndarray, product: np.ndarray, least: float) -> int:
    """Add the links of a product to both sides and return how many they are; pairs to be left out are -inf."""
    hit = product >= least - ERROR
    x, y = _places(hit & (product < least + ERROR))
    if len(x):
        wrong = _cosines(left, right, p[x], q[y]) < least
        hit[x[wrong], y[wrong]] = False
        product[x[wrong], y[wrong]] = -np.inf
    across = np.bitwise_count(np.packbits(hit, axis=1)).sum(axis=1, dtype=np.int64)
    left.links[p] += across
    right.links[q] += np.add.reduce(hit.view(np.uint8), axis=0, dtype=np.uint8)
    many = np.flatnonzero(right.copies[q] > 1)
    if len(many):
        left.links[p] += (hit[:, many].astype(np.float64) @ (right.copies[q[many]] - 1)).astype(np.int64)
    many = np.flatnonzero(left.copies[p] > 1)
    if len(many):
        right.links[q] += ((left.copies[p[many]] - 1) @ hit[many].astype(np.float64)).astype(np.int64)
    # Only what may be nearer than the nearest so far: the first few stripes of a row's or a column's.
    for axis, side, at in ((1, left, p), (0, right, q)):
        top = product.max(axis=axis)
        better = np.flatnonzero((top >= least - ERROR) & (top > side.nearest[at] - ERROR))
        if len(better):
            part = product[better] if axis else product[:, better].T
            x, y = _places(part >= (top[better] - 2 * ERROR)[:, None])
            x = better[x]
            keep = hit[x, y] if axis else hit[y, x]
            x, y = (x[keep], y[keep]) if axis else (y[keep], x[keep])
            cosine = _cosines(left, right, p[x], q[y])
            np.maximum.at(left.nearest, p[x], cosine)
            np.maximum.at(right.nearest, q[y], cosine)
    return int(across.sum())


def _block_links(least: float):
    def run(key, block):
        i, j = key[0].as_py(), key[1].as_py()
        own, node, copies = (np.asarray(block[c]) for c in ("own", "node", "copies"))
        counts = _unpacked(block["tf"].combine_chunks())
        basis = _basis(counts)
        sides = [_Side(counts[own == k], node[own == k], copies[own == k], basis) for k in sorted({i, j})]
        del counts, block
        left, right = sides[0], sides[-1]
        same = i == j
        height, width = len(left.node), len(right.node)
        stripe = min(STRIPE, max(16, height // 32))
        room = np.empty(stripe * COLUMNS, np.float32)
        compared = linked = 0
        for b in range(0, width, COLUMNS):
            for a in range(0, height, stripe):
                rows = slice(a, min(a + stripe, height))
                columns = slice(max(a + 1, b) if same else b, min(b + COLUMNS, width))
                if columns.start >= columns.stop:
                    break  # a block with itself: the columns after a row
                p, q = _partners(left, right, rows, columns, least, room)
                if not len(p) or not len(q):
                    continue
                product = _product(left.unit[p], right.unit[q], room)
                compared += product.size
                if same and q[0] <= p[-1]:
                    out = q <= p[:, None]
                    product[out] = -np.inf
                    compared -= int(out.sum())
                linked += _link(left, right, p, q, product, least)
        pairs = height * (height - 1) // 2 if same else height * width
        node, links, nearest = (np.concatenate([getattr(s, c) for s in sides]) for c in ("node", "links", "nearest"))
        has = np.flatnonzero(links)
        n = len(has)
        summary = [height if same else 0, pairs, compared, linked]
        return pa.table({
            "node": pa.array([*node[has].tolist(), None], pa.int64()), "links": pa.array([*links[has].tolist(), None], pa.int64()),
            "nearest": pa.array([*nearest[has].tolist(), None], pa.float64()),
            **{c: pa.array([None] * n + [v], pa.int64()) for c, v in zip(("rows", "pairs", "compared", "linked"), summary)}})
    return run
