"""Packing of tokenised documents into sequences of one length, with as little padding as can be."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import give_back, ship, stored
from tidemark.llm.tokens import encoder

BROADCAST_ROWS = 200_000
ENCODED_ROWS, ENCODED_BYTES = 256, 1 << 19  # texts encoded at a time: work arrays are many times as large


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise, cut and place all documents: a row per piece with its sequence.

    ``docs`` has doc_id and text. A document is its ids (whole text, no special tokens) and
    ``end_id``; null and empty texts are that id alone. Documents of more than ``capacity`` ids are
    cut, into pieces of ``capacity`` and a last shorter one; no other is. Returns doc_id, piece, start
    (ids of the document before the piece), length, ids (binary, little-endian
    unsigned 32-bit), sequence_id, offset: within a sequence the offsets follow each other from 0 without a
    gap. Repeated rows are packed as often as they stand there, null doc_ids like others; an
    empty table gives an empty table. Other columns are not looked at.

    Method. Pieces are written once, numbered within (task, length). Only how many pieces have
    each length - at most ``capacity`` numbers - reaches the driver, where
    ``plan_sequences`` makes it a list of patterns. A piece's rank among those of its length
    then says its pattern, and so its sequence, without any exchange of ids.
    """
    ship(docs.sparkSession)
    pieces = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _cut_pieces(tokenizer, capacity, end_id),
        "doc_id long, piece int, start long, length long, ids binary, task int, place long"), "pieces")
    counts = stored(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    totals = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan_sequences(totals, capacity))
    before = counts.selectExpr(
        "length", "task", "sum(n) OVER (PARTITION BY length ORDER BY task ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before")
    before = stored(before, "piece-ranks")
    if before.count() <= BROADCAST_ROWS:
        before = F.broadcast(before)
    ranked = pieces.join(before, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids", (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(
        _place(slots), "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


def _cut_pieces(tokenizer: str, capacity: int, end_id: int):
    def run(batches):
        task = TaskContext.get().partitionId()
        own = encoder(tokenizer)
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for i, j in _groups(texts):
                ids, borders = own.encode(texts[i:j])
                rows, out = [], []
                for k in range(len(borders) - 1):
                    body = np.append(ids[borders[k]:borders[k + 1]], np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(body), capacity)):
                        part = body[start:start + capacity]
                        rows.append((i + k, piece, start, len(part), seen[len(part)]))
                        seen[len(part)] += 1
                        out.append(part.tobytes())
                at, piece, start, length, place = (np.array(c, np.int64) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays([
                    doc_ids.take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.array(out, pa.binary()), pa.array(np.full(len(at), task, np.int32)), pa.array(place),
                ], ["doc_id", "piece", "start", "length", "ids", "task", "place"])
            give_back()
    return run


def _groups(texts: pa.Array) -> list[tuple[int, int]]:
    """Borders of ENCODED_ROWS texts at most that together have ENCODED_BYTES at most; a longer text is alone."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))
    groups, i = [], 0
    while i < len(ends):
        before = int(ends[i - 1]) if i else 0
        j = int(np.searchsorted(ends, before + ENCODED_BYTES, "right"))
        groups.append((i, min(max(j, i + 1), i + ENCODED_ROWS)))
        i = groups[-1][1]
    return groups


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns (times, lengths) that use up ``counts`` (length -> pieces); a pattern fits in ``capacity``.

    Longest first, each length looks up what fills its gap exactly: one length, then two, then
    three, as far as there are pieces of them. What finds no exact complement is placed by
    best fit, longest first. Work and result grow with the number of lengths, not of pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} ids cannot be placed in {capacity}")
        left[length] = n
    patterns: list[tuple[int, list[int]]] = []

    def take(lengths: list[int]) -> None:
        times = min(int(left[x]) // lengths.count(x) for x in set(lengths))
        for x in lengths:
            left[x] -= times
        patterns.append((times, lengths))

    def one(gap: int, own: list[int]) -> list[int] | None:
        return [gap] if gap > 0 and left[gap] > own.count(gap) else None

    def two(gap: int, own: list[int]) -> list[int] | None:
        low = np.arange(1, gap // 2 + 1)
        for a in low[(left[low] > 0) & (left[gap - low] > 0)][::-1].tolist():
            rest = [gap - a, a]
            if all(left[x] >= (own + rest).count(x) for x in rest):
                return rest
        return None

    def three(gap: int, own: list[int]) -> list[int] | None:
        for a in (np.flatnonzero(left[1:max(gap - 1, 1)]) + 1)[::-1].tolist():
            rest = two(gap - a, own + [a]) if left[a] > own.count(a) else None
            if rest and all(left[x] >= (own + [a] + rest).count(x) for x in [a] + rest):
                return [a] + rest
        return None

    residual = []
    if left[capacity]:
        take([capacity])
    for length in range(capacity - 1, 0, -1):
        for find in (one, two, three):
            while left[length] and (rest := find(capacity - length, [length])):
                take([length] + rest)
        if left[length]:
            residual.append((length, int(left[length])))
            left[length] = 0
    return patterns + _best_fit(residual, capacity)


def _best_fit(lengths: list[tuple[int, int]], capacity: int) -> list[tuple[int, list[int]]]:
    """Best fit over (length, pieces), longest first; equal bins are kept as one with a number."""
    bins: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # by gap
    for length, n in lengths:
        while n:
            gap = min((g for g, b in bins.items() if g >= length and b), default=None)
            if gap is None:
                each = min(capacity // length, n)
                bins[capacity - each * length].append((n // each, [length] * each))
                n -= n // each * each
                continue
            times, held = bins[gap].pop()
            used = min(times, n)
            if times > used:
                bins[gap].append((times - used, held))
            bins[gap - length].append((used, held + [length]))
            n -= used
    return [b for group in bins.values() for b in group]


def _slots(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its slots, ascending, with the sequence of that rank and the offset."""
    slots, used, sequence = defaultdict(list), defaultdict(int), 0
    for times, lengths in patterns:
        offset = 0
        for length in lengths:
            slots[length].append((used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return {length: tuple(np.array(c, np.int64) for c in zip(*rows)) for length, rows in slots.items()}


def _place(slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches):
        for batch in batches:
            length, rank = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                first, base, place = slots[x]
                k = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = base[k] + rank[at] - first[k], place[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])
    return run
