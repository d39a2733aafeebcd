"""Token ids of a corpus in files: grammar-compressed shards in ascending doc_id order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import grammar
from tidemark.llm.tables import give_back, ship
from tidemark.llm.tokens import encoder

BROADCAST_ROWS = 200_000
SHARD = ("task int, shard int, n_docs long, n_ids long, first_symbol long, symbol_bytes int, doc_ids binary, no_id binary, "
         "doc_ends binary, symbols binary, rules binary, rule_lengths binary")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_ids: int = 1_000_000,
                 rounds: int | None = None, most_rules: int | None = None, least: int = 32) -> None:
    """Write the ids of all documents to ``path``, each followed by ``end_id``, in ascending doc_id order.

    ``docs`` has doc_id and text (whole text, no special tokens; null and empty texts are the
    end id alone); other columns are not looked at. Null doc_ids come first, rows with one doc_id are
    ordered by text; repeated rows are written as often as they stand there.

    Pairs are replaced until none stands ``least`` times in a shard, unless ``rounds`` or ``most_rules`` end it sooner.

    Format: Parquet files, so that Spark's committer decides which task's files count; a row is a shard of
    whole documents, of ``shard_ids`` ids or one document more. task and shard order the rows.
    Binary columns are little-endian arrays: doc_ids int64, no_id uint8 (1: the doc_id is null),
    doc_ends int64 (symbols up to the end of each document), symbols (``symbol_bytes`` each) below
    first_symbol an id, else rule symbol - first_symbol, rules uint32 pairs of symbols, rule_lengths int64 (ids a rule stands
    for, so that a position is found without expanding what is before it).
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_shards(tokenizer, end_id, shard_ids, rounds, most_rules, least), SHARD).write.parquet(path)


def _shards(tokenizer, end_id, shard_ids, rounds, most_rules, least):
    def run(batches):
        task = TaskContext.get().partitionId()
        own = encoder(tokenizer)
        shard, ids, doc_ids, held = 0, [], [], 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(texts), 256):
                found, borders = own.encode(texts[i:i + 256])
                for k in range(len(borders) - 1):
                    ids.append(np.append(found[borders[k]:borders[k + 1]], np.uint32(end_id)))
                    doc_ids.append(keys[i + k])
                    held += len(ids[-1])
                    if held >= shard_ids:
                        yield _shard(task, shard, doc_ids, ids, max(own.size, end_id + 1), rounds, most_rules, least)
                        shard, ids, doc_ids, held = shard + 1, [], [], 0
        if doc_ids:
            yield _shard(task, shard, doc_ids, ids, max(own.size, end_id + 1), rounds, most_rules, least)
        give_back()
    return run


def _shard(task, shard, doc_ids, ids, first, rounds, most_rules, least) -> pa.RecordBatch:
    flat, ends = np.concatenate(ids), np.cumsum([len(x) for x in ids])
    symbols, rules, symbol_ends = grammar.compress(flat, ends, first, rounds, most_rules, least)
    width = 2 if first + len(rules) <= 1 << 16 else 4
    made = np.arange(first, first + len(rules), dtype=np.uint32)
    values = [task, shard, len(doc_ids), len(flat), first, width,
              np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], "u1").tobytes(),
              symbol_ends.astype("<i8").tobytes(), symbols.astype(f"<u{width}").tobytes(), rules.astype("<u4").tobytes(),
              grammar.lengths(made, rules, first).astype("<i8").tobytes()]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
    names = [c.split()[0] for c in SHARD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)


def read_shard(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, no_id, symbols, rules and the documents' ends of a stored shard."""
    return (np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["no_id"], "u1"),
            np.frombuffer(row["symbols"], f"<u{row['symbol_bytes']}").astype(np.uint32),
            np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["doc_ends"], "<i8"))


def read_document(row: dict, k: int) -> np.ndarray:
    """The ids of document ``k`` of a shard; nothing else of it is expanded."""
    _, _, symbols, rules, ends = read_shard(row)
    return grammar.expand(symbols[ends[k - 1] if k else 0:ends[k]], rules, row["first_symbol"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (binary, little-endian uint32), from the files."""
    ship(spark)
    shards = spark.read.parquet(path)
    order = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per writing task
    tasks = shards.groupBy("task").agg(F.sum("n_ids").alias("n")).select("task", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("task_start"))
    within = Window.partitionBy("task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("task", "shard", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("before"))
    starts = starts.join(tasks, "task").select("task", "shard", (F.col("task_start") + F.col("before")).alias("start"))
    if starts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    return shards.join(starts, ["task", "shard"]).mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids binary")


def _documents(batches):
    for batch in batches:
        for row in batch.to_pylist():
            doc_ids, no_id, symbols, rules, ends = read_shard(row)
            size = grammar.lengths(symbols, rules, row["first_symbol"])
            ids = grammar.expand(symbols, rules, row["first_symbol"]).astype("<u4")
            after = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])]
            data = pa.BinaryArray.from_buffers(pa.binary(), len(doc_ids), [
                None, pa.py_buffer((after * 4).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([
                pa.array(doc_ids, mask=no_id == 1), pa.array(after[:-1] + row["start"]), pa.array(np.diff(after)), data,
            ], ["doc_id", "start", "n_tokens", "ids"])
