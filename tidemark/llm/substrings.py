"""Removal of long passages that an earlier document has: substring de-duplication by recompression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.recompress import anchors, parse
from tidemark.llm.tables import ship, stored
from tidemark.llm.wordhash import hash_spans, hash_windows, text_buffer, word_hashes, word_starts, words_of

WORDS_AT_ONCE = 250_000
BROADCAST_ROWS = 1_000_000  # keys of 8 bytes


def remove_repeats(docs: DataFrame, window: int = 50, rounds: int = 3) -> DataFrame:
    """Cut from each text the words of every passage of ``window`` words that starts in a document with a smaller doc_id.

    ``docs`` has doc_id and text; other columns are kept. Returns the columns of ``docs`` with
    text replaced by the kept words joined by one space, and n_words, n_removed (long; columns
    of these names in ``docs`` are replaced). Passages are judged on the input. Null or empty
    texts have no words and become ''. A null doc_id is smaller than nothing and has nothing
    smaller: its text keeps all words and removes none. Rows that share a doc_id are one
    document: none of them removes words of another. An empty table gives an empty table.

    Method. (1) Each text is parsed by recompression: rounds name runs and pairs of symbols, and
    names are hashes of content, so they agree over the corpus without a shared dictionary.
    One symbol of its inside stands for each window; a stretch of windows with one symbol is a row,
    with a hash of all its words. (2) Spark counts in which documents a name occurs: windows
    under a name that one document alone has repeat nowhere else. (3) Stretches equal as a whole to one of an
    earlier document are cut. (4) Where a name has different stretches, all those of each kind in its first
    document are taken apart into windows, named by 128 bits of their words, and the least doc_id by name decides.
    Stretches without an inside symbol (one word over and over) go to (4) at once. Texts
    are shuffled only if (4) looks into them or words are cut from them, as long as the keys of those
    texts are few enough to send out (a count decides); else all are.
    """
    ship(docs.sparkSession)
    keyed = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit(""))).withColumn("_row", F.xxhash64("doc_id", "_text"))
    texts = keyed.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "_row", "_text")
    span = "doc_id long, row long, first int, last int"
    named = stored(texts.mapInArrow(_name_windows(window, rounds), f"name long, content long, {span}"), "names")
    # stored, so that the join reads two plain exchanges and Spark can split the rows of a name that very many documents have
    names = stored(named.where("name is not null").groupBy("name")
                   .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("content").alias("c0"), F.max("content").alias("c1"))
                   .where("lo < hi").selectExpr("name", "c0 < c1 AS several"), "repeated-names")
    shared = stored(named.join(names, "name"), "shared-names")
    kinds = stored(shared.groupBy("name", "content", "several").agg(F.min("doc_id").alias("lo")), "kinds")
    whole = shared.join(kinds.select("name", "content", "lo"), ["name", "content"]).where("doc_id > lo")
    firsts = shared.where("several").join(kinds.where("several").select("name", "content", "lo"), ["name", "content"]).where("doc_id = lo")
    look = firsts.select("row", "first", "last").union(named.where("name is null").select("row", "first", "last"))
    ranges = stored(_lists(look, "ranges"), "ranges")
    checked = _of_rows(texts, ranges).select("doc_id", "_row", "_text", "ranges")
    hashed = stored(checked.mapInArrow(_hash_windows(window), f"h1 long, h2 long, {span}"), "windows")
    earliest = stored(hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
                      .select("h1", "h2", "lo"), "earliest")
    single = hashed.join(earliest, ["h1", "h2"]).where("doc_id > lo")
    cuts = stored(_lists(whole.select("row", "first", "last").union(single.select("row", "first", "last")), "_cuts"), "cuts")

    names_left = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    plain = [F.col("_text").alias("text") if c == "text" else F.col(f"`{c}`") for c in names_left]
    columns = [*plain, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed")]
    if cuts.count() <= BROADCAST_ROWS:
        keys = F.broadcast(cuts.select(F.col("row").alias("_row")))
        touched = keyed.where("doc_id is not null").join(keys, "_row", "left_semi").join(cuts.withColumnRenamed("row", "_row"), "_row")
        rest = keyed.where("doc_id is not null").join(keys, "_row", "left_anti")
    else:
        touched = keyed.where("doc_id is not null").join(cuts.withColumnRenamed("row", "_row"), "_row", "left")
        rest = keyed.limit(0)
    uncut = F.lit(None).cast(cuts.schema["_cuts"].dataType).alias("_cuts")
    joined = touched.select(*columns, "_cuts").union(rest.select(*columns, uncut)).union(
        keyed.where("doc_id is null").select(*columns, uncut))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names_left)
    return joined.mapInArrow(_cut(window), f"{fields}, n_words long, n_removed long")


def _lists(ranges: DataFrame, name: str) -> DataFrame:
    """The ranges of each row of ``docs``, at most as many as the row has words."""
    return ranges.groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias(name))


def _of_rows(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """The texts that have a list, with it; where the lists are few, other texts are not shuffled."""
    lists = lists.withColumnRenamed("row", "_row")
    if lists.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(lists.select("_row")), "_row", "left_semi")
    return texts.join(lists, "_row")


def _chunks(borders: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about WORDS_AT_ONCE words, one row at least."""
    i = 0
    while i < len(borders) - 1:
        j = max(i + 1, int(np.searchsorted(borders, borders[i] + WORDS_AT_ONCE, "right")) - 1)
        yield i, j
        i = j


def _window_starts(borders: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where windows start, and the row of each."""
    count = np.maximum(np.diff(borders) - window + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    return borders[:-1][row] + np.arange(len(row)) - (np.cumsum(count) - count)[row], row


def _runs_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs over which all keys stay the same."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(change)
    return first, np.append(first[1:], n) - 1


def _name_windows(window: int, rounds: int):
    def run(batches):
        for batch in batches:
            words, borders = words_of(batch.column(2))
            ids, rows = batch.column(0), batch.column(1)
            for i, j in _chunks(borders):
                own = borders[i:j + 1] - borders[i]
                starts, row = _window_starts(own, window)
                if not len(starts):
                    continue
                symbols = parse(words[borders[i]:borders[j]], own, rounds)
                at = anchors(symbols, starts, window)
                head, tail = _runs_of(row, at)
                found = at[head] >= 0
                name = symbols["name"][np.maximum(at[head], 0)]
                content = hash_spans(words[borders[i]:borders[j]], starts[head], starts[tail] + window)
                who = pa.array(row[head] + i)
                yield pa.RecordBatch.from_arrays([
                    pa.array(name.view(np.int64), mask=~found), pa.array(content.view(np.int64)), ids.take(who), rows.take(who),
                    pa.array((starts[head] - own[row[head]]).astype(np.int32)),
                    pa.array((starts[tail] - own[row[head]]).astype(np.int32)),
                ], ["name", "content", "doc_id", "row", "first", "last"])
    return run


def _hash_windows(window: int):
    def run(batches):
        for batch in batches:
            body, byte_borders = text_buffer(batch.column(2))
            begins = word_starts(body, byte_borders)
            borders = np.searchsorted(begins, byte_borders)
            one, two = word_hashes(body, begins, (0, 1))
            lists = batch.column(3)
            offsets = np.asarray(lists.offsets)
            pairs = lists.values
            first = np.asarray(pairs.field(0)) if len(pairs) else np.zeros(0, np.int32)
            last = np.asarray(pairs.field(1)) if len(pairs) else np.zeros(0, np.int32)
            for i, j in _chunks(borders):
                a, b = int(borders[i]), int(borders[j])
                if b - a < window:
                    continue
                wanted = np.zeros(b - a + 1, np.int32)
                at = np.arange(offsets[i], offsets[j])
                row = np.repeat(np.arange(i, j), np.diff(offsets[i:j + 1]))
                np.add.at(wanted, first[at] + borders[row] - a, 1)
                np.add.at(wanted, last[at] + 1 + borders[row] - a, -1)
                places = np.flatnonzero(np.cumsum(wanted)[:-1] > 0)
                if not len(places):
                    continue
                h1, h2 = (hash_windows(words[a:b], window)[places] for words in (one, two))
                owner = np.searchsorted(borders, places + a, "right") - 1
                head, tail = _runs_of(owner, h1, h2, places - np.arange(len(places)))
                who = pa.array(owner[head])
                yield pa.RecordBatch.from_arrays([
                    pa.array(h1[head].view(np.int64)), pa.array(h2[head].view(np.int64)),
                    batch.column(0).take(who), batch.column(1).take(who),
                    pa.array((places[head] + a - borders[owner[head]]).astype(np.int32)),
                    pa.array((places[tail] + a - borders[owner[head]]).astype(np.int32)),
                ], ["h1", "h2", "doc_id", "row", "first", "last"])
    return run


def _cut(window: int):
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts, cuts = batch.column(names.index("text")), batch.column(names.index("_cuts"))
            kept, n_words, n_removed = [], [], []
            for text, cut in zip(texts, cuts):
                words = text.as_buffer().to_pybytes().split()
                n = len(words)
                if cut.is_valid and len(cut):
                    covered = np.zeros(n + 1, np.int32)
                    first = np.asarray(cut.values.field(0)).astype(np.int64)
                    last = np.asarray(cut.values.field(1)).astype(np.int64)
                    np.add.at(covered, first, 1)
                    np.add.at(covered, last + window, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(covered)[:-1] == 0)]
                kept.append(b" ".join(words))
                n_words.append(n)
                n_removed.append(n - len(words))
            columns = {c: batch.column(k) for k, c in enumerate(names) if c != "_cuts"}
            columns["text"] = pa.array(kept, pa.binary()).cast(pa.string())
            columns["n_words"], columns["n_removed"] = pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    return run
