"""Periodic runs of words in whole texts, and the texts without the repetitions."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import ship

WORDS_AT_A_TIME = 200_000  # words of short documents that are sorted together

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse_runs(docs: DataFrame, least_length: int = 6, least_periods: int = 4) -> DataFrame:
    """Add n_words, runs and collapsed to ``docs`` (text and others; columns of those names are replaced).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, numbered from 0. A run is a stretch of words with smallest period
    q, no shorter than ``least_length`` and ``least_periods`` * q words (2 periods at least), which no neighbouring word extends
    with that period. runs is an array of (start, length, period) by start, then period; collapsed has the words that no run
    contains after its first q words, joined by one space. Null, empty and blank texts have no words, no
    runs and an empty collapsed text. Rows are judged one by one, so repeated rows get equal results; an
    empty table stays empty. Nothing is shuffled; a task holds some documents, or one long one, at a time.

    Method. The suffixes of a document's words are sorted by doubling, which also gives the length L of the longest
    common prefix (LCP) of neighbours in that order. By descending L, as in Kruskal's algorithm, neighbours are united into
    classes of suffixes that share their first L words; each class keeps its positions in order. Positions i < j that become
    next to each other in a class of level L, j - i <= L, share exactly L words and no position between
    them does, so j - i is the smallest period of the words from i to j + L: a run, if the word before i differs from the one before j.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>")
    def found(texts: pa.Array) -> pa.Array:
        return _collapsed(texts, least_length, least_periods)

    names = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    return docs.select(F.struct(*names).alias("row"), found("text").alias("found")).select("row.*", "found.*")


def _collapsed(texts: pa.Array, least_length: int, least_periods: int) -> pa.Array:
    counts, runs, out, held, words = [], [], [], [], 0
    for k, text in enumerate(texts):
        held.append((text.as_py() or "").encode().split())  # bytes are split at 0x20 and 0x09-0x0D
        words += len(held[-1])
        if words >= WORDS_AT_A_TIME or k == len(texts) - 1:
            for own, found in zip(held, runs_of(held, least_length, least_periods)):
                counts.append(len(own))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                out.append(b" ".join(_kept(own, found)).decode())
            held, words = [], 0
    return pa.StructArray.from_arrays(
        [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(out, pa.string())], ["n_words", "runs", "collapsed"])


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]


def runs_of(docs: list[list], least_length: int = 6, least_periods: int = 4) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start, then period."""
    borders = np.cumsum([0] + [len(d) for d in docs])
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for d in docs for w in d), np.int64, int(borders[-1]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    times = max(least_periods, 2) - 1  # LCP / period, at least
    least = min(max(least_length - q, times * q) for q in range(1, max(least_length, 1) + 1))  # no run has a shorter LCP
    places, lcp = _neighbours(ids, borders, max(least, 1))
    if not len(places):
        return out
    before = np.where(np.isin(np.arange(len(ids)), borders), -1 - np.arange(len(ids)), np.roll(ids, 1))  # no word stands before a document
    of = np.searchsorted(borders, places, side="right") - 1
    for i, period, common in _seeds(places, lcp, before, max(least, 1), times, least_length):
        doc = int(np.searchsorted(borders, i, side="right")) - 1
        out[doc].append((int(i - borders[doc]), int(period + common), int(period)))
    for doc in np.unique(of):
        out[doc].sort(key=lambda r: (r[0], r[2]))
    return out


def _neighbours(ids: np.ndarray, borders: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose first words stand elsewhere in their document too, in the order of their suffixes, and the LCP of each with the next one.

    A suffix's rank after level k is the number of suffixes with smaller first k words, so a rank that one suffix
    alone has is final, and only the others are sorted again. LCPs below ``least`` are given as 0.
    """
    n = len(ids)
    end = np.repeat(borders[1:], np.diff(borders))
    rank = np.zeros(n, np.int64)
    rank += np.repeat(np.arange(len(borders) - 1), np.diff(borders)) * (int(ids.max(initial=0)) + 1) + ids
    rank, open_ = _ranked(rank, np.arange(n), np.zeros(n, np.int64))
    levels, k, kept = [rank.astype(np.int32)], 1, None
    while len(open_):
        if 2 * k > least and kept is None:
            kept = open_  # what shares its first k <= least words with another suffix
        after = open_ + k
        second = np.where(after < end[open_], rank[np.minimum(after, n - 1)] + 1, 0)
        new, still = _ranked(second, open_, rank)
        rank, open_, k = new, still, 2 * k
        levels.append(rank.astype(np.int32))
    if kept is None or not len(kept):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = kept[np.argsort(rank[kept])]
    x, y = places[:-1].copy(), places[1:].copy()
    lcp = np.zeros(len(x), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ranks = levels[level]
        same = (x < n) & (y < n)
        same[same] = ranks[x[same]] == ranks[y[same]]
        step = same * (1 << level)
        x, y, lcp = x + step, y + step, lcp + step
    return places, np.where(lcp >= least, lcp, 0)


def _ranked(second: np.ndarray, places: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks refined by a second key of ``places``, and the places whose rank is still shared."""
    first = rank[places]
    order = np.lexsort((second, first))
    first, second, at = first[order], second[order], places[order]
    old = np.ones(len(at), bool)
    old[1:] = first[1:] != first[:-1]
    new = old.copy()
    new[1:] |= second[1:] != second[:-1]
    here = np.arange(len(at))
    start_old = np.maximum.accumulate(np.where(old, here, 0))
    start_new = np.maximum.accumulate(np.where(new, here, 0))
    rank = rank.copy()
    rank[at] = first + start_new - start_old
    alone = new.copy()
    alone[:-1] &= new[1:]
    return rank, np.sort(at[~alone])


def _seeds(places, lcp, before, least: int, times: int, least_length: int) -> list[tuple[int, int, int]]:
    """(start, period, LCP) of every run: classes are united by descending LCP, each an ordered list of positions."""
    order = np.argsort(-lcp, kind="stable")
    order = order[: int((lcp >= least).sum())]
    if not len(order):
        return []
    index = {int(p): t for t, p in enumerate(places)}
    up, classes = list(range(len(places))), [[int(p)] for p in places]

    def top(t: int) -> int:
        while up[t] != t:
            up[t] = up[up[t]]
            t = up[t]
        return t

    found, at, edges, levels = [], 0, order.tolist(), lcp[order].tolist()
    while at < len(edges):
        level = levels[at]
        widest, fresh = level // times, []
        while at < len(edges) and levels[at] == level:
            a, b = top(edges[at]), top(edges[at] + 1)
            at += 1
            if len(classes[a]) < len(classes[b]):
                a, b = b, a
            large, small = classes[a], classes[b]
            up[b], classes[b] = a, None
            if large[-1] < small[0]:
                if small[0] - large[-1] <= widest:
                    fresh.append((large[-1], small[0]))
                large.extend(small)
                continue
            last = -1
            for p in small:
                k = bisect_left(large, p)
                if k and large[k - 1] != last and p - large[k - 1] <= widest:
                    fresh.append((large[k - 1], p))
                if k < len(large) and large[k] - p <= widest:
                    fresh.append((p, large[k]))
                large.insert(k, p)
                last = p
        for i, j in fresh:
            if j - i + level >= least_length and before[i] != before[j]:
                whole = classes[top(index[i])]
                k = bisect_right(whole, i)
                if whole[k] == j:  # nothing has come between them at this level
                    found.append((i, j - i, level))
    return found
