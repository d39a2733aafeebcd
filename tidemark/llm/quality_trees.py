"""Quality rules: boosted trees over statistics of whole documents, as flat numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.labelled import learning_rows
from tidemark.llm.tables import give_back, ship
from tidemark.llm.wordhash import chain, hash_words, text_buffer, word_starts

# The base statistics and the rules on them.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Shares the trees see, and whether more of one may only lower (-1) the probability of label 1.
FEATURES = {
    "words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": 0,
    "mark_share": -1, "words_per_line": 0, "twin_share": -1,
}
MOST_ROWS = 4000
REPEAT_WINDOW = 3
ROWS_AT_ONCE = 256


def document_statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts of each text, and the matrix of FEATURES; a few rows at a time, so that little is held."""
    parts = [_statistics(column.slice(i, ROWS_AT_ONCE)) for i in range(0, max(len(column), 1), ROWS_AT_ONCE)]
    return {c: np.concatenate([counts[c] for counts, _ in parts]) for c in COUNTS}, np.concatenate([x for _, x in parts])


def _statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    body, borders = text_buffer(column)
    starts = word_starts(body, borders)
    words = hash_words(body, starts)
    at = np.searchsorted(starts, borders)
    n_words = np.diff(at)
    blank = np.zeros(256, bool)
    blank[[0x20, 9, 10, 11, 12, 13]] = True
    kinds = {
        "chars": ~blank & ((np.arange(256) & 0xC0) != 0x80), "symbols": np.isin(np.arange(256), list(SYMBOLS)),
        "upper": (np.arange(256) >= 65) & (np.arange(256) <= 90), "digit": (np.arange(256) >= 48) & (np.arange(256) <= 57),
        "marks": np.isin(np.arange(256), list(b"!?|")),
    }
    sums = {}
    for name, table in kinds.items():
        total = np.concatenate([[0], np.cumsum(table[body], dtype=np.int64)])
        sums[name] = total[borders[1:]] - total[borders[:-1]]
    lines, dup_lines = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
    data = body.tobytes()
    for k, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist())):
        own = [x for x in data[a:b].split(b"\n") if x.split(None, 1)]
        lines[k], dup_lines[k] = len(own), len(own) - len(set(own))
    repeat = _repeated_words(words, at)
    same = np.zeros(len(words) + 1, np.int64)
    if len(words) > 1:
        same[2:] = np.cumsum(words[1:] == words[:-1])
    twins = np.maximum(same[at[1:]] - same[np.minimum(at[:-1] + 1, at[1:])], 0)
    counts = {"n_words": n_words, "word_chars": sums["chars"], "n_symbols": sums["symbols"], "n_dup_lines": dup_lines, "n_repeat_words": repeat}
    w, c = np.maximum(n_words, 1), np.maximum(sums["chars"], 1)
    features = np.stack([
        np.log1p(n_words), sums["chars"] / w, sums["symbols"] / c, dup_lines / np.maximum(lines, 1), repeat / w,
        sums["upper"] / c, sums["digit"] / c, sums["marks"] / c, np.log1p(n_words / np.maximum(lines, 1)), twins / w,
    ], axis=1)
    return counts, features


def _repeated_words(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many words of each text lie in a window of REPEAT_WINDOW words that its text has twice or more."""
    out = np.zeros(len(at) - 1, np.int64)
    for i in range(0, len(out), 200):
        j = min(i + 200, len(out))
        lo, hi = int(at[i]), int(at[j])
        n = hi - lo
        if n < REPEAT_WINDOW:
            continue
        own = words[lo:hi]
        window = own[: n - REPEAT_WINDOW + 1]
        for k in range(1, REPEAT_WINDOW):
            window = chain(window, own[k:n - REPEAT_WINDOW + 1 + k])
        doc = np.repeat(np.arange(i, j), np.diff(at[i:j + 1]))
        inside = np.flatnonzero(doc[: len(window)] == doc[REPEAT_WINDOW - 1:])
        keyed = chain(window[inside], doc[inside].astype(np.uint64))
        order = np.argsort(keyed)
        ranked = keyed[order]
        twice = np.zeros(len(ranked), bool)
        equal = ranked[1:] == ranked[:-1]
        twice[1:] |= equal
        twice[:-1] |= equal
        covered = np.zeros(n + 1, np.int64)
        hit = inside[order[twice]]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + REPEAT_WINDOW, -1)
        out[i:j] = np.bincount(doc[np.cumsum(covered)[:-1] > 0] - i, minlength=j - i)
    return out


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf points to itself."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.limit[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 40, depth: int = 3, rate: float = 0.2,
         bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Boosted trees on the logistic loss over binned features; both labels weigh the same.

    ``monotone``: per feature -1, 0 or 1, the sign the probability may move with. A split against it is
    not taken, and the middle between two children bounds all leaves below them.
    """
    limits = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(limits[f], x[:, f], "left") for f in range(x.shape[1])], axis=1)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    nodes: list[list[float]] = []  # feature, limit, left, right, value
    roots, total = [], np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (y - p), weight * p * (1 - p)

        def build(rows: np.ndarray, level: int, low: float, high: float) -> int:
            me = len(nodes)
            value = float(np.clip(g[rows].sum() / (h[rows].sum() + ridge), low, high))
            nodes.append([0, np.inf, me, me, rate * value])
            best = (1e-6, None, None)
            if level < depth:
                for f, edges in enumerate(limits):
                    if not len(edges):
                        continue
                    gs = np.cumsum(np.bincount(binned[rows, f], g[rows], len(edges) + 1))
                    hs = np.cumsum(np.bincount(binned[rows, f], h[rows], len(edges) + 1))
                    gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
                    wl, wr = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
                    gain = gl ** 2 / (hl + ridge) + gr ** 2 / (hr + ridge) - gs[-1] ** 2 / (hs[-1] + ridge)
                    gain[(hl < least) | (hr < least) | (monotone[f] * (wr - wl) < 0)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
            if best[1] is None:
                total[rows] += rate * value
                return me
            _, f, k = best
            goes = binned[rows, f] <= k
            middle = [float(np.clip(g[part].sum() / (h[part].sum() + ridge), low, high)) for part in (rows[goes], rows[~goes])]
            mid = sum(middle) / 2
            bounds = {-1: ((mid, high), (low, mid)), 0: ((low, high), (low, high)), 1: ((low, mid), (mid, high))}[monotone[f]]
            left, right = build(rows[goes], level + 1, *bounds[0]), build(rows[~goes], level + 1, *bounds[1])
            nodes[me][:4] = [f, float(limits[f][k]), left, right]
            return me

        roots.append(build(np.arange(len(y)), 0, -4.0, 4.0))
    table = np.array(nodes)
    return Trees(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], np.array(roots), depth, 0.0)


def fit_quality_trees(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Trees | None:
    """Trees learned from at most ``most_rows`` labelled rows that are not held out; None without rows of both labels."""
    ship(docs.sparkSession)

    def features_of(batches):
        for batch in batches:
            _, x = document_statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    rows = learning_rows(docs, labels, most_rows).mapInArrow(features_of, "doc_id long, quality int, x array<double>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    y = np.array([r["quality"] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    return grow(np.array([r["x"] for r in rows]), y, list(FEATURES.values()))


def judge_quality(docs: DataFrame, trees: Trees | None, least_score: float = 0.3) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, score and kept to ``docs``.

    ``docs`` has text; other columns are kept (those names are replaced). All counts are over the whole text;
    a null text counts as empty. base_failed: under 50 words, or more than half of them in repeated
    three-word windows. kept: not base_failed, and the trees' probability of label 1 is at least
    ``least_score`` (without trees every score is 1). Rows are judged one by one: repeated rows get equal
    verdicts, an empty table stays empty. Nothing is shuffled.
    """
    ship(docs.sparkSession)
    kind = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,score:double>"

    @F.arrow_udf(kind)
    def judged(texts: pa.Array) -> pa.Array:
        counts, x = document_statistics(texts)
        score = trees.probability(x) if trees is not None else np.ones(len(x))
        give_back()
        return pa.StructArray.from_arrays([*(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(score)], [*COUNTS, "score"])

    names = [c for c in docs.columns if c not in (*COUNTS, "base_failed", "score", "kept")]
    out = docs.select(F.struct(*names).alias("row"), judged("text").alias("judged")).select("row.*", "judged.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least_score))
