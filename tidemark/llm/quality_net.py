"""Document quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.labelled import learning_rows
from tidemark.llm.tables import ship
from tidemark.llm.wordhash import text_buffer

CHUNK, STEP = 512, 448  # bytes of a chunk; neighbours overlap by 64
WIDTH, STRIDE, CODE = 8, 2, 8  # bytes a filter sees, its stride, numbers that code a byte
PLACES = (CHUNK - WIDTH) // STRIDE + 1
FILTERS, UNITS = 16, 24
MOST_ROWS = 2000  # bound of the learning sample
AT_ONCE = 256  # chunks that are looked at together


def _byte_codes() -> np.ndarray:
    """What a filter sees of a byte: kind of character, and two numbers that tell bytes of a kind apart."""
    b = np.arange(256)
    upper, lower, digit = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57)
    blank = np.isin(b, [9, 11, 12, 13, 32])
    symbol = (b > 32) & (b < 127) & ~upper & ~lower & ~digit & ~np.isin(b, [33, 39, 44, 46])
    codes = np.stack([upper, lower, digit, blank, b == 10, symbol, np.cos(b * 0.7), np.sin(b * 2.3)], axis=1).astype(np.float32)
    codes[0] = 0
    return codes


CODES = _byte_codes()


@dataclass
class Net:
    """Filters over bytes, units over a chunk's pooled filters, one weight for each unit's maximum."""

    filters: np.ndarray
    filter_bias: np.ndarray
    units: np.ndarray
    unit_bias: np.ndarray
    last: np.ndarray
    last_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int) -> "Net":
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) * np.sqrt(2 / shape[0])).astype(np.float32)
        zero = lambda n: np.zeros(n, np.float32)
        return cls(draw(WIDTH * CODE, FILTERS), zero(FILTERS), draw(2 * FILTERS, UNITS), zero(UNITS), draw(UNITS, 1)[:, 0], zero(1))

    def values(self) -> list[np.ndarray]:
        return [self.filters, self.filter_bias, self.units, self.unit_bias, self.last, self.last_bias]


def cut_chunks(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping chunks that cover all bytes, the last one ending with the text; short texts are filled up with zeros.

    Returns the chunks and how many filter places of each lie on the text.
    """
    n = len(body)
    if n <= CHUNK:
        chunk = np.zeros((1, CHUNK), np.uint8)
        chunk[0, :n] = body
        return chunk, np.array([max(1, -((WIDTH - n) // STRIDE) + 1)])  # rounded up: the last filter place may look at fill
    starts = np.append(np.arange(0, n - CHUNK, STEP), n - CHUNK)
    return np.lib.stride_tricks.sliding_window_view(body, CHUNK)[starts], np.full(len(starts), PLACES)


def _windows(chunks: np.ndarray) -> np.ndarray:
    codes = CODES[chunks].reshape(len(chunks), CHUNK * CODE)
    views = np.lib.stride_tricks.sliding_window_view(codes, WIDTH * CODE, axis=1)[:, ::STRIDE * CODE]
    return views.reshape(len(chunks) * PLACES, WIDTH * CODE)


def _chunk_units(net: Net, chunks: np.ndarray, places: np.ndarray, keep: dict | None = None) -> np.ndarray:
    seen = _windows(chunks)
    active = np.maximum(seen @ net.filters + net.filter_bias, 0).reshape(len(chunks), PLACES, FILTERS)
    if (places < PLACES).any():
        active = active * (np.arange(PLACES)[None, :] < places[:, None])[:, :, None]
    n = places[:, None].astype(np.float32)
    mean, square = active.sum(axis=1) / n, np.sqrt((active ** 2).sum(axis=1) / n + 1e-6)
    pooled = np.concatenate([mean, square], axis=1)
    raw = pooled @ net.units + net.unit_bias
    if keep is not None:
        keep.update(seen=seen, active=active, n=n, square=square, pooled=pooled, raw=raw)
    return np.maximum(raw, 0)


def score_texts(net: Net, bodies: list[np.ndarray], at_once: int = AT_ONCE) -> np.ndarray:
    """The probability of label 1 for each text; any text is read whole, ``at_once`` chunks at a time."""
    best = np.zeros((len(bodies), UNITS), np.float32)
    waiting, owner, places = [], [], []

    def flush() -> None:
        if waiting:
            units = _chunk_units(net, np.concatenate(waiting), np.concatenate(places))
            np.maximum.at(best, np.concatenate(owner), units)
            waiting.clear(), owner.clear(), places.clear()

    held = 0
    for k, body in enumerate(bodies):
        chunks, n = cut_chunks(body)
        for i in range(0, len(chunks), at_once):
            waiting.append(chunks[i:i + at_once])
            places.append(n[i:i + at_once])
            owner.append(np.full(len(waiting[-1]), k))
            held += len(waiting[-1])
            if held >= at_once:
                flush()
                held = 0
    flush()
    return 1 / (1 + np.exp(-(best @ net.last + net.last_bias[0]).astype(np.float64)))


def train(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 10, seed: int = 7, rate: float = 0.004) -> Net:
    """Fit by Adam on the logistic loss; both labels weigh the same. ``samples``: chunks and places of each row.

    A step sees all chunks of its rows: a row's gradient comes from the chunks that hold a unit's maximum,
    and only these, one a unit at most, are kept.
    """
    net, r = Net.fresh(seed), np.random.default_rng(seed)
    first, second = ([np.zeros_like(v) for v in net.values()] for _ in range(2))
    weight = np.where(labels == 1, 0.5 / max((labels == 1).mean(), 1e-9), 0.5 / max((labels == 0).mean(), 1e-9))
    step = 0
    for _ in range(epochs):
        order = r.permutation(len(samples))
        for i in range(0, len(order), 32):
            rows = order[i:i + 32]
            parts = []
            for k in rows:
                chunks, places = samples[k]
                some = _winning(net, chunks, places)
                parts.append((chunks[some], places[some]))
            owner = np.repeat(np.arange(len(rows)), [len(p[0]) for p in parts])
            grads = _gradients(net, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), owner, labels[rows], weight[rows])
            step += 1
            for v, g, m, s in zip(net.values(), grads, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return net


def _winning(net: Net, chunks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The chunks that hold the maximum of a unit."""
    if len(chunks) <= 4:
        return np.arange(len(chunks))
    units = [_chunk_units(net, chunks[i:i + AT_ONCE], places[i:i + AT_ONCE]) for i in range(0, len(chunks), AT_ONCE)]
    return np.unique(np.concatenate(units).argmax(axis=0))


def _gradients(net: Net, chunks, places, owner, labels, weight) -> list[np.ndarray]:
    keep: dict = {}
    units = _chunk_units(net, chunks, places, keep)
    n = len(labels)
    best = np.zeros((n, UNITS), units.dtype)
    np.maximum.at(best, owner, units)
    p = 1 / (1 + np.exp(-np.clip(best @ net.last + net.last_bias[0], -60, 60)))
    d = ((p - labels) * weight / n).astype(np.float32)
    won = (units == best[owner]) & (units > 0)  # where a maximum comes from
    d_raw = won * (d[:, None] * net.last)[owner]
    d_pooled = d_raw @ net.units.T
    d_mean, d_square = d_pooled[:, :FILTERS] / keep["n"], d_pooled[:, FILTERS:] / (keep["n"] * keep["square"])
    active = keep["active"]
    d_active = (d_mean[:, None, :] + d_square[:, None, :] * active) * (active > 0)
    flat = d_active.reshape(-1, FILTERS)
    return [keep["seen"].T @ flat, flat.sum(axis=0), keep["pooled"].T @ d_raw, d_raw.sum(axis=0), best.T @ d, d.sum(keepdims=True)]


def fit_quality_net(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Net | None:
    """Learn from the whole texts of at most ``most_rows`` labelled rows that are not held out.

    Without rows of both labels there is no model (None).
    """
    ship(docs.sparkSession)

    def bodies_of(batches):
        for batch in batches:
            body, borders = text_buffer(batch.column(1))
            data = []
            for a, b in zip(borders[:-1], borders[1:]):
                data.append(body[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(data, pa.binary())], ["doc_id", "quality", "body"])

    rows = learning_rows(docs, labels, most_rows).mapInArrow(bodies_of, "doc_id long, quality int, body binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["body"]))
    quality = np.array([r["quality"] for r in rows])
    if len(set(quality.tolist())) < 2:
        return None
    return train([cut_chunks(np.frombuffer(r["body"], np.uint8)) for r in rows], quality)


def score_quality(docs: DataFrame, net: Net | None) -> DataFrame:
    """Add score, the probability that ``quality`` is 1, to ``docs`` (text and others; a column score is replaced).

    Every byte of a text is seen, in overlapping chunks; nothing but the text counts. Null and
    empty texts are scored as a chunk of nothing. Without a model every score is 0.5. Rows are
    scored one by one, so repeated rows have equal scores. Nothing is shuffled.
    """
    if net is None:
        return docs.withColumn("score", F.lit(0.5))
    ship(docs.sparkSession)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        body, borders = text_buffer(texts)
        return pa.array(score_texts(net, [body[a:b] for a, b in zip(borders[:-1], borders[1:])]), pa.float64())

    return docs.withColumn("score", score("text"))
