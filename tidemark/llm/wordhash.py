"""Hashes of the words of whole texts, computed on the Arrow buffers of a batch.

A word is a longest run of bytes other than space and 0x09-0x0D (``[^\\x20\\x09-\\x0D]+``; in
UTF-8 these bytes never occur inside another character). A null text has no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE = 1 << 20
NEAR = 64  # places in a word whose values are kept in a table
_SPACES = np.array([0x20, 9, 10, 11, 12, 13])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence from that of its head and its last item; order matters."""
    return mix(left * U(0xD6E8FEB86659FD93) + right + U(0x632BE59BD9B4E019))


def _byte_values(lower: bool, seed: int, blanks: bool) -> np.ndarray:
    values = mix(np.arange(256, dtype=U) + U(seed * 1000 + 1))
    if lower:
        values[65:91] = values[97:123]
    return values


def _placed(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A 64-bit number for each byte value at its place in the word; no sum rule ties places to one another."""
    return mix(values + mix(place.astype(U) + U(0xA0761D6478BD642F)))


_TABLES: dict = {}


def _tables(lower: bool, seed: int, blanks: bool) -> tuple[np.ndarray, np.ndarray]:
    """The byte values, and the numbers of all bytes at the first NEAR places, flat."""
    key = (lower, seed, blanks)
    if key not in _TABLES:
        values = _byte_values(lower, seed, blanks)
        table = _placed(values[None, :], np.arange(NEAR)[:, None])
        if not blanks:
            table[:, _SPACES] = 0
        _TABLES[key] = values, table.ravel()
    return _TABLES[key]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row borders; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    borders = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    first, last = int(borders[0]), int(borders[-1])
    body = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return body, borders - first


def word_starts(body: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Byte positions at which words start."""
    if not len(body):
        return np.zeros(0, np.int64)
    table = np.ones(256, bool)
    table[_SPACES] = False
    inside = table[body]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = borders[:-1][borders[:-1] < len(body)]
    begins[edges] = inside[edges]
    return np.flatnonzero(begins)


def word_hashes(body: np.ndarray, starts: np.ndarray, seeds: tuple[int, ...], lower: bool = False, blanks: bool = False) -> list[np.ndarray]:
    """For each seed a 64-bit hash per word, the same wherever the word stands; ``lower`` folds A-Z.

    Each byte gives a number that hangs on its value and its place in the word (tabulation hashing); a word's are added up.
    With ``blanks`` white space counts as well: all bytes from one start to the next are hashed.
    """
    out = [np.zeros(len(starts), U) for _ in seeds]
    i = 0
    while i < len(starts):  # pieces of whole words keep the temporary arrays small
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + PIECE)))
        lo, hi = int(starts[i]), int(starts[j]) if j < len(starts) else len(body)
        own = (starts[i:j] - lo).astype(np.int32 if hi - lo < 1 << 31 else np.int64)
        some = body[lo:hi]
        place = np.arange(hi - lo, dtype=own.dtype)
        place -= np.repeat(own, np.diff(own, append=own.dtype.type(hi - lo)))
        far = np.flatnonzero(place >= NEAR)
        at = (np.minimum(place, NEAR - 1) << 8 if len(far) else place << 8) | some
        for k, seed in enumerate(seeds):
            values, table = _tables(lower, seed, blanks)
            numbers = table[at]
            if len(far):
                rest = _placed(values[some[far]], place[far])
                if not blanks:
                    rest[np.isin(some[far], _SPACES)] = 0
                numbers[far] = rest
            out[k][i:j] = mix(np.add.reduceat(numbers, own) + U(seed))
        i = j
    return out


def hash_words(body: np.ndarray, starts: np.ndarray, lower: bool = False, seed: int = 0, blanks: bool = False) -> np.ndarray:
    """``word_hashes`` for one seed."""
    return word_hashes(body, starts, (seed,), lower, blanks)[0]


def words_of(column: pa.Array, lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows in one array, and the borders of the rows in it."""
    body, borders = text_buffer(column)
    starts = word_starts(body, borders)
    return hash_words(body, starts, lower, seed), np.searchsorted(starts, borders)


def hash_windows(words: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of each window of words (one after another, all windows of the array)."""
    first = np.arange(max(len(words) - window + 1, 0))
    return hash_spans(words, first, first + window)


def hash_spans(words: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span [first, after) of ``words``, the same wherever the span stands.

    By doubling: the hashes of all 1, 2, 4, ... words in a row are chained for the binary digits of a span's length.
    """
    length = np.asarray(after - first)
    out, at = mix(length.astype(U)), np.array(first, np.int64)
    part, width = words, 1
    while width <= int(length.max(initial=0)):
        has = np.flatnonzero(length & width)
        if len(has) == len(out):
            out = chain(out, part[at])
            at += width
        elif len(has):
            out[has] = chain(out[has], part[at[has]])
            at[has] += width
        part = chain(part[:-width], part[width:])
        width *= 2
    return out
