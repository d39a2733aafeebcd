"""Locally consistent parses of word sequences by recompression, on flat numpy arrays.

Rounds of two steps name every run of one symbol and every pair (left symbol of the one
half, right symbol of the other half of the alphabet; the halves are drawn per round by a
bit of the symbol). A name is a hash of what it replaces, so equal names mean equal words in
every document without a dictionary that would have to be shared. Next to each symbol
stand the words its making has looked at: wherever these words stand together, in any
document, the same symbol arises at the same place.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.wordhash import U, chain, mix

FAR = np.int64(1) << np.int64(40)


def parse(words: np.ndarray, borders: np.ndarray, rounds: int) -> dict[str, np.ndarray]:
    """Symbols after ``rounds`` rounds over several documents at once.

    ``words``: hashes of all words; ``borders``: where documents begin in them. Returns
    name, doc (index of the document), size (words replaced), lo and hi (first word looked at
    and the one after the last, as positions in ``words``; a look beyond the document counts
    as endless).
    """
    n = len(words)
    doc = np.repeat(np.arange(len(borders) - 1, dtype=np.int32), np.diff(borders))
    name, size = words.copy(), np.ones(n, np.int32)
    lo = np.arange(n, dtype=np.int64)
    hi = lo + 1
    for r in range(rounds):
        if len(name) < 2:
            break
        name, size, lo, hi, doc = _runs(name, size, lo, hi, doc)
        name, size, lo, hi, doc = _pairs(name, size, lo, hi, doc, r)
    return {"name": name, "size": size, "lo": lo, "hi": hi, "doc": doc}


def _looks(lo, hi, doc):
    """What the neighbours have looked at: the left one's start and the right one's end."""
    left, right = np.empty_like(lo), np.empty_like(hi)
    left[0], right[-1] = -FAR, FAR
    inside = doc[1:] == doc[:-1]
    left[1:] = np.where(inside, lo[:-1], -FAR)
    right[:-1] = np.where(inside, hi[1:], FAR)
    return left, right, inside


def _runs(name, size, lo, hi, doc):
    left, right, inside = _looks(lo, hi, doc)
    head = np.ones(len(name), bool)
    head[1:] = ~(inside & (name[1:] == name[:-1]))
    first = np.flatnonzero(head)
    if len(first) == len(name):  # no run: but seeing that took a look at both neighbours
        return name, size, left, right, doc
    count = np.diff(np.append(first, len(name)))
    last = first + count - 1
    named = name[first]
    long = count > 1
    named[long] = chain(named[long], mix(count[long].astype(U)))
    return named, size[first] * count.astype(np.int32), left[first], right[last], doc[first]


def _pairs(name, size, lo, hi, doc, r):
    left, right, inside = _looks(lo, hi, doc)
    half = (mix(name + U(7919 * (r + 1))) >> U(17)) & U(1) == 1
    joins = np.zeros(len(name), bool)
    joins[:-1] = half[:-1] & ~half[1:] & inside
    second = np.zeros(len(name), bool)
    second[1:] = joins[:-1]
    new_lo = np.where(half, lo, np.where(second, lo, left))
    new_hi = np.where(half, np.where(joins, hi, right), hi)
    at = np.flatnonzero(joins)
    merged, wide = name.copy(), size.copy()
    merged[at] = chain(name[at] + U(r + 1), name[at + 1])
    wide[at] += size[at + 1]
    new_hi[at] = new_hi[at + 1]
    keep = ~second
    return merged[keep], wide[keep], new_lo[keep], new_hi[keep], doc[keep]


def anchors(symbols: dict[str, np.ndarray], starts: np.ndarray, window: int) -> np.ndarray:
    """For each window start the symbol that stands for the window, -1 where none does.

    It is the widest symbol that lies in the window with all it has looked at, among several the one
    whose name hashes least, then the leftmost: a choice by the window's words alone, so equal
    windows are stood for by equal names.
    """
    name, size = symbols["name"], symbols["size"]
    n = len(name)
    out = np.full(len(starts), -1, np.int64)
    if not n or not len(starts):
        return out
    lo = np.maximum.accumulate(np.where(symbols["lo"] < 0, -1, symbols["lo"]))
    hi = np.minimum.accumulate(np.where(symbols["hi"] >= FAR, FAR, symbols["hi"])[::-1])[::-1]
    first = np.searchsorted(lo, starts, "left")
    after = np.searchsorted(hi, starts + window, "right")
    full = np.flatnonzero(after > first)
    if not len(full):
        return out
    # one sortable key per symbol: wide before narrow, then bits of the name, then the place
    wide = np.minimum(size, 255).astype(U)
    key = ((U(255) - wide) << U(56)) | ((mix(name) >> U(40)) << U(32)) | np.arange(n, dtype=U)
    a, length = first[full], (after - first)[full]
    best = np.zeros(len(full), U)
    table, step = key, 1
    while step <= int(length.max()):  # minima over 1, 2, 4, ... neighbours; two of them cover a range
        mine = np.flatnonzero((length >= step) & (length < 2 * step))
        if len(mine):
            best[mine] = np.minimum(table[a[mine]], table[a[mine] + length[mine] - step])
        if len(table) <= step:
            break
        table, step = np.minimum(table[:-step], table[step:]), 2 * step
    out[full] = (best & U(0xFFFFFFFF)).astype(np.int64)
    return out
