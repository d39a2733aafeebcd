"""Re-Pair: sequences of ids as a grammar of pairs, in numpy."""

from __future__ import annotations

from itertools import count

import numpy as np

U = np.uint64
BINS = 18  # bits of the pair counts' table
SORTED = 1 << 17  # places in full bins up to which pairs are counted by a sort


def compress(ids: np.ndarray, ends: np.ndarray, first: int, rounds: int | None, most_rules: int | None, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replace frequent pairs of neighbours by new symbols, round by round.

    ``ids``: all ids; ``ends``: position after each document; no pair reaches over such a
    border. New symbols are ``first``, ``first`` + 1, ... A round counts all pairs in a table of bins and
    replaces, from left to right, the pairs of the fullest bins that stand ``least`` times or more,
    ``most_rules`` over all rounds at most; later rounds pair symbols of earlier ones. Where ``rounds`` is None,
    rounds follow until no pair stands ``least`` times. Returns symbols, rules (n x 2; rule k makes
    ``first`` + k) and the position after each document among the symbols.
    """
    symbols, ends = ids.astype(np.uint32), ends.astype(np.int64)
    rules: list[np.ndarray] = []
    known = 0
    for r in count() if rounds is None else range(rounds):
        room = len(symbols) if most_rules is None else (most_rules - known) // (1 if rounds is None else rounds - r)
        if len(symbols) < 2 * least or room < 1:
            break
        over = ends[ends < len(symbols)] - 1
        kinds, at, made = _frequent(symbols, over[over >= 0], room, least)
        if not len(kinds):
            break
        # of neighbours that overlap every second one stays, from the left
        new_run = np.ones(len(at), bool)
        new_run[1:] = np.diff(at) > 1
        start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        stays = (np.arange(len(at)) - start) % 2 == 0
        at, made = at[stays], made[stays]
        symbols[at] = (first + known + made).astype(np.uint32)
        ends = ends - np.searchsorted(at + 2, ends, "right")  # the second of a pair goes: positions after it move up
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols = symbols[stay]
        rules.append(np.stack([kinds >> U(32), kinds & U(0xFFFFFFFF)], axis=1).astype(np.uint32))
        known += len(kinds)
    return symbols, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), ends


def _frequent(symbols: np.ndarray, over: np.ndarray, room: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that stand ``least`` times, the places where they stand and the number of the pair at each.

    A pair that stands so often is in a bin as full. As long as such bins hold many places, one pair stands for each
    bin and the others in it wait for a later round; then, or when none of those is frequent, the pairs in them are sorted.
    """
    x, y = symbols[:-1], symbols[1:]
    place = ((x * np.uint32(0x9E3779B1)) ^ (y * np.uint32(0x85EBCA77))) >> np.uint32(32 - BINS)
    place[over] = 1 << BINS
    counts = np.bincount(place, minlength=(1 << BINS) + 1)
    full = counts >= least
    full[-1] = False
    at = np.flatnonzero(full[place])
    pair = (x[at].astype(U) << U(32)) | y[at]
    if len(at) > SORTED:
        bin_of = place[at]
        standing = np.zeros((1 << BINS) + 1, U)
        standing[bin_of[::-1]] = pair[::-1]
        own = np.flatnonzero(standing[bin_of] == pair)
        times = np.bincount(bin_of[own], minlength=(1 << BINS) + 1)
        keep = np.flatnonzero(times >= least)
        if len(keep):
            keep = np.sort(keep[np.argsort(-times[keep], kind="stable")[:room]])
            number = np.full((1 << BINS) + 1, -1, np.int32)
            number[keep] = np.arange(len(keep))
            made = number[bin_of[own]]
            return standing[keep], at[own[made >= 0]], made[made >= 0]
    kinds, which, times = np.unique(pair, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(times >= least)
    keep = np.sort(keep[np.argsort(-times[keep], kind="stable")[:room]])
    number = np.full(len(kinds), -1, np.int32)
    number[keep] = np.arange(len(keep))
    made = number[which]
    return kinds[keep], at[made >= 0], made[made >= 0]


def _by_depth(rules: np.ndarray, first: int) -> list[np.ndarray]:
    """The rules in groups: those of pairs of ids, those of pairs with one of these, and so on."""
    depth = np.zeros(len(rules) + 1, np.int64)
    parts = np.where(rules >= first, rules.astype(np.int64) - first, len(rules))  # the last place stands for ids
    while True:
        deeper = 1 + depth[parts].max(axis=1) if len(rules) else depth[:0]
        if (deeper == depth[:-1]).all():
            break
        depth[:-1] = deeper
    order = np.argsort(depth[:-1], kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[:-1][order])) + 1) if len(rules) else []


def _sizes(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each rule stands for."""
    size = np.ones(len(rules) + 1, np.int64)
    parts = np.where(rules >= first, rules.astype(np.int64) - first, len(rules))
    for some in _by_depth(rules, first):
        size[some] = size[parts[some]].sum(axis=1)
    return size[:-1]


def expansions(rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rules in one array, and the borders of the rules in it."""
    size = _sizes(rules, first)
    borders = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    flat = np.zeros(int(borders[-1]), np.uint32)
    for some in _by_depth(rules, first):
        at = borders[some]
        for side in (0, 1):
            part = rules[some, side]
            made = part >= first
            flat[at[~made]] = part[~made]
            rule = part[made].astype(np.int64) - first
            n = size[rule]
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            flat[np.repeat(at[made], n) + within] = flat[np.repeat(borders[rule], n) + within]
            width = np.ones(len(part), np.int64)
            width[made] = n
            at = at + width
    return flat, borders


def lengths(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each symbol stands for."""
    out = np.ones(len(symbols), np.int64)
    made = symbols >= first
    out[made] = _sizes(rules, first)[symbols[made].astype(np.int64) - first]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that ``symbols`` stand for."""
    flat, borders = expansions(rules, first)
    made = symbols >= first
    rule = symbols[made].astype(np.int64) - first
    start, size = np.empty(len(symbols), np.int64), np.ones(len(symbols), np.int64)
    start[made], size[made] = borders[rule], borders[rule + 1] - borders[rule]
    plain = symbols[~made]  # ids that stand for themselves are put behind the rules' ids
    start[~made] = len(flat) + np.arange(len(plain))
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    return np.concatenate([flat, plain])[at + np.repeat(start - ends + size, size)]
