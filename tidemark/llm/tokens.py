"""Token ids of whole texts with the tokenizers library, one library call per distinct word."""

from __future__ import annotations

import json
import os
from itertools import chain as flat

import numpy as np
import pyarrow as pa

from tidemark.llm.tables import give_back
from tidemark.llm.wordhash import U, text_buffer, word_hashes, word_starts

MOST_WORDS = 1_000_000  # words a worker remembers between calls; beyond, those not met again since the last time go, a call's own never
_ENCODERS: dict[str, "TextEncoder"] = {}


def encoder(path: str) -> "TextEncoder":
    """The encoder for a tokenizer file; a worker keeps it between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


class TextEncoder:
    """ids of texts as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    The library sees each distinct stretch of text once; its ids are kept under 128 bits of hash.
    Stretches are such that a text's ids are those of its stretches one after another: both known kinds
    of tokenizer part a letter from a mark after it, and white space from words. For one that
    ``drops`` white space, stretches are words and the marks behind them. For byte-level BPE, where a word ``leads`` with
    the space before it, one ends before a space and on both sides of a line end that have no other
    white space beside them; longer runs of white space stay inside a stretch. Where special tokens
    stand in a text, marks are not parted. Texts of other tokenizers are one stretch, which is not kept.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.kind = _kind(spec)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        del spec  # the vocabulary is not held twice
        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self._clear(1 << 12)
        give_back()  # what reading the file has left

    def _clear(self, slots: int) -> None:
        self.key = np.zeros((slots, 2), U)
        self.first, self.count = np.zeros(slots, np.int64), np.zeros(slots, np.int32)
        self.met = np.zeros(slots, bool)
        self.known, self.ids, self.used = 0, np.zeros(1 << 14, np.uint32), 0

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one uint32 array, and the borders of the texts in it; null texts have none."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        body, borders = text_buffer(texts)
        if self.kind == "whole":
            data = body.tobytes()
            parts = [self.library.encode(data[a:b].decode(), add_special_tokens=False).ids for a, b in zip(borders[:-1], borders[1:])]
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            return np.fromiter(flat.from_iterable(parts), np.uint32, int(ends[-1])), ends
        starts = word_starts(body, borders) if self.kind == "drops" else _led_starts(body, borders)
        data = body.tobytes()
        if not any(t in data for t in self.special):
            cut = np.zeros(len(body), bool)
            cut[starts], cut[_marks(body)] = True, True
            starts = np.flatnonzero(cut)
        keys = np.stack(word_hashes(body, starts, (2, 3), blanks=self.kind == "leads"), axis=1)
        keys[:, 0] |= U(1)  # 0 is an empty place
        slot = self._find(keys)
        missing = np.flatnonzero(slot < 0)
        if len(missing) and self.known + len(np.unique(keys[missing, 0])) > MOST_WORDS:
            self._forget()
            slot = self._find(keys)  # words of these texts may have been forgotten as well
            missing = np.flatnonzero(slot < 0)
        while len(missing):  # again for words that share the first half of their hash
            _, at = np.unique(keys[missing, 0], return_index=True)
            self._learn(data, np.append(starts, len(body)), missing[at], keys)
            slot = self._find(keys)
            missing = np.flatnonzero(slot < 0)
        assert not (slot < 0).any(), "a stretch has no ids"
        self.met[slot] = True
        lengths = self.count[slot].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(self.first[slot] - ends[:-1], lengths) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(starts, borders)]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        mask = len(self.key) - 1
        slot = (keys[:, 0] >> U(20)).astype(np.int64) & mask
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            here = self.key[slot[todo]]
            same = (here[:, 0] == keys[todo, 0]) & (here[:, 1] == keys[todo, 1])
            out[todo[same]] = slot[todo[same]]
            todo = todo[~same & (here[:, 0] != 0)]
            slot[todo] = (slot[todo] + 1) & mask
        return out

    def _learn(self, data: bytes, starts: np.ndarray, words: np.ndarray, keys: np.ndarray) -> None:
        found: list[list[int]] = []
        for i in range(0, len(words), 4096):
            some = [data[starts[k]:starts[k + 1]].decode() for k in words[i:i + 4096]]
            found += [e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self._insert(keys[words], np.fromiter(flat.from_iterable(found), np.uint32, int(sizes.sum())), sizes)

    def _insert(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while 2 * (self.known + len(keys)) > len(self.key):
            old, first, count, met = self.key, self.first, self.count, self.met
            kept = np.flatnonzero(old[:, 0])
            slots = 2 * len(old)
            self.key, self.first, self.count, self.met = np.zeros((slots, 2), U), np.zeros(slots, np.int64), np.zeros(slots, np.int32), np.zeros(slots, bool)
            to = self._places(old[kept])
            self.first[to], self.count[to], self.met[to] = first[kept], count[kept], met[kept]
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[self.used:self.used + len(ids)] = ids
        to = self._places(keys)
        self.first[to], self.count[to], self.met[to] = self.used + np.cumsum(sizes) - sizes, sizes, False
        self.used += len(ids)
        self.known += len(keys)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Put distinct new keys into empty places and say where."""
        mask = len(self.key) - 1
        slot = (keys[:, 0] >> U(20)).astype(np.int64) & mask
        todo = np.arange(len(keys))
        while len(todo):
            free = self.key[slot[todo], 0] == 0
            _, winner = np.unique(slot[todo[free]], return_index=True)
            won = todo[free][winner]
            self.key[slot[won]] = keys[won]
            placed = np.zeros(len(keys), bool)
            placed[won] = True
            todo = todo[~placed[todo]]
            slot[todo] = (slot[todo] + 1) & mask
        return slot

    def _forget(self) -> None:
        """Keep the words met since the last time, half of the bound at most."""
        kept = np.flatnonzero(self.met)[: MOST_WORDS // 2]
        keys, sizes = self.key[kept], self.count[kept].astype(np.int64)
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.first[kept] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self._clear(1 << 12)
        self._insert(keys, ids, sizes)


def _blank(body: np.ndarray) -> np.ndarray:
    """Which bytes belong to a white space character of Unicode."""
    kind = np.zeros(256, np.uint8)
    kind[[9, 10, 11, 12, 13, 32]], kind[[0xC2, 0xE1, 0xE2, 0xE3]] = 1, 2
    kinds = kind[body]
    out = kinds == 1
    lead = np.flatnonzero(kinds == 2)
    if len(lead):
        one, two = body[np.minimum(lead + 1, len(body) - 1)], body[np.minimum(lead + 2, len(body) - 1)]
        short = (body[lead] == 0xC2) & ((one == 0x85) | (one == 0xA0))
        three = ((body[lead] == 0xE1) & (one == 0x9A) & (two == 0x80)) | ((body[lead] == 0xE3) & (one == 0x80) & (two == 0x80))
        three |= (body[lead] == 0xE2) & (((one == 0x80) & (((two >= 0x80) & (two <= 0x8A)) | np.isin(two, [0xA8, 0xA9, 0xAF]))) | ((one == 0x81) & (two == 0x9F)))
        for k in range(2):
            out[lead[short] + k] = True
        for k in range(3):
            out[lead[three] + k] = True
    return out


def _marks(body: np.ndarray) -> np.ndarray:
    """Positions of ASCII marks right behind an ASCII letter."""
    kind = np.zeros(256, np.uint8)
    kind[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
    kind[[*range(65, 91), *range(97, 123)]] = 2
    kinds = kind[body]
    return np.flatnonzero((kinds[1:] == 1) & (kinds[:-1] == 2)) + 1


def _led_starts(body: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Where stretches start: at each text, before a space and around a line end without white space beside it."""
    n = len(body)
    starts = np.zeros(n + 1, bool)
    if n > 2:
        blank = _blank(body)
        edge = np.zeros(n + 1, bool)
        edge[borders] = True
        cut = (body[1:-1] == 0x20) | (body[1:-1] == 0x0A)
        cut = cut & ~blank[:-2] & ~blank[2:] & ~edge[1:n - 1] & ~edge[2:n]
        starts[1:n - 1] = cut
        starts[2:n] |= cut & (body[1:-1] == 0x0A)
    starts[borders] = True
    return np.flatnonzero(starts[:n])


def _kind(spec: dict) -> str:
    before = spec.get("pre_tokenizer") or {}
    normal = spec.get("normalizer") or {}
    if any(t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in spec.get("added_tokens", [])):
        return "whole"
    if before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not normal:
        return "leads"
    steps = [s.get("type") for s in normal.get("normalizers", [])]
    splits = before.get("pretokenizers", [{}])[0]
    if steps == ["NFC", "Replace", "Lowercase"] and splits.get("type") == "Split" and splits.get("behavior") == "Removed" and splits.get("invert"):
        return "drops"
    return "whole"
