"""Token ids of whole texts with a public tokenizer, through a cache of the pieces that texts are made of.

A byte-level BPE splits a text by a pattern before it merges, so a text may be cut wherever that
pattern surely begins a new token; equal pieces then have equal ids. The cuts are found with numpy
on the UTF-8 bytes of many texts at once, and only pieces that a worker has not met yet go through
the tokenizer. The cuts hold for byte-level files with the usual pattern and no normaliser; texts for
any other file are not cut.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from typing import Any

import numpy as np

from .common import keep, span_hashes

_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[c for c in range(128) if chr(c).isalpha()]] = True
#: First bytes of characters that are surely no white space: visible ASCII, and two-byte characters from U+00C0.
_RIGHT = np.zeros(256, bool)
_RIGHT[0x21:0x7F] = _RIGHT[0xC3:0xE0] = True
_SLOTS = 1 << 22
#: Pieces that go through the tokenizer at once.
_AT_ONCE = 4096


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether the tokenizer's pattern surely begins a token at each byte."""
    n = len(data)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    right = _RIGHT[data]
    left = right & (data < 0x80)  # as a character's last byte
    left[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
    alone = np.zeros(n, bool)  # one space or line feed between two visible characters
    alone[1:-1] = left[:-2] & right[2:]
    feed = alone & (data == 0x0A)
    out |= alone & (data == 0x20)
    out |= feed
    out[1:] |= feed[:-1]
    letter, punct = _LETTER[data], _PUNCT[data]
    out[1:] |= (letter[:-1] & punct[1:]) | (punct[:-1] & letter[1:])
    return out


def cuts_of(path: str) -> Callable[[np.ndarray], np.ndarray]:
    """``cuts`` if the file's pattern is the one that they are made for, else no cuts."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    before = made.get("pre_tokenizer") or {}
    usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if usual and not made.get("normalizer") and (made.get("model") or {}).get("type") == "BPE":
        return cuts
    return lambda data: np.zeros(len(data), bool)


def open_tokenizer(path: str) -> Any:
    """The tokenizer of a file; strings of special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


class CachedTokenizer:
    """One per worker process; the cache is emptied when it holds ``most`` pieces or ``4 * most`` ids."""

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        self.tokenizer, self.cuts = open_tokenizer(path), cuts_of(path)
        self.most = most
        self._clear()

    @staticmethod
    def of(path: str) -> CachedTokenizer:
        return keep(("tokenizer", path), lambda: CachedTokenizer(path))

    def _clear(self) -> None:
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.entry = np.zeros(_SLOTS, np.int32)
        self.at = np.zeros(1 << 12, np.int32)
        self.size = np.zeros(1 << 12, np.int32)
        self.pool = np.zeros(1 << 14, np.int32)
        self.entries = self.filled = 0

    def _room(self, name: str, needed: int) -> None:
        old = getattr(self, name)
        if needed > len(old):
            new = np.zeros(max(needed, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def _add(self, texts: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total, n = int(sizes.sum()), len(ids)
        self._room("at", self.entries + n)
        self._room("size", self.entries + n)
        self._room("pool", self.filled + total)
        self.at[self.entries : self.entries + n] = self.filled + np.cumsum(sizes) - sizes
        self.size[self.entries : self.entries + n] = sizes
        self.pool[self.filled : self.filled + total] = [i for x in ids for i in x]
        self.entries += n
        self.filled += total

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's offsets in them."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        begin = self.cuts(data)
        begin[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begin)
        ends = np.r_[starts[1:], len(data)]
        keys = span_hashes(data, starts, ends)
        if self.entries > self.most or self.filled > 4 * self.most:
            self._clear()
        slot = (keys & np.uint64(_SLOTS - 1)).astype(np.int64)
        entry = self.entry[slot]
        missed = np.flatnonzero(self.keys[slot] != keys)
        if len(missed):
            new, first, inverse = np.unique(keys[missed], return_index=True, return_inverse=True)
            where = missed[first]
            raw = data.tobytes()
            base = self.entries
            for k in range(0, len(where), _AT_ONCE):
                some = where[k : k + _AT_ONCE]
                self._add([raw[s:e].decode() for s, e in zip(starts[some].tolist(), ends[some].tolist())])
            entry[missed] = base + inverse
            self.keys[slot[where]] = new
            self.entry[slot[where]] = base + np.arange(len(new), dtype=np.int32)
        sizes = self.size[entry]
        done = np.r_[0, np.cumsum(sizes)]
        ids = self.pool[np.repeat(self.at[entry] - done[:-1], sizes) + np.arange(done[-1])]
        return ids, done[np.searchsorted(starts, offsets)]
