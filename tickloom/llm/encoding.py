"""Token ids of whole texts with a public byte-level BPE vocabulary, by units that its own pre-tokenizer never joins.

The pre-tokenizer cuts a text at white space: a word takes one space before it along, and of a longer run of white space the
last character stands alone. Each such unit has the same ids in every text, so a chunk's distinct units are encoded once and
looked up by hash. Texts that hold a control string or white space beyond ASCII are given to the library as they are.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from . import kernels as K

#: A worker's units and their ids take so much at most; with it full, the units start anew.
CACHE_BYTES = 32 << 20
#: The library makes objects for so many units at a time.
LIBRARY_UNITS = 2048
SPECIAL = b"<|endoftext|>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def id_width(path: str) -> int:
    """Bytes that every id of a vocabulary fits in: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) < 1 << 16 else 4


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all units, in order; together they are the whole data."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = K.IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = edge[:n].copy()  # a text's first byte
    after_space = np.zeros(n, bool)
    after_space[1:] = space[:-1] & ~edge[1:n]
    before_solid = np.zeros(n, bool)
    before_solid[:-1] = ~space[1:] & ~edge[1:n]
    begin |= space & ~after_space  # a run of white space
    begin |= space & before_solid  # its last character, before a word
    plain = np.zeros(n, bool)
    plain[1:] = data[:-1] == 32
    begin |= ~space & after_space & ~plain  # a word after other white space than a space
    start = np.flatnonzero(begin)
    return start, np.r_[start[1:], n]


def odd_texts(data: np.ndarray, offsets: np.ndarray, special: bool = True) -> np.ndarray:
    """Texts that must be encoded whole: white space beyond ASCII inside, or the control string."""
    n = len(data)
    hit = []
    if n:
        b1 = np.zeros(n, np.uint8)
        b2 = np.zeros(n, np.uint8)
        b1[:-1], b2[:-2] = data[1:], data[2:]
        lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
        d, x, y = data[lead], b1[lead], b2[lead]
        wide = (
            ((d == 0xC2) & ((x == 0x85) | (x == 0xA0)))
            | ((d == 0xE1) & (x == 0x9A) & (y == 0x80))
            | ((d == 0xE2) & (x == 0x80) & ((y <= 0x8A) | (y == 0xA8) | (y == 0xA9) | (y == 0xAF)))
            | ((d == 0xE2) & (x == 0x81) & (y == 0x9F))
            | ((d == 0xE3) & (x == 0x80) & (y == 0x80))
        )
        hit.append(lead[wide])
        raw, at, found = data.tobytes(), -1, []
        while special and (at := raw.find(SPECIAL, at + 1)) >= 0:
            found.append(at)
        hit.append(np.array(found, np.int64))
    where = np.concatenate(hit) if hit else np.zeros(0, np.int64)
    return np.unique(np.searchsorted(offsets, where, "right") - 1)


_made: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, plain: bool = False) -> "Encoder":
    """One for each vocabulary and Python worker, so that its cache outlives a task. plain: control strings in a text are text."""
    if (path, plain) not in _made:
        _made[path, plain] = Encoder(path, plain)
    return _made[path, plain]


class Units:
    """Hashes of units in order, and each unit's ids. New ones gather beside the others and are merged as they reach half of them."""

    def __init__(self) -> None:
        self.keys, self.lens, self.at = [np.zeros(0, K.U)] * 2, [np.zeros(0, np.int32)] * 2, [np.zeros(0, np.int32)] * 2
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def nbytes(self) -> int:
        return 4 * self.used + sum(16 * len(k) for k in self.keys)

    def _place(self, j: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where keys stand in table j, and which of them do."""
        if not len(self.keys[j]):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        place = np.minimum(np.searchsorted(self.keys[j], keys), len(self.keys[j]) - 1)
        return place, self.keys[j][place] == keys

    def missing(self, keys: np.ndarray) -> np.ndarray:
        return ~(self._place(0, keys)[1] | self._place(1, keys)[1])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, length) in ids of keys that are all there."""
        at, lens = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        for j in (0, 1):
            place, hit = self._place(j, keys)
            at[hit], lens[hit] = self.at[j][place[hit]], self.lens[j][place[hit]]
        return at, lens

    def _insert(self, j: int, keys: np.ndarray, lens: np.ndarray, at: np.ndarray) -> None:
        where = np.searchsorted(self.keys[j], keys)
        self.keys[j], self.lens[j], self.at[j] = (np.insert(old, where, new) for old, new in ((self.keys[j], keys), (self.lens[j], lens), (self.at[j], at)))

    def add(self, keys: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> None:
        """New keys, in order."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(max(len(self.ids) // 2, len(ids)), np.uint32)))
        self.ids[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(lens) - lens
        self.used += len(ids)
        self._insert(1, keys, lens.astype(np.int32), at.astype(np.int32))
        if 2 * len(self.keys[1]) > len(self.keys[0]):
            self._insert(0, self.keys[1], self.lens[1], self.at[1])
            self.keys[1], self.lens[1], self.at[1] = self.keys[1][:0], self.lens[1][:0], self.at[1][:0]


class Encoder:
    def __init__(self, path: str, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.plain = plain
        self.lib.encode_special_tokens = plain
        self.units = Units()

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> None:
        """Adds the units at start to end; keys are sorted and new."""
        ids, lens = [], []
        for i in range(0, len(keys), LIBRARY_UNITS):
            j = slice(i, i + LIBRARY_UNITS)
            got = self._library([raw[a:b].decode("utf-8") for a, b in zip(start[j].tolist(), end[j].tolist(), strict=True)])
            lens += map(len, got)
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32))
        self.units.add(keys, np.array(lens, np.int64), np.concatenate(ids))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk end to end, and where each text's begin (and one more at the end)."""
        odd = odd_texts(data, offsets, not self.plain)
        start, end = units(data, offsets)
        at_unit = np.searchsorted(start, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        use = np.ones(len(start), bool)
        for o in odd:
            use[at_unit[o] : at_unit[o + 1]] = False
        start, end = start[use], end[use]
        distinct, first, back = np.unique(K.span_hash(K.prefix_hash(data), start, end), return_index=True, return_inverse=True)
        if self.units.nbytes() > CACHE_BYTES:
            self.units = Units()
        new = self.units.missing(distinct)
        if new.any():
            self._learn(distinct[new], data.tobytes(), start[first[new]], end[first[new]])
        at, lens = self.units.find(distinct)
        at, lens = at[back], lens[back]
        total = np.r_[0, np.cumsum(lens)]
        out = self.units.ids[np.repeat(at - total[:-1], lens) + np.arange(total[-1])]
        begin = total[np.r_[0, np.cumsum(use)][at_unit]]
        if len(odd):
            raw = data.tobytes()
            whole = {o: np.array(self._library([raw[offsets[o] : offsets[o + 1]].decode("utf-8")])[0], np.uint32) for o in odd.tolist()}
            parts = [whole[i] if i in whole else out[begin[i] : begin[i + 1]] for i in range(len(offsets) - 1)]
            begin = np.r_[0, np.cumsum([len(p) for p in parts])]
            out = np.concatenate(parts)
        return out, begin
