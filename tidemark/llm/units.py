"""Byte-level BPE of texts from remembered units, found by numpy passes over the bytes of many texts.

A unit is a word with the one space or line end before it, or a single mark between a letter and white space. The
pre-tokenizer always begins a piece at white space that follows other text, at such a mark and behind it, so a text in
which no two white space characters meet may be cut there, and equal units have equal ids everywhere. Texts with
neighbouring or leading white space or special tokens are left to the caller's own way for whole texts. Units are known by two
64-bit hashes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from tidemark.llm.common import offsets_and_bytes
from tidemark.llm.words import mix

#: Units that a worker remembers before it starts afresh: up to 64 bytes each beside their ids. One long text may need more.
MEMORY = 1_900_000
#: Ids of remembered units before a worker starts afresh, 4 bytes each: long units are as few as their ids allow.
POOL = 12 << 20
_meet = re.compile(r"\s\s").search
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_CUT = np.zeros(256, bool)
_CUT[[10, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[[*b",.;:!?"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xC6] = True  # letters U+00C0 to U+017F, but for two
_VALUE = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8, person=b"unit byte").digest() for b in range(256)), np.uint64) | np.uint64(1)
_STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_powers = [np.cumprod(np.full(512, s, np.uint64)) for s in _STEPS]


def _power(which: int, position: np.ndarray, top: int) -> np.ndarray:
    if top > len(_powers[which]):
        _powers[which] = np.cumprod(np.full(1 << (top - 1).bit_length(), _STEPS[which], np.uint64))
    return _powers[which][position]


class Units:
    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], whole: Callable[[str], np.ndarray], specials: list[str]):
        """learn: ids of strings of one unit each, side by side, and how many each has; whole: ids of any text."""
        self.learn, self.whole, self.specials = learn, whole, specials
        self._clear()

    def _clear(self) -> None:
        self.size, self.used = 0, 0
        self.pool = np.zeros(1 << 16, np.uint32)
        self._slots(1 << 16)

    def _slots(self, n: int) -> None:
        """An empty table of n places, a power of two."""
        self.slots = n
        self.keys, self.check = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.start, self.length = np.zeros(n, np.int64), np.zeros(n, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 if unknown."""
        out = np.full(len(h), -1, np.int64)
        left, slot = np.arange(len(h)), (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            there = self.keys[slot]
            hit = there == h[left]
            out[left[hit]] = slot[hit]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def _put(self, h: np.ndarray, check: np.ndarray, flat: np.ndarray, length: np.ndarray) -> None:
        """Remember distinct unknown units; slots found before are void."""
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        start = self.used + np.cumsum(length) - length
        self.used += len(flat)
        self.size += len(h)
        if 2 * self.size > self.slots:
            there = np.flatnonzero(self.keys)
            old = [x[there] for x in (self.keys, self.check, self.start, self.length)]
            self._slots(1 << (2 * self.size).bit_length())
            self._insert(*old)
        self._insert(h, check, start, length)

    def _insert(self, h: np.ndarray, check: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        mask = self.slots - 1
        left, slot = np.arange(len(h)), (h & np.uint64(mask)).astype(np.int64)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[left[free]]  # of several for one slot the last stays
            mine = free & (self.keys[slot] == h[left])
            at, who = slot[mine], left[mine]
            self.check[at], self.start[at], self.length[at] = check[who], start[who], length[who]
            left, slot = left[~mine], (slot[~mine] + 1) & mask

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        if self.size > MEMORY or self.used > POOL:
            self._clear()
        off, data = offsets_and_bytes(col)
        docs = [t or "" for t in col.to_pylist()]
        other = np.array([t[:1].isspace() or "  " in t or "\n\n" in t or any(s in t for s in self.specials) or _meet(t) is not None for t in docs], bool)
        lengths = np.zeros(len(docs), np.int64)
        if not len(data):
            return np.zeros(0, np.uint32), lengths
        n = len(data)
        begins = _CUT[data]
        begins[off[:-1][off[:-1] < n]] = True
        last = np.zeros(n, bool)
        last[off[1:][off[1:] > 0] - 1] = True
        # a mark behind a letter and before white space or the end
        end = last.copy()
        end[:-1] |= _BLANK[data[1:]]
        letter = np.zeros(n, bool)
        letter[1:] = _ALNUM[data[:-1]]
        letter[2:] |= _LEAD[data[:-2]] & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7) & (data[1:-1] >= 0x80)
        begins |= _MARK[data] & end & letter & ~begins
        first = np.flatnonzero(begins)
        spans = np.diff(np.append(first, n))
        heads = np.searchsorted(first, off[:-1][np.diff(off) > 0])
        lead = np.zeros(len(first), np.int64)
        lead[heads] = 1  # the first unit of a text is taken as if a line end stood before it
        position = np.arange(n) - np.repeat(first - lead, spans)
        top = int(spans.max()) + 2
        value = _VALUE[data]
        line = lead.astype(np.uint64) * _VALUE[10]
        h = mix(np.add.reduceat(value * _power(0, position, top), first) + line * _powers[0][0]) | np.uint64(1)
        check = mix(np.add.reduceat(value * _power(1, position, top), first) + line * _powers[1][0])
        owner = np.searchsorted(off, first, side="right") - 1
        plain = ~other[owner]
        h, check, owner, first, spans, lead = (x[plain] for x in (h, check, owner, first, spans, lead))
        slot = self._find(h)
        unknown = np.flatnonzero(slot < 0)
        if len(unknown):
            new, at = np.unique(h[unknown], return_index=True)
            at = unknown[at]
            raw = data.tobytes()
            units = [("\n" if x else "") + raw[a : a + z].decode("utf-8") for a, z, x in zip(first[at].tolist(), spans[at].tolist(), lead[at].tolist(), strict=True)]
            slots = self.slots
            self._put(new, check[at], *self.learn(units))
            if self.slots == slots:
                slot[unknown] = self._find(h[unknown])
            else:
                slot = self._find(h)
        odd = np.unique(owner[self.check[slot] != check])  # two units of one hash
        start, length = self.start[slot] + lead, self.length[slot] - lead
        if len(odd):
            other[odd] = True
            keep = ~other[owner]
            start, length, owner = start[keep], length[keep], owner[keep]
        lengths += np.bincount(owner, length, len(docs)).astype(np.int64)
        ends = np.cumsum(length)
        ids = self.pool[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        whole = np.flatnonzero(other)
        if not len(whole):
            return ids, lengths
        cuts = np.concatenate(([0], np.cumsum(lengths)))
        parts, at = [], 0
        for i in whole.tolist():
            own = self.whole(docs[i])
            parts += [ids[cuts[at] : cuts[i]], own]
            lengths[i] = len(own)
            at = i + 1
        parts.append(ids[cuts[at] :])
        return np.concatenate(parts), lengths
