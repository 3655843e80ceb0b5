"""Words of many texts at once, as 64-bit hashes, by numpy passes over their UTF-8 bytes.

A word is a run of bytes other than white space (0x20, 0x09 to 0x0D) with A-Z lowered. Two words are taken as equal
if their 64-bit hashes are.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: One random odd number for each byte after lowering; white space adds nothing.
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8, person=b"word byte").digest() for b in range(256)), np.uint64)[_LOWER] | np.uint64(1)
_VALUE = np.where(SPACE, np.uint64(0), _VALUE)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: The hash of the token that ends every text; no word is as likely to have it as any other value.
END = 0x5BD1E995A1F3C27D
_powers = np.cumprod(np.full(256, _STEP, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the number of words before it (one more entry than texts)."""
    global _powers
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    at = offsets[:-1][offsets[:-1] < n]
    begins[at] = word[at]  # texts stand side by side
    first = np.flatnonzero(begins)
    before = np.searchsorted(first, offsets)
    if not len(first):
        return np.zeros(0, np.uint64), before
    spans = np.diff(np.append(first, n))
    lead = int(first[0])
    position = np.arange(lead, n) - np.repeat(first, spans)
    top = int(position.max()) + 1
    if top > len(_powers):
        _powers = np.cumprod(np.full(1 << (top - 1).bit_length(), _STEP, np.uint64))
    value = _VALUE[data[lead:]] * _powers[position]
    return mix(np.add.reduceat(value, first - lead)), before


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; the last k - 1 places have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out = mix(out * _STEP + words[i : n + i])
    return out


def sequence_hash(words: np.ndarray) -> int:
    """Hash of a whole short text as one shingle; its length keeps it apart from longer shingles."""
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8, person=b"short text").digest(), "little")


class Lookup:
    """Hash to place in a fixed list of distinct hashes, -1 if absent; numpy arrays only."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = np.asarray(hashes, np.uint64)[self.order]
        bits = max(1, int(len(hashes)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.depth = int(np.diff(self.start).max()) if len(hashes) else 0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -1, np.int64)
        if not self.depth or not len(x):
            return out
        bucket = (x >> self.shift).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        left = np.arange(len(x))
        for _ in range(self.depth):
            left = left[at[left] < end[left]]
            if not len(left):
                break
            hit = self.hashes[at[left]] == x[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
        out[out >= 0] = self.order[out[out >= 0]]
        return out


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of all words of counts (h, n) that occur at least so often that they are `most` at most.

    The limit comes from a histogram of counts in eighths of an octave, a few hundred rows; so no task sorts words
    and no more than `most` of them reach the driver. They are ordered by falling count, then hash.
    """
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = counts.groupBy(level.alias("level")).count().collect()
    total, limit = 0, 1 << 30
    for r in sorted(sizes, key=lambda r: -r["level"]):
        total += r["count"]
        if total > most:
            break
        limit = r["level"]
    got = counts.where(level >= limit).select("h", "n").toArrow()
    h, n = got.column("h").to_numpy(), got.column("n").to_numpy()
    order = np.lexsort((h, -n))
    return h[order].astype(np.int64).view(np.uint64), n[order].astype(np.int64)
