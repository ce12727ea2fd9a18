"""Word shingles and MinHash values of many texts at once, with numpy over their bytes."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
BATCH_BYTES = 2**21  # texts hashed together; a longer one is taken by itself

_rng = np.random.default_rng(0x5EED)
_MIX = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_IN_WORD = np.array([chr(b).isalnum() or b >= 0x80 for b in range(128)] + [True] * 128)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, BATCH_BYTES + 2**16)
        found = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            steps = np.full(size, base & (2**64 - 1), dtype=np.uint64)
            steps[0] = 1
            found.append(np.cumprod(steps))
        _powers = (found[0], found[1])
    return _powers


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and byte position of every word, in order.

    A word is a run of letters, digits and non-ASCII characters, in lower case.
    """
    coded = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", dtype=np.uint8)
    power, inverse = _power_tables(len(data) + 1)
    inside = _IN_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.append(0, edges)
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_MIX[data] * power[: len(data)], out=sums[1:])
    hashes = scramble((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    limits = np.cumsum([len(c) + 1 for c in coded])
    return hashes, np.searchsorted(limits, starts, side="right"), starts


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text.

    A text of fewer words has one shingle of all of them; one without words has none.
    """
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= BATCH_BYTES):
            size += len(texts[end] or "")
            end += 1
        out.extend(_some_sets(texts[at:end], words))
        at = end
    return out


def _some_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    hashes, owner, _ = word_hashes(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    factor = np.uint64(0x9E3779B97F4A7C15)
    n = max(0, len(hashes) - words + 1)
    rolled = hashes[:n].copy()
    for k in range(1, words):
        rolled *= factor
        rolled += hashes[k : k + n]
    rolled = scramble(rolled)
    found = []
    for start, end in zip(bounds, bounds[1:]):
        if end - start >= words:
            found.append(np.unique(rolled[start : end - words + 1]))
        elif end > start:
            value = np.array([end - start], dtype=np.uint64)
            for k in range(start, end):
                value = value * factor + hashes[k : k + 1]
            found.append(scramble(value))
        else:
            found.append(np.zeros(0, dtype=np.uint64))
    return found


class MinHash:
    """Signatures of `n` values; two sets agree in one with their Jaccard similarity.

    The low 16 bits of each 32-bit minimum are kept: unlike minima agree by chance once
    in 65,536.
    """

    def __init__(self, n: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, n, dtype=np.uint32)[:, None]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """16-bit values, most shingles at a time that keep the work in cache."""
        folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
        least = np.full(len(self.a), 2**32 - 1, dtype=np.uint32)
        for at in range(0, len(folded), 512):
            np.minimum(least, (self.a * folded[None, at : at + 512] + self.b).min(axis=1), out=least)
        return least.astype(np.uint16)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
