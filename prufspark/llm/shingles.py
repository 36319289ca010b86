"""Word shingles of many texts at once, as 64-bit hashes in flat arrays.

Texts are lower-cased and split at runs of space, tab, CR and LF; a shingle is ``width``
consecutive pieces. Words are hashed from their bytes by array operations, so the cost per
character is a few nanoseconds and does not depend on the vocabulary.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MAX_WORD = 1 << 12


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    per_byte = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    per_place = rng.integers(1, 2**63, MAX_WORD, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return per_byte, per_place


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser over 64-bit words."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1
    ends = np.cumsum(sizes)
    ws = (buf == 32) | (buf == 10) | (buf == 9) | (buf == 13)
    edge = np.empty(len(buf), dtype=bool)
    edge[:1] = ~ws[:1]
    np.logical_and(~ws[1:], ws[:-1], out=edge[1:])
    starts = np.flatnonzero(edge)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    stops = np.flatnonzero(ws & ~np.append(True, ws[:-1]))
    length = stops - starts
    inner = np.flatnonzero(~ws)
    head = np.cumsum(length) - length
    place = (np.arange(len(inner), dtype=np.int64) - np.repeat(head, length)) & (MAX_WORD - 1)
    per_byte, per_place = _tables()
    h = np.add.reduceat(per_byte[buf[inner]] * per_place[place], head)
    return mix(h + length.astype(np.uint64)), np.searchsorted(ends, starts, side="right")


def shingle_hashes(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every shingle, repeats included, in text order."""
    words, owner = word_hashes(texts)
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h = (h ^ words[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    whole = owner[:n] == owner[width - 1 :]
    return h[whole], owner[:n][whole]
