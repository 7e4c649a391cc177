"""Small numpy helpers over UTF-8 text. A word is a run of bytes other than \\x20 and \\x09-\\x0D."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n or more powers of BASE and of its inverse."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", BASE), ("down", INVERSE)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; other seeds give independent hash families."""
    x = x + np.uint64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def encoded(texts) -> list[bytes]:
    """UTF-8 of each text, A-Z in lower case; null is empty."""
    return [t.encode("utf-8", "surrogatepass").lower() if isinstance(t, str) else b"" for t in texts]


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands."""
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_batches(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, hashes, ptr): words of texts[first:last]; text first+i has hashes[ptr[i]:ptr[i+1]]. Memory is
    bounded by limit bytes or the longest single text."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < limit):
            size += len(texts[last]) + 1
            last += 1
        buf = np.frombuffer(b"\n".join(texts[first:last]) + b"\n", dtype=np.uint8)
        starts, ends = word_spans(buf)
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts[first:last]])
        yield first, last, word_hashes(buf, starts, ends), np.searchsorted(starts, offsets)
        first = last


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; a shorter text is one shingle; no words, none."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        out = out * BASE + words[j : n - k + 1 + j]
    return mix(out, 1)


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """hashes (n, m) uint64 -> m words whose bits are set where over half of the n hashes have them set."""
    n, m = hashes.shape
    if n == 0:
        return np.zeros(m, dtype=np.uint64)
    count = np.zeros(64 * m, dtype=np.int64)
    rows = np.ascontiguousarray(hashes).view(np.uint8).reshape(n, 8 * m)
    for i in range(0, n, 255):  # sums of at most 255 ones fit in a byte
        count += np.add.reduce(np.unpackbits(rows[i : i + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(count * 2 > n, bitorder="little").view(np.uint64)
