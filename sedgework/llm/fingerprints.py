"""Fingerprints of sets of shingles, made for whole batches at once with numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
EMPTY = np.uint32(0xFFFFFFFF)
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\W_]+")


BLOCK_CHARS = 1 << 21


def blocks(sizes: list[int], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """``(start, end)`` of stretches of rows with about ``most`` characters, so that arrays stay small whatever the batch."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit generator: every input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def char_shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-character windows and the row each belongs to; texts have at least ``size`` characters."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    n = len(codes) - size + 1
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * _M1 + codes[k : k + n]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)[:n]
    ends = np.cumsum(lengths)
    inside = np.ones(n + size, bool)
    for k in range(1, size):
        inside[ends[:-1] - k] = False
    keep = inside[:n]
    return mix(h[keep]), owner[keep]


def words(text: str) -> list[str]:
    """Lower-case words; every CJK character is a word of its own."""
    return _TOKEN.findall(text.lower())


def spans(text: str) -> list[tuple[int, int]]:
    """Where the words stand in a text; lower case may be longer, so case is left as it is."""
    return [m.span() for m in _TOKEN.finditer(text)]


def word_shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`char_shingles` over words; shorter texts have the one shingle of all their words."""
    ids: dict[str, int] = {}
    rows = [[hash_word(w, ids) for w in words(t)] for t in texts]
    hashes, owner = [], []
    for i, row in enumerate(rows):
        codes = np.array(row or [0], np.uint64)
        k = min(size, len(codes))
        n = len(codes) - k + 1
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * _M1 + codes[j : j + n]
        hashes.append(h)
        owner.append(np.full(n, i, np.int64))
    return mix(np.concatenate(hashes)), np.concatenate(owner)


def hash_word(word: str, seen: dict[str, int]) -> int:
    h = seen.get(word)
    if h is None:
        import xxhash

        h = seen[word] = xxhash.xxh3_64_intdigest(word)
    return h


def bin_minima(hashes: np.ndarray, owner: np.ndarray, rows: int, bins: int, functions: int) -> np.ndarray:
    """``rows x (functions * bins)`` minima: each function splits the shingles over ``bins`` and keeps the least of each.

    Repeated shingles change nothing. A bin without shingles takes the next one's
    minimum, turned by the distance, so that sparse rows still differ.
    """
    out = np.empty((rows, functions * bins), np.uint32)
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    for f in range(functions):
        h = mix(hashes + np.uint64((f + 1) * int(_M1) % (1 << 64)))
        cell = owner * bins + (h >> shift).astype(np.int64)
        least = np.full(rows * bins, EMPTY, np.uint32)
        np.minimum.at(least, cell, (h & np.uint64(0x7FFFFFFF)).astype(np.uint32))
        least = least.reshape(rows, bins)
        for r in np.flatnonzero((least == EMPTY).any(axis=1)):
            full = np.flatnonzero(least[r] != EMPTY)
            if len(full):
                gaps = np.flatnonzero(least[r] == EMPTY)
                source = full[np.searchsorted(full, gaps) % len(full)]
                least[r, gaps] = (least[r, source] + ((source - gaps) % bins).astype(np.uint32) * np.uint32(0x9E3779B1)) & np.uint32(0x7FFFFFFF)
        out[:, f * bins : (f + 1) * bins] = least
    return out


def pack_bits(minima: np.ndarray) -> np.ndarray:
    """The lowest bit of each minimum, 64 to a signed integer."""
    bits = (minima & np.uint32(1)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)
