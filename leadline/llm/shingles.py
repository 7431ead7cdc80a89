"""Sets of hashed word shingles, computed over whole Arrow buffers at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from leadline.llm.common import SPACED, byte_sizes, slices

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse, modulo 2**64, for i < n."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 1 << 18)
        for k, b in enumerate((BASE, INVERSE)):
            _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)]))
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer."""
    h = h + U(salt)
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def raw(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of a string array, and where each text begins and ends; null texts are empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (bytes(data.slice(int(ends[0]), int(ends[-1] - ends[0]))) if data is not None else b""), ends - ends[0]


def word_hashes(data: bytes, ends: np.ndarray, kind: bytes = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each text's first word (with the total at the end)."""
    b = np.frombuffer(data.translate(kind), np.uint8)
    if not len(b):
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = b != 32
    edge = np.zeros(len(b) + 1, bool)
    edge[ends] = True
    start = inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1])
    stop = inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])
    p, inv = powers(len(b))
    c = np.concatenate([[U(0)], np.cumsum(BYTES[b] * p)])
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return mix((c[e] - c[s]) * inv[s]), np.searchsorted(s, ends)


def shingle_sets(texts: pa.Array, size: int = 5, kind: bytes = SPACED) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its `size`-word shingles; fewer words are one shingle, none are none."""
    data, ends = raw(texts)
    w, first = word_hashes(data, ends, kind)
    if len(w) >= size:
        h = w[: len(w) - size + 1].copy()
        for k in range(1, size):
            h = h * BASE + w[k : len(w) - size + 1 + k]
        h = mix(h, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(h[a : b - size + 1]))
        elif b > a:
            x = U(0)
            with np.errstate(over="ignore"):
                for v in w[a:b]:
                    x = x * BASE + v
            out.append(mix(np.array([x], np.uint64), b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def batches_of_sets(b: pa.RecordBatch, at: int, size: int, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for i, j in slices(byte_sizes(b.column(at)), most):
        part = b.slice(i, j - i)
        yield part, shingle_sets(part.column(at), size)


def digest(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    if not len(h):
        return 0, 0
    return int(mix(h, 1).sum().astype(np.int64)), int(mix(h, 2).sum().astype(np.int64))
