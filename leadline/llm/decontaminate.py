"""Benchmark decontamination with an FM-index per training shard (operator 6).

A shard is one Arrow batch of documents. Its text is the sequence of word ids, documents parted by a
separator. Not the whole shard is indexed: words that can't be inside an occurrence are left out first by an exact
condition (each adjacent word pair of an occurrence is a pair of some benchmark window), so the index holds the runs that
can match, in most shards a small part.
`FmIndex` has the Burrows-Wheeler transform in a wavelet tree; all windows are searched backwards at
once through its ranks, their rows are located by walking to sampled suffix positions, and the spans of
a document are merged.

A window is `size` consecutive words of an item; an item of fewer words, but not none, is one window.
The benchmark is read in blocks of about `block_bytes` of text (a longer item stands in one block); a block's windows
travel with the tasks of one pass over all documents, and a pass is written before the next one: what is held and sent at
a time does not grow with the benchmark, the number of passes does.

Defined results: null or word-free documents have 0 words, no hit and no span; null or word-free items match nothing; items
equal in words each count; ids of items are read as strings, in whose order they are listed; an item without id marks words
but is not listed; items that repeat an id are listed once; an empty benchmark hits nothing; an empty table of documents
gives an empty result; ids of documents aren't read, and equal texts have equal results; texts are read whole; columns of
the outputs' names are replaced, all others are kept whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadline.llm.common import by_place, byte_sizes, materialize, slices, tidied, words

class FmIndex:
    """Over a sequence of small non-negative ints; 0 parts texts and is never searched."""

    STEP = 16

    def __init__(self, seq: np.ndarray):
        s = np.concatenate([seq.astype(np.int64), [-1]]) + 1  # the least symbol ends the text
        n = len(s)
        rank, width = s.copy(), 1
        order = np.argsort(rank, kind="stable")
        while True:  # doubling: ranks of the first `width` symbols
            nxt = np.zeros(n, np.int64)
            nxt[: n - width] = rank[width:] + 1 if width < n else 0
            key = rank * (rank.max() + 2 + n) + nxt
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
            rank, width = new, width * 2
            if rank[order[-1]] == n - 1 or width >= n:
                break
        self.n = n
        bwt = s[order - 1]
        self.symbols = int(s.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=self.symbols))])
        self.bits = max(1, int(self.symbols - 1).bit_length())
        self.levels, self.zeros, cur = [], [], bwt
        for level in range(self.bits - 1, -1, -1):  # a wavelet matrix: zeros first at every level
            bit = (cur >> level) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(n - bit.sum()))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        kept = order % self.STEP == 0
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.sample, self.sampled = order[kept], kept

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c (already shifted by one) stands before row i."""
        lo = np.zeros_like(i)
        for k in range(self.bits):
            ones, one = self.levels[k], ((c >> (self.bits - 1 - k)) & 1).astype(bool)
            lo = np.where(one, self.zeros[k] + ones[lo], lo - ones[lo])
            i = np.where(one, self.zeros[k] + ones[i], i - ones[i])
        return i - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for k in range(self.bits):
            ones = self.levels[k]
            bit = ones[i + 1] - ones[i]
            c = (c << 1) | bit
            i = np.where(bit == 1, self.zeros[k] + ones[i], i - ones[i])
        return c

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last row (exclusive) of each row of `patterns`."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, k].astype(np.int64) + 1
            known = c < self.symbols
            c = np.where(known, c, 0)
            lo, hi = self.before[c] + self.rank(c, lo), self.before[c] + self.rank(c, hi)
            hi = np.where(known, hi, lo)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by walking back to sampled ones."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled[at[left]]
            d = left[done]
            out[d] = (self.sample[self.kept[at[d]]] + steps[d]) % self.n
            left = left[~done]
            c = self.access(at[left])
            at[left] = self.before[c] + self.rank(c, at[left])
            steps[left] += 1
        return out


@dataclass
class Windows:
    """The distinct windows of a block of benchmark items, by length, and the items of each."""

    vocab: dict[bytes, int]
    pairs: np.ndarray
    least: int
    patterns: list[tuple[np.ndarray, list[list[str | None]]]]


def windows(items: list[tuple[str | None, str | None]], size: int) -> Windows:
    vocab: dict[bytes, int] = {}
    found: dict[int, dict[tuple[int, ...], list[str | None]]] = {}
    pairs = set()
    for item, text in items:
        ids = [vocab.setdefault(w, len(vocab) + 1) for w in words(text)]
        if not ids:
            continue
        n = min(size, len(ids))
        pairs.update(zip(ids, ids[1:]))
        for w in dict.fromkeys(tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)):
            found.setdefault(n, {}).setdefault(w, []).append(item)
    base = len(vocab) + 1
    return Windows(vocab, np.array(sorted(a * base + b for a, b in pairs), np.int64), min(found, default=0), [(np.array(list(g), np.int64), list(g.values())) for g in found.values()])


def _inside(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def hits(ids: np.ndarray, w: Windows) -> list[tuple[int, int, list[str | None]]]:
    """(start, end, items) of every occurrence in a shard's word ids (0: no benchmark word, or a separator)."""
    if not w.least or not len(ids):
        return []
    linked = np.zeros(len(ids) + 1, bool)  # linked[i]: words i-1 and i can stand side by side in a window
    linked[1:-1] = (ids[:-1] > 0) & (ids[1:] > 0) & _inside(w.pairs, ids[:-1] * (len(w.vocab) + 1) + ids[1:])
    starts = np.flatnonzero(~linked[:-1])
    lengths = np.diff(np.append(starts, len(ids)))
    keep = (lengths >= w.least) & (ids[starts] > 0)
    starts, lengths = starts[keep], lengths[keep]
    if not len(starts):
        return []
    at = np.concatenate([np.append(np.arange(s, s + n), -1) for s, n in zip(starts.tolist(), lengths.tolist())])
    text = np.where(at >= 0, ids[at], 0)
    alphabet = np.unique(text)  # dense symbols; the separator stays 0
    alphabet = alphabet[alphabet > 0]
    index = FmIndex(np.where(text > 0, np.searchsorted(alphabet, text) + 1, 0))
    out = []
    for patterns, items in w.patterns:
        local = np.where(_inside(alphabet, patterns.ravel()), np.searchsorted(alphabet, patterns.ravel()) + 1, len(alphabet) + 2).reshape(patterns.shape)
        lo, hi = index.search(local)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        for k, p in zip(which.tolist(), index.locate(rows).tolist()):
            out.append((int(at[p]), int(at[p]) + patterns.shape[1], items[k]))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _shard(texts: list[str | None], w: Windows) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Of each document its words, its merged spans of words, and its items."""
    get = w.vocab.get
    ids, starts, counts = [], [], []
    n = 0
    for t in texts:
        ws = words(t)
        ids.append(np.array([*map(get, ws, [0] * len(ws)), 0], np.int64))
        starts.append(n)
        counts.append(len(ws))
        n += len(ws) + 1
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str | None]] = [set() for _ in texts]
    found = hits(np.concatenate(ids) if ids else np.empty(0, np.int64), w)
    for (a, b, its), d in zip(found, np.searchsorted(starts, [f[0] for f in found], side="right") - 1):
        spans[d].append((a - starts[d], b - starts[d]))
        items[d].update(its)
    return [(c, merged(s), sorted(x for x in i if x is not None)) for c, s, i in zip(counts, spans, items)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 13, shard_bytes: int = 8 << 20, block_bytes: int = 16 << 20) -> DataFrame:
    """docs with n_words, spans (array<struct<start,end>> in words), items (array<string>, sorted) and n_hit; columns of these names are replaced,
    others may have any name."""
    made = ("n_words", "spans", "items", "n_hit")
    return by_place(docs, made, lambda rows, names: _decontaminate(rows, benchmark, names[docs.columns.index(text)], item, item_text, size, shard_bytes, block_bytes))


def _decontaminate(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, size: int, shard_bytes: int, block_bytes: int) -> DataFrame:
    """One pass over the documents for each benchmark block of about `block_bytes` bytes, each merging its spans and items into
    the last one's, which were written: a pass holds and sends one block. Nothing is shuffled.
    """
    sized = benchmark.select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t"))
    total = sized.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).head()[0]
    n = max(1, -(-total // block_bytes))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kept = [c for c in docs.columns if c not in ("n_words", "spans", "items", "n_hit")]
    made = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    schema, at, own = made.schema, kept.index(text), len(kept)
    for k in range(n):
        block = [tuple(r) for r in sized.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]
        w = windows(sorted(block, key=lambda r: (r[0] is None, r[0] or "", r[1] or "")), size)

        def run(batches, w=w):
            for b in batches:
                for i, j in slices(byte_sizes(b.column(at)), shard_bytes, 1 << 16):
                    part = b.slice(i, j - i)
                    got = _shard(part.column(at).to_pylist(), w)
                    if n > 1:
                        held = zip(got, part.column(own + 1).to_pylist(), part.column(own + 2).to_pylist())
                        got = [(g[0], merged(g[1] + [(x["start"], x["end"]) for x in s]), sorted({*g[2], *i})) for g, s, i in held]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(part.column(c) for c in range(own)),
                            pa.array([g[0] for g in got], pa.int64()),
                            pa.array([[{"start": a, "end": z} for a, z in g[1]] for g in got], pa.list_(span)),
                            pa.array([g[2] for g in got], pa.list_(pa.string())),
                        ],
                        schema.names,
                    )

        made = made.mapInArrow(tidied(run), schema)
        if k < n - 1:
            made = materialize(made)
    return made.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]))


def contaminated(n_hit, n_words, per: int = 20):
    """The rule: some word is hit, and at least one in `per` words."""
    return (n_hit > 0) & (per * n_hit >= n_words)

