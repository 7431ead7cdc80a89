"""Importance resampling towards a target by hashed n-grams (operator 13).

Features are all runs of 1 to `most` consecutive words, joined by one space; a feature's bucket is the unsigned crc32 of its
UTF-8 bytes modulo `buckets`. A shard of texts becomes one sequence of word ids, texts parted by numbers that stand once. Its
suffix array puts suffixes in the order of their first `most` words (no feature needs more), and the words that neighbours have in
common, up to `most`, cut the array into runs: a run of suffixes with n words in common holds every occurrence of one n-gram. Each run
is hashed once; from there counts take the run's length, and scores scatter its bucket back to the places of its suffixes. The hash of an
n-gram is put together from those of its words, as crc32 is linear: no n-gram is ever spelled out.

Two passes over the documents: one counts buckets (added up within a task, then by bucket: `buckets` sums reach the driver), one
scores. What is drawn are the highest scores of all eligible documents, found by one order over ranges.

Defined results: null and word-free texts have no feature and weight 0; equal texts have equal weights; rows that repeat an id
have equal noise and come in any order among each other; a row without id counts as one whose id is written as nothing, behind
others of its score; a target without words or an empty one counts nothing; an empty table gives an empty result; columns of
the outputs' names are replaced, all others are kept whatever their names; texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.llm.common import by_place, byte_sizes, materialize, slices, tidied, words
from leadline.operators.ordered import numbered

#: Fixed value: the reversed polynomial of crc32.
POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    """What crc32 makes of each byte when it shifts it out."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


_STEP = _byte_table()
_LATER: dict[int, np.ndarray] = {}


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, as a table for each of the four bytes."""
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def later(n: int) -> np.ndarray:
    """What n zero bytes make of a crc32, as a table of four by 256; lengths of long words are put together from halves."""
    if n not in _LATER:
        if n == 0:
            made = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        elif n == 1:
            x = later(0)
            made = (x >> np.uint32(8)) ^ _STEP[x & 255]
        else:
            made = _apply(later(n // 2), later(n - n // 2))
        if n > 64:
            return made
        _LATER[n] = made
    return _LATER[n]


class Words:
    """The words of a shard by id, with what the hashing of their n-grams needs."""

    def __init__(self):
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__

    def read(self, text: str | None) -> list[int]:
        return list(map(self.ids.__getitem__, words(text)))

    def hashes(self) -> None:
        """Of each word its crc32, that of a space and the word, and the kind of its length."""
        self.crc = np.array([zlib.crc32(w) for w in self.ids], np.uint32)
        self.spaced = np.array([zlib.crc32(w, zlib.crc32(b" ")) for w in self.ids], np.uint32)
        sizes, self.kind = np.unique(np.array([len(w) + 1 for w in self.ids], np.int64), return_inverse=True)
        self.tables = [later(int(n)) for n in sizes]

    def append(self, crc: np.ndarray, word: np.ndarray) -> np.ndarray:
        """crc32 of texts with a space and a word behind them."""
        out, kind = self.spaced[word], self.kind[word]
        for k in np.unique(kind).tolist():
            at = np.flatnonzero(kind == k)
            out[at] ^= _apply(self.tables[k], crc[at])
        return out


def suffixes(seq: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): places by their suffixes' first `most` numbers, and how many of these each has in common with the one before.

    Numbers below 0 part texts: such a place is smaller than words and has nothing in common with anything.
    """
    n = len(seq)
    ahead = [np.concatenate([seq[k:], np.full(min(k, n), -1, np.int64)]) for k in range(most)]
    for k in range(1, most):  # behind the end of a text all is end
        ahead[k] = np.where(ahead[k - 1] < 0, -1, ahead[k])
    base = int(seq.max(initial=0)) + 2
    if base**most < 1 << 62:
        key = np.zeros(n, np.int64)
        for a in ahead:
            key = key * base + np.maximum(a, -1) + 1
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort(ahead[::-1])
    common = np.zeros(n, np.int64)
    same = np.ones(max(0, n - 1), bool)
    for a in ahead:
        a = a[order]
        same &= (a[1:] == a[:-1]) & (a[1:] >= 0)
        common[1:] += same
    return order, common


def runs(seq: np.ndarray, vocabulary: Words, buckets: int, most: int):
    """For n = 1..most: (bucket of each run, places of all runs' suffixes, the run of each place)."""
    order, common = suffixes(seq, most)
    for n in range(1, most + 1):
        end = order + n
        whole = np.flatnonzero(end <= len(seq))
        inside = np.ones(len(whole), bool)
        for k in range(n):
            inside &= seq[order[whole] + k] >= 0
        at = whole[inside]  # rows of the array whose first n words lie in one text
        fresh = common[at] < n  # a run's rows are neighbours: none of another n-gram or of a text's end stands between them
        run = np.cumsum(fresh) - 1
        first = order[at[fresh]]
        crc = vocabulary.crc[seq[first]]
        for k in range(1, n):
            crc = vocabulary.append(crc, seq[first + k])
        yield (crc % np.uint32(buckets)).astype(np.int64), order[at], run


def shard(texts: list[str | None], most: int) -> tuple[np.ndarray, np.ndarray, Words]:
    """(word ids with -1 behind each text, words of each text, vocabulary)."""
    vocabulary = Words()
    ids = [vocabulary.read(t) for t in texts]
    sizes = np.array([len(i) for i in ids], np.int64)
    seq = np.full(int(sizes.sum()) + len(ids), -1, np.int64)
    at = np.ones(len(seq), bool)
    at[np.cumsum(sizes + 1) - 1] = False
    seq[at] = np.fromiter((x for i in ids for x in i), np.int64, int(sizes.sum()))
    vocabulary.hashes()
    return seq, sizes, vocabulary


def bucket_counts(texts: list[str | None], buckets: int, most: int) -> np.ndarray:
    seq, _, vocabulary = shard(texts, most)
    out = np.zeros(buckets, np.int64)
    for bucket, _, run in runs(seq, vocabulary, buckets, most):
        np.add.at(out, bucket, np.bincount(run, minlength=len(bucket)))
    return out


def weights(texts: list[str | None], gains: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, features, sum of gains) of each text."""
    seq, sizes, vocabulary = shard(texts, most)
    found = np.zeros(len(seq), np.int64)
    for bucket, place, run in runs(seq, vocabulary, len(gains), most):
        found[place] += gains[bucket][run]  # a place stands once for each n
    total = np.concatenate([[0], np.cumsum(found)])
    ends = np.cumsum(sizes + 1)
    features = sum(np.maximum(0, sizes - n + 1) for n in range(1, most + 1))
    return sizes, features, total[ends] - total[ends - sizes - 1]


def count_features(texts: DataFrame, text: str = "text", buckets: int = 10_000, most: int = 3, shard_bytes: int = 2 << 20) -> np.ndarray:
    """Features by bucket over all texts: added up within a task, summed by bucket."""

    def run(batches):
        out = np.zeros(buckets, np.int64)
        for b in batches:
            for i, j in slices(byte_sizes(b.column(0)), shard_bytes, 1 << 16):
                out += bucket_counts(b.column(0).slice(i, j - i).to_pylist(), buckets, most)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["bucket", "n"])

    counted = texts.select(F.col(f"`{text}`").alias("t")).mapInArrow(tidied(run), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of how much likelier a bucket is in the target), each bucket counted once more than it was."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    ratio = lambda a, b: float((b + 1) * (s + n)) / float((a + 1) * (t + n))
    return np.array([math.floor(1000 * math.log(ratio(a, b))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def noise(key: str, seed: int) -> int:
    """floor(1000 times a Gumbel draw) that the key fixes."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", most: int = 3, seed: int = 42, shard_bytes: int = 2 << 20) -> DataFrame:
    """docs with n_words, n_features, weight and score (long); nothing is shuffled."""
    made = ("n_words", "n_features", "weight", "score")

    def run_on(rows: DataFrame, names: list[str]) -> DataFrame:
        at, of = docs.columns.index(text), docs.columns.index(key)
        schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in made)])

        def run(batches):
            for b in batches:
                for i, j in slices(byte_sizes(b.column(at)), shard_bytes, 1 << 16):
                    part = b.slice(i, j - i)
                    n, features, weight = weights(part.column(at).to_pylist(), gain, most)
                    drawn = np.array([noise("" if k is None else str(k), seed) for k in part.column(of).to_pylist()], np.int64)
                    yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, pa.int64()) for x in (n, features, weight, weight + drawn))], schema.names)

        return rows.mapInArrow(tidied(run), schema)

    return by_place(docs, made, run_on)


def draw(scored: DataFrame, key: str = "doc_id", percent: int = 5, least_words: int = 20) -> DataFrame:
    """scored with rank (long): 1, 2, 3... by falling score among the floor(percent/100) drawn of documents of enough words, others null.

    Ties go to the smaller id. scored should be a written table: it is read twice.
    """
    able = F.coalesce(F.col("n_words"), F.lit(0)) >= least_words
    n = scored.where(able).count() * percent // 100
    placed = numbered(scored.withColumn("_able", able), F.col("_able").desc(), F.col("score").desc(), F.col(f"`{key}`").asc_nulls_last(), name="rank")
    return placed.withColumn("rank", F.when(F.col("_able") & (F.col("rank") <= n), F.col("rank"))).drop("_able")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5, buckets: int = 10_000, most: int = 3, seed: int = 42) -> DataFrame:
    """(key, n_features, weight, score, rank) of every document: which of them to draw so that they look like the target."""
    gain = gains(count_features(docs, text, buckets, most), count_features(target, target_text, buckets, most))
    scored = materialize(score(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), gain, key, text, most, seed).drop(text))
    return draw(scored, key, percent).drop("n_words")
