"""Toxicity from the nearest labelled examples by exact TF-IDF cosine (operator 8).

Terms are the whole lower-cased words of letters and digits of a text, and the first `STEM` code points of longer ones
(inflected and compound words share them), as 52-bit hashes. A model is fitted on labelled rows: at most half of
`sample` of either label, least hash of the id first; votes and calibration weigh an example by how many rows of its label
it stands for. Every term of their texts has a weight, tf-idf times association: (1 + ln tf) (1 + ln N / df) over
all N documents, times the square root of the term's mutual information with the label among the examples. No term is left
out: telling words weigh most, whichever label they speak for, and common prose hardly anything. Words that no example
holds have no association and weigh nothing.

Examples are unit vectors in an inverted index whose postings are cut into blocks of examples; each term and block keeps its
greatest weight, so the product of a query with these bounds every cosine in the block, and blocks are read from the
highest bound down until no bound can change the k nearest: the result is the exact k nearest. Their distance-weighted
vote (with a prior towards the examples' rate) is calibrated by a logistic curve fitted on each example's vote without
itself. The evidence of a score is its nearest examples.

Defined results: null and empty texts, and texts without a known term, have no neighbours and the score of the prior;
equally near examples are taken by least id, then label; without labelled rows every score is 0.5 (predicted 1 needs a
score of at least 0.5: a tie of evidence counts as toxic). Rows with a null key or label teach nothing, labels whose key
has no document neither; a key with both labels is two examples; rows of docs that repeat a key are one example (of
different texts that of the least terms), and in document frequencies every row counts, so that a table taken twice gives
the same model. Texts are read whole. An empty table of docs gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.llm.common import ALNUM, by_place, byte_sizes, slices, tidied
from leadline.llm.shingles import BYTES, U, mix, powers, raw

#: Code points of the word beginnings that are terms, where the word goes on.
STEM = 5
#: Bits of a term's hash; the others of 64 number the texts that are sorted at once.
BITS = U(52)
#: Bytes of texts that are read at once: the arrays over them take some fifty times as much.
PART = 1 << 18


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times) of the distinct terms of each text, by row and term."""
    out = [_terms(texts[i : i + 4096], i) for i in range(0, len(texts), 4096)]
    return tuple(np.concatenate(x) for x in zip(*out)) if len(out) != 1 else out[0] if out else (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))


def _terms(texts: pa.Array, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, ends = raw(texts)
    b = np.frombuffer(data.translate(ALNUM), np.uint8)
    inside = b != 32
    edge = np.zeros(len(b) + 1, bool)
    edge[ends] = True
    s = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1])) if len(b) else np.empty(0, np.int64)
    if not len(s):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    e = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
    p, inv = powers(len(b))
    c = np.concatenate([[U(0)], np.cumsum(BYTES[b] * p)])
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(np.searchsorted(s, ends)))
    # a stem ends where its word's code point of that number begins
    points = np.cumsum((b & 0xC0) != 0x80)
    long = np.flatnonzero(points[e - 1] - points[s] >= STEM)
    starts = np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))
    cut, own = starts[points[s[long]] - 1 + STEM], s[long]
    h = np.concatenate([mix((c[e] - c[s]) * inv[s]), mix((c[cut] - c[own]) * inv[own], STEM)])
    both = np.sort((np.concatenate([row, row[long]]) << BITS) | (h >> (U(64) - BITS)))
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    held = both[first]
    return (held >> BITS).astype(np.int64) + at, held & ((U(1) << BITS) - U(1)), np.diff(np.append(first, len(both)))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after the other."""
    at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    at += np.arange(len(at))
    return at


class BlockMaxIndex:
    """Exact k nearest by cosine among sparse unit vectors, reading blocks of examples by falling bound."""

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, vocabulary: int, block: int = 128):
        """Entries of n vectors, by row; their weights are kept in single precision, cosines are summed in double."""
        self.n, self.block, self.blocks = n, block, max(1, -(-n // block))
        # like examples share blocks: tighter bounds
        top, strongest = np.zeros(n), np.zeros(n, np.int64)
        np.maximum.at(top, row, weight)
        at = np.flatnonzero(weight >= top[row])
        strongest[row[at]] = term[at]
        self.ids = np.lexsort((-top, strongest))
        place = np.empty(n, np.int64)
        place[self.ids] = np.arange(n)
        place = place[row]
        order = np.lexsort((place, term))
        self.place, self.weight, term = place[order].astype(np.int32), weight[order].astype(np.float32), term[order]
        owner = self.place // block
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])])) if len(term) else np.empty(0, np.int64)
        self.first = np.append(first, len(term)).astype(np.int32)
        self.owner = owner[first]
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.pieces = np.concatenate([[0], np.cumsum(np.bincount(term[first], minlength=vocabulary))]).astype(np.int32)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, examples) of the k nearest of positive cosine, falling; ties by least example."""
        sizes = self.pieces[term + 1] - self.pieces[term]
        piece, w = ranges(self.pieces[term], sizes), np.repeat(weight, sizes)
        owner = self.owner[piece]
        bound = np.bincount(owner, weights=w * self.most[piece], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        cosines, found = np.empty(0), np.empty(0, np.int64)
        at, step = 0, max(2, self.blocks // 4)
        while at < len(order):
            now = order[at : at + step]
            if len(found) >= k:
                now = now[bound[now] + 1e-12 >= cosines[k - 1]]
                if not len(now):
                    break
            at, step = at + step, self.blocks
            wanted = np.zeros(self.blocks, bool)
            wanted[now] = True
            some = np.flatnonzero(wanted[owner])
            p = piece[some]
            start = self.first[p]
            lengths = self.first[p + 1] - start
            post = ranges(start, lengths)
            part = np.repeat(w[some], lengths)
            part *= self.weight[post]
            s = np.bincount(self.place[post], weights=part, minlength=self.n)
            # all that can be among the k nearest, once rounded
            least = np.partition(s, len(s) - k - 1)[len(s) - k - 1] - 1e-9 if len(s) > 2 * k else 0.0
            hit = np.flatnonzero(s > max(least, 0.0))
            s = np.round(s[hit], 12)
            cosines, found = np.concatenate([cosines, s]), np.concatenate([found, self.ids[hit]])
            if but >= 0:
                cosines, found = cosines[found != but], found[found != but]
            best = np.lexsort((found, -cosines))[:k]
            cosines, found = cosines[best], found[best]
        return cosines, found


class Model:
    """Fitted on examples: ids and labels in order, and the (row, term, times) of their texts.

    `frequency` is the number of documents, of `documents`, that hold each term of the sorted `vocabulary`; `rows` how many
    labelled rows without and with the label there are (those of the examples if None).
    """

    def __init__(self, ids: list[int], labels: np.ndarray, entries: tuple[np.ndarray, np.ndarray, np.ndarray], vocabulary: np.ndarray, frequency: np.ndarray, documents: int, rows: tuple[float, float] | None = None, k: int = 15, prior: float = 1.0):
        self.ids, self.labels, self.vocabulary, self.k, self.prior = np.array(ids, np.int64), labels.astype(float), vocabulary, k, prior
        n = len(ids)
        own = n - self.labels.sum(), self.labels.sum()
        self.learnt = 0 < own[1] < n
        rows = rows or own
        self.stands = np.where(self.labels > 0, rows[1] / max(own[1], 1), rows[0] / max(own[0], 1))
        self.stands /= max(self.stands.mean(), 1e-9) if n else 1.0
        row, term, times = entries
        self.weight = (1 + np.log(documents / np.maximum(frequency, 1))) * np.sqrt(information(np.searchsorted(vocabulary, term), self.labels[row], self.labels, len(vocabulary)))
        self.rate = float((rows[1] + 0.5) / (rows[0] + rows[1] + 1))
        self.curve = (1.0, 0.0)
        row, term, weight = self.vectors(row, term, times, n)
        self.index = BlockMaxIndex(row, term, weight, n, len(vocabulary))
        if self.learnt:
            ends = np.searchsorted(row, np.arange(n + 1))
            votes = np.array([self.vote(term[a:z], weight[a:z], i)[0] for i, (a, z) in enumerate(zip(ends[:-1], ends[1:]))])
            self.curve = _logistic(np.log(votes / (1 - votes)), self.labels, self.stands)

    def vectors(self, row: np.ndarray, term: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place in the vocabulary, weight) of the unit vectors of n texts."""
        if not len(self.vocabulary):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        at = np.minimum(np.searchsorted(self.vocabulary, term), len(self.vocabulary) - 1)
        known = (self.vocabulary[at] == term) & (self.weight[at] > 0)
        row, at = row[known], at[known]
        w = (1 + np.log(times[known])) * self.weight[at]
        return row, at, w / np.sqrt(np.bincount(row, weights=w * w, minlength=n))[row]

    def vote(self, term: np.ndarray, weight: np.ndarray, but: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        cosines, found = self.index.nearest(term, weight, self.k, but)
        near = cosines * self.stands[found]
        v = (near @ self.labels[found] + self.prior * self.rate) / (near.sum() + self.prior)
        return min(max(float(v), 1e-4), 1 - 1e-4), cosines, found

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Of each text its score, the cosines of its nearest examples, and their ids."""
        n = len(texts)
        if not len(self.ids):
            return np.full(n, 0.5), [np.empty(0)] * n, [np.empty(0, np.int64)] * n
        row, term, weight = self.vectors(*terms(texts), n)
        ends = np.searchsorted(row, np.arange(n + 1))
        got = [self.vote(term[a:z], weight[a:z]) for a, z in zip(ends[:-1], ends[1:])]
        v = np.array([g[0] for g in got])
        slope, start = self.curve
        return np.round(1 / (1 + np.exp(-(slope * np.log(v / (1 - v)) + start))), 9), [g[1] for g in got], [self.ids[g[2]] for g in got]


def information(term: np.ndarray, y: np.ndarray, labels: np.ndarray, vocabulary: int) -> np.ndarray:
    """Mutual information (nats) of each term's presence with the label, from the terms of all examples and their labels y."""
    n, n1 = float(max(len(labels), 1)), float(labels.sum())
    a, df = np.bincount(term, weights=y, minlength=vocabulary), np.bincount(term, minlength=vocabulary).astype(float)
    part = lambda seen, x, label: np.where(seen > 0, seen / n * np.log(np.maximum(seen, 1) * n / np.maximum(x * label, 1)), 0.0)
    return np.maximum(part(a, df, n1) + part(df - a, df, n - n1) + part(n1 - a, n - df, n1) + part(n - n1 - df + a, n - df, n - n1), 0.0)


def _logistic(x: np.ndarray, y: np.ndarray, stands: np.ndarray, rounds: int = 25) -> tuple[float, float]:
    """Slope (not negative) and intercept by Newton's method with a small ridge, each value counting `stands` times."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * x + b)))
        d = stands * (p - y)
        g = np.array([(d * x).sum() + 0.1 * (a - 1), d.sum() + 0.1 * b])
        w = stands * p * (1 - p)
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -2, 2)
    return max(float(a), 0.0), float(b)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 3000, k: int = 15, prior: float = 1.0) -> Model:
    """A model from the texts of docs (key, text) and at most `sample` // 2 rows of labels (key, label 0 or 1) of either label.

    The sample is cut from the labels alone, by the least xxhash64 of the key, so that it has few rows more (equal hashes)
    and can be broadcast: no text is shuffled. Only the terms of the sample's texts reach the driver; a second pass over all
    documents counts how many hold each of them, each partition adding up its own before they meet.
    """
    every = labels.select(F.col(f"`{key}`").cast("long").alias("key"), (F.col(f"`{label}`").cast("int") > 0).cast("int").alias("y")).dropna().distinct().withColumn("h", F.xxhash64("key"))
    counts = {r["y"]: r["count"] for r in every.groupBy("y").count().collect()}
    last = {y: every.where(F.col("y") == y).select("h").orderBy("h").limit(max(1, sample // 2)).agg(F.max("h")).head()[0] for y in counts}
    some = every.where(F.expr("false") if not last else F.expr(" or ".join(f"(y = {y} and h <= {h})" for y, h in last.items()))).select("key", "y")
    few = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("t")).join(F.broadcast(some), "key").select("key", "y", "t")

    def counted(batches):
        for b in batches:
            for i, j in slices(byte_sizes(b.column(2)), PART):
                part = b.slice(i, j - i)
                row, h, n = terms(part.column(2))
                ends = np.searchsorted(row, np.arange(len(part) + 1))
                cut = lambda x, kind: pa.array([x[a:z].astype(kind).tobytes() for a, z in zip(ends[:-1], ends[1:])], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), cut(h, "<u8"), cut(n, "<i4")], ["key", "y", "h", "n"])

    rows = few.mapInArrow(tidied(counted), "key long, y int, h binary, n binary").groupBy("key", "y").agg(F.min(F.struct("h", "n")).alias("x")).select("key", "y", "x.h", "x.n").collect()
    rows.sort(key=lambda r: (r["key"], r["y"]))
    join = lambda c, kind: np.concatenate([np.frombuffer(r[c], kind) for r in rows] or [np.empty(0, kind)])
    entries = np.repeat(np.arange(len(rows)), [len(r["h"]) // 8 for r in rows]), join("h", "<u8"), join("n", "<i4").astype(np.int64)
    vocabulary = np.unique(entries[1])

    def held(batches):
        found, n = np.zeros(len(vocabulary), np.int64), 0
        for b in batches:
            n += len(b)
            for i, j in slices(byte_sizes(b.column(0)), PART):
                h = terms(b.column(0).slice(i, j - i))[1]
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                found += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], n))], ["i", "n"])

    documents, frequency = 1, np.ones(len(vocabulary))
    if len(vocabulary):
        sums = docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(tidied(held), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
        at, n = sums.column("i").to_numpy(), sums.column("n").to_numpy()
        documents = int(n[at < 0][0])
        frequency[at[at >= 0]] = n[at >= 0]
    return Model([r["key"] for r in rows], np.array([r["y"] for r in rows], float), entries, vocabulary, frequency, documents, (float(counts.get(0, 0)), float(counts.get(1, 0))), k, prior)


NEAR = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType())])


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity", evidence: str = "toxicity_evidence") -> DataFrame:
    """docs with a score (double) and its evidence (array<struct<doc_id,cosine>>); columns of these names are replaced, others may have any name."""
    return by_place(docs, (out, evidence), lambda rows, names: _score(rows, model, names[docs.columns.index(text)], out, evidence))


def _score(docs: DataFrame, model: Model, text: str, out: str, evidence: str) -> DataFrame:
    kept = [f for f in docs.schema.fields if f.name not in (out, evidence)]
    at, keep = docs.columns.index(text), [docs.columns.index(f.name) for f in kept]
    schema = T.StructType([*kept, T.StructField(out, T.DoubleType()), T.StructField(evidence, T.ArrayType(NEAR))])

    def run(batches):
        for b in batches:
            for i, j in slices(byte_sizes(b.column(at)), PART):
                part = b.slice(i, j - i)
                scores, cosines, ids = model.score(part.column(at))
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                near = pa.StructArray.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(cosines))], ["doc_id", "cosine"])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(scores), pa.ListArray.from_arrays(pa.array(ends), near)], schema.names)

    return docs.mapInArrow(tidied(run), schema)


def held_out(key):
    """Rows whose labels are never learnt from."""
    return F.crc32(key.cast("string")) % 5 == 0
