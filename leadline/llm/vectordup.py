"""Embedding near-duplicates by randomised-rotation binary codes (operator 9).

Unit vectors are rotated by a seeded random rotation; the signs are the code, and a stored correction factor (the code's
inner product with its own vector) makes <code, other> / factor an unbiased estimate of the cosine, with an error bound
from the factor. The other vector is in four-bit steps with a fixed dither, as bit planes, so that the product is a few
population counts. Pairs whose codes differ in more bits than the threshold's angle allows, or whose bound stays below
it, are left; all others are computed again exactly in double precision.

Pairs come from `tables` hash tables of `bits` sign bits each, both derived from the number of vectors so that a pair at
the threshold meets in some table with probability `recall`. Only codes (some hundred bytes) travel to the tables: full
vectors are fetched for those alone that have a possible partner. A bucket of more than `tile` vectors is split into tiles,
and every two tiles are one task group: nothing grows with a hot bucket but the number of groups. A pair counts in the
first table in which it meets. Groups return link counts and a spanning forest of their links, never the pairs; equal
vectors are one vector with a weight. With recall = 1 there is one bucket and no bound: every two tiles are multiplied
exactly, which takes the square of the number of vectors.

Defined results: null, empty and zero vectors, and vectors with null or non-finite components, link with nothing; vectors
of different dimensions don't link; rows that repeat an id must be equal rows and count as copies of one another; a row
with a null id counts for none; an empty table gives an empty result; columns beside key and vector are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadline.llm.common import components, forest, materialize, tidied

#: Standard deviations of an estimate's error that the bounds allow for.
SPREAD = 4.0
#: Vectors that a bucket should hold: comparing codes is cheap, tables are dear.
FILLED = 2048
#: Bit planes of a vector in steps.
PLANES = 4


def rotation(dim: int, seed: int = 0) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([dim, seed]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def plan(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """Bits of a table and number of tables for n vectors; recall 1: one table without bits."""
    if recall >= 1:
        return 0, 1
    agree = 1 - math.acos(cosine) / math.pi
    bits = max(2, min(30, math.ceil(math.log2(max(n, 2) / FILLED))))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits)))


def keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of each unit vector in each table: signs of its products with seeded random directions."""
    p = np.random.default_rng([x.shape[1], bits, tables]).normal(size=(x.shape[1], bits * tables))
    return ((x @ p > 0).reshape(len(x), tables, bits) << np.arange(bits)).sum(2).astype(np.int32)


def words_of(bits: np.ndarray) -> np.ndarray:
    """Bits of the last axis, packed into 64-bit words."""
    some = np.packbits(bits, axis=-1)
    return np.concatenate([some, np.zeros((*some.shape[:-1], -some.shape[-1] % 8), np.uint8)], axis=-1).view(np.uint64)


class Codes:
    """Codes and correction factors of unit vectors, and the vectors in steps, as rows of bytes and back."""

    def __init__(self, code: np.ndarray, factor: np.ndarray, planes: np.ndarray, low: np.ndarray, step: np.ndarray, dim: int):
        self.code, self.factor, self.planes, self.low, self.step, self.dim = code, factor, planes, low, step, dim

    @classmethod
    def of(cls, x: np.ndarray) -> Codes:
        n, d = x.shape
        y = x @ rotation(d)
        low = y.min(1)
        step = np.maximum((y.max(1) - low) / (2**PLANES - 1), 1e-12)
        dither = np.random.default_rng([d, 1]).random(d)
        q = np.clip(np.floor((y - low[:, None]) / step[:, None] + dither), 0, 2**PLANES - 1).astype(np.uint8)
        planes = words_of(((q[:, None, :] >> np.arange(PLANES, dtype=np.uint8)[:, None]) & 1).astype(bool))
        return cls(words_of(y >= 0), np.abs(y).sum(1) / math.sqrt(d), planes, low, step, d)

    def rows(self) -> list[bytes]:
        numbers = np.stack([self.factor, self.low, self.step], 1).astype("<f4").view(np.uint8)
        n = len(self.code)
        return [r.tobytes() for r in np.concatenate([self.code.view(np.uint8), self.planes.reshape(n, -1).view(np.uint8), numbers], 1)]

    @classmethod
    def read(cls, rows: list[bytes], dim: int) -> Codes:
        w = -(-dim // 64)
        x = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), 8 * w * (1 + PLANES) + 12)
        part = lambda a, z, kind: np.ascontiguousarray(x[:, a:z]).view(kind)
        numbers = part(8 * w * (1 + PLANES), x.shape[1], "<f4").astype(float)
        return cls(part(0, 8 * w, np.uint64), numbers[:, 0], part(8 * w, 8 * w * (1 + PLANES), np.uint64).reshape(-1, PLANES, w), numbers[:, 1], numbers[:, 2], dim)

    def estimates(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unbiased estimates of the cosines of pairs (i, j), from i's codes and factors, and standard deviations of their errors."""
        d, f = self.dim, self.factor[i]
        weigh = 1 << np.arange(PLANES)
        inside = np.bitwise_count(self.code[i, None] & self.planes[j]).sum(2, dtype=np.int64) @ weigh
        every = np.bitwise_count(self.planes[j]).sum(2, dtype=np.int64) @ weigh
        signs = 2 * np.bitwise_count(self.code[i]).sum(1, dtype=np.int64) - d
        guess = ((2 * inside - every) * self.step[j] + self.low[j] * signs) / (math.sqrt(d) * f)
        error = np.sqrt(np.maximum(0, 1 - f**2) / max(1, d - 1) + self.step[j] ** 2 / 6) / f
        return guess, error

    def possible(self, left: np.ndarray, right: np.ndarray, cosine: float, step: int = 1 << 22):
        """Pairs of left and right rows whose codes allow a cosine of `cosine` or more, a bounded number at a time."""
        d, p = self.dim, math.acos(cosine) / math.pi
        most = d * p + SPREAD * math.sqrt(d * p * (1 - p)) + 1
        chunk = max(1, step // max(1, len(right)))
        other = self.code[right]
        for k in range(0, len(left), chunk):
            part = self.code[left[k : k + chunk]]
            differ = np.bitwise_count(part[:, None, 0] ^ other[None, :, 0]).astype(np.int32)
            for w in range(1, part.shape[1]):
                differ += np.bitwise_count(part[:, None, w] ^ other[None, :, w])
            i, j = np.nonzero(differ <= most)
            i, j = left[k + i], right[j]
            for m in range(0, len(i), 1 << 18):
                guess, error = self.estimates(i[m : m + (1 << 18)], j[m : m + (1 << 18)])
                ok = guess + SPREAD * error + 1e-5 >= cosine
                yield i[m : m + (1 << 18)][ok], j[m : m + (1 << 18)][ok]


def exact(x: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float, step: int = 1 << 21):
    """Pairs of left and right rows of unit vectors with a cosine of `cosine` or more, a bounded number at a time."""
    chunk = max(1, step // max(1, len(right)))
    y = x[right].T
    for k in range(0, len(left), chunk):
        i, j = np.nonzero(x[left[k : k + chunk]] @ y >= cosine - 1e-9)
        i, j = left[k + i], right[j]
        for m in range(0, len(i), 1 << 16):
            a, b = i[m : m + (1 << 16)], j[m : m + (1 << 16)]
            ok = (x[a] * x[b]).sum(1) >= cosine  # in one order, whatever the product's shape
            yield a[ok], b[ok]


def _first(ks: np.ndarray, t: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs that meet in no table before t."""
    return ~(ks[a, :t] == ks[b, :t]).any(1)


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Float64 vectors without negative zeros; None where a vector can't link."""
    out = []
    for v in column:
        x = v.values.cast(pa.float64()).to_numpy(zero_copy_only=False) if v.is_valid and len(v.values) else None
        out.append(x + 0.0 if x is not None and np.isfinite(x).all() and x.any() else None)
    return out


def _groups(batches, width: int):
    """(group, rows) of batches sorted by their first `width` columns, rows as columns of lists."""
    name, held = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if r[:width] != name:
                if held:
                    yield name, list(zip(*held))
                name, held = r[:width], []
            held.append(r[width:])
    if held:
        yield name, list(zip(*held))


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, recall: float = 0.985, tile: int = 8192) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("x"))

    def digested(batches):
        for b in batches:
            d = [None if v is None else hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in _vectors(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d, pa.binary()), b.column(1)], ["id", "h", "x"])

    named = rows.mapInArrow(tidied(digested), "id long, h binary, x array<double>")
    own = materialize(named.select("id", "h"))
    reps = materialize(own.where("h is not null and id is not null").groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("c")))
    bits, tables = plan(reps.count(), cosine, recall)

    def filed(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            x = _vectors(b.column(1))
            dims = np.array([0 if v is None or i is None else len(v) for i, v in zip(ids, x)])
            for d in np.unique(dims[dims > 0]).tolist():
                at = np.flatnonzero(dims == d)
                m = unit(np.stack([x[i] for i in at]))
                ks = keys(m, bits, tables)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), pa.array([hashlib.blake2b(x[i].tobytes(), digest_size=16).digest() for i in at], pa.binary()), pa.array(np.full(len(at), d, np.int32)), pa.array(Codes.of(m).rows(), pa.binary()), pa.array([k.tobytes() for k in ks], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * tables), pa.array(ks.ravel()))],
                    ["id", "h", "d", "code", "ks", "list"],
                )

    coded = rows.mapInArrow(tidied(filed), "id long, h binary, d int, code binary, ks binary, list array<int>")
    first = reps.select("h", F.col("rep").alias("id"), "c")
    one = materialize(coded.join(first, ["h", "id"]).dropDuplicates(["id"]).select(F.col("id").alias("rep"), "c", "d", "code", "ks", "list"))
    each = one.select("rep", "c", "d", "code", "ks", F.posexplode("list").alias("t", "k"))
    sizes = one.select("d", F.posexplode("list").alias("t", "k")).groupBy("t", "k", "d").agg(F.count("*").alias("n")).where("n > 1")
    place = ["t", "k", "d", "i", "j"]
    # each vector goes to every pair of tiles that has its own
    tiled = each.join(sizes.select("t", "k", "d", F.ceil(F.col("n") / tile).alias("tiles")), ["t", "k", "d"])
    tiled = tiled.withColumn("own", F.pmod(F.xxhash64("rep", "t"), F.col("tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    tiled = tiled.select("t", "k", "d", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "c", "ks", "code")
    kind = "t int, k int, d int, i long, j long, own long, rep long, c long, ks binary"

    def estimated(batches):
        for (t, k, d, i, j), (own, rep, c, ks, code) in _groups(batches, 5):
            side, at = np.array(own), np.frombuffer(b"".join(ks), np.int32).reshape(len(own), -1)
            left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
            hit = np.zeros(len(own), bool)
            for a, b in Codes.read(code, d).possible(left, right, cosine):
                new = _first(at, t, a, b) & (a < b if i == j else True)
                hit[a[new]] = hit[b[new]] = True
            some = np.flatnonzero(hit).tolist()
            if some:
                fixed = [pa.array([v] * len(some), x) for v, x in zip((t, k, d, i, j), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*fixed, *(pa.array([x[n] for n in some], y) for x, y in ((own, pa.int64()), (rep, pa.int64()), (c, pa.int64()), (ks, pa.binary())))], [*place, "own", "rep", "c", "ks"])

    together = lambda df: df.repartition(parts, *place).sortWithinPartitions(*place)
    some = tiled.drop("code") if not bits else materialize(together(tiled).mapInArrow(tidied(estimated), kind))

    def solved(batches):
        for (t, _, d, i, j), (own, rep, c, ks, x) in _groups(batches, 5):
            ids, at = np.unique(np.array(rep), return_index=True)
            side, weights = np.array(own)[at], np.array(c)[at]
            ks = np.frombuffer(b"".join(ks), np.int32).reshape(len(own), -1)[at]
            x = unit(np.array([x[n] for n in at.tolist()], float))
            left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
            counts, us, vs, n = np.zeros(len(ids), np.int64), [], [], 0
            for a, b in exact(x, left, right, cosine):
                new = _first(ks, t, a, b) & (a < b if i == j else True)
                a, b = a[new], b[new]
                counts += np.bincount(a, weights=weights[b], minlength=len(ids)).astype(np.int64) + np.bincount(b, weights=weights[a], minlength=len(ids)).astype(np.int64)
                if len(a):
                    us.append(a)
                    vs.append(b)
                    n += len(a)
                if n > 1 << 20:
                    u, v = forest(np.concatenate(us), np.concatenate(vs))
                    us, vs, n = [u], [v], 0
            hit = np.flatnonzero(counts)
            u, v = forest(np.concatenate(us), np.concatenate(vs)) if us else (hit[:0], hit[:0])
            cols = np.concatenate([ids[hit], ids[u]]), np.concatenate([counts[hit], np.zeros(len(u), np.int64)]), np.concatenate([np.full(len(hit), -1), ids[v]])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()) for q in cols], ["u", "n", "v"])

    fetched = some.join(rows.select(F.col("id").alias("rep"), "x"), "rep").select(*place, "own", "rep", "c", "ks", "x")
    found = materialize(together(fetched).mapInArrow(tidied(solved), "u long, n long, v long"))
    counts = found.where("n > 0").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    linked = components(found.where("n = 0").select("u", "v"))
    whole = reps.join(counts, "rep", "left").join(linked, F.col("rep") == F.col("node"), "left")
    whole = whole.select("h", (F.col("c") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = own.join(whole, "h", "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    links = F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0)))
    return out.select(F.col("id").alias(key), links.cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
