"""Vector codes by product quantisation with delta-maintained Lloyd rounds (operator 11).

A component x becomes the integer floor(scale * x); a vector is cut into `parts` equal consecutive parts, and each part
position has a codebook of `entries` entries. All arithmetic is on integers (products of float64 matrices only where every
sum is below 2**52, hence exact), so that results don't depend on how rows are dealt to tasks.

The vectors' integers and the assignment of the last round stand in one written table. A round reads it once, assigns
every part to its nearest entry, and writes the table anew; beside the rows a task writes what its changed parts add to the
sums of their new entries and take from those of their old ones, added up before it leaves the task. Only these
contributions are shuffled. The running sums are a written table too: last round's sums plus the contributions. The driver
holds the codebooks and their sums, `parts * entries` rows of one part's width, whatever the number of vectors.

Defined results: a vector that is null or empty, holds null or non-finite components, or has another length than the kept
vector of the least id, is dropped; so is every vector whose length `parts` doesn't divide. Rows without id are coded
like others but start no codebook; of rows that repeat an id the least vector may start one, and all are coded. Fewer kept
ids than entries start that many entries. A component counts as at most `bound()` in magnitude (2**27 at 64 components,
which no embedding reaches), so that errors fit into 64 bits. An empty table gives an empty result and empty codebooks.
Columns beside the vector are kept, whatever their names; columns of the output's names are replaced.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.llm.common import Workspace, drop, materialize, skew_join, tidied

#: Rows that a task compares at once.
ROWS = 1 << 14
#: Added up by (part, entry, position); position -1 holds the number of parts.
SUMS = "part int, entry int, position int, total long"


def bound(dim: int) -> int:
    """Components of at most this magnitude have a squared distance below 2**62 over `dim` components."""
    return math.isqrt((1 << 62) // max(1, dim)) // 2


def integers(column: pa.Array, scale: int, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, integers): the usable vectors of a list column, of length `dim` where it is named, by row."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    dim = int(sizes.max(initial=0)) if dim is None else dim
    rows = np.flatnonzero((sizes == dim) & (sizes > 0))
    if not len(rows):
        return rows, np.empty((0, dim), np.int64)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(len(rows), dim)  # null components read as NaN
    good = np.isfinite(x).all(1)
    most = float(bound(dim))
    with np.errstate(over="ignore"):
        return rows[good], np.clip(np.floor(x[good] * scale), -most, most).astype(np.int64)


def assign(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), each vectors x parts, of integer vectors against books[part, entry, position]."""
    parts, entries, width = books.shape
    codes, far = np.empty((len(v), parts), np.uint8 if entries <= 256 else np.int32), np.empty((len(v), parts), np.int64)
    exact = 4 * width * max(1, int(np.abs(v).max(initial=0))) * max(1, int(np.abs(books).max(initial=0))) < 1 << 52
    for p in range(parts):
        x, c = v[:, p * width : (p + 1) * width], books[p]
        if exact:
            d = (c * c).sum(1) - 2 * np.rint(x.astype(float) @ c.T.astype(float)).astype(np.int64)
            codes[:, p] = best = d.argmin(1)  # the first of equals
            far[:, p] = d[np.arange(len(v)), best] + (x * x).sum(1)
        else:
            low = np.full(len(v), np.iinfo(np.int64).max)
            for e in range(entries):
                d = ((x - c[e]) ** 2).sum(1)
                codes[d < low, p] = e
                low = np.minimum(low, d)
            far[:, p] = low
    return codes, far


def contributions(v: np.ndarray, old: np.ndarray | None, new: np.ndarray, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) that parts with another code than before add to their new entries and take from their old ones."""
    parts, entries, width = shape
    counts, sums = np.zeros((parts, entries), np.int64), np.zeros(shape, np.int64)
    for p in range(parts):
        moved = np.arange(len(v)) if old is None else np.flatnonzero(old[:, p] != new[:, p])
        x = v[moved, p * width : (p + 1) * width].astype(float)  # sums over ROWS vectors stay below 2**53: exact
        for codes, sign in ((new, 1),) if old is None else ((new, 1), (old, -1)):
            of = np.arange(entries)[:, None] == codes[moved, p]
            counts[p] += sign * of.sum(1)
            sums[p] += sign * np.rint(of.astype(float) @ x).astype(np.int64)
    return counts, sums


def _summed(counts: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """The contributions of a task that are not zero, as rows of SUMS."""
    both = np.concatenate([counts[:, :, None], sums], axis=2)
    p, e, i = np.nonzero(both)
    columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(i - 1, pa.int32()), pa.array(both[p, e, i])]
    return pa.RecordBatch.from_arrays(columns, ["part", "entry", "position", "total"])


def _first_books(vectors: DataFrame, key: str, vector: str, scale: int, parts: int, entries: int) -> np.ndarray:
    """books[part, entry, position] of the `entries` least ids of usable vectors; their length is that of the least.

    A task sends the vectors of its `entries` least ids, one an id, and no others.
    """
    import pyarrow.compute as pc

    x = F.col(f"`{vector}`").cast("array<double>")
    usable = F.col("id").isNotNull() & (F.size("x") > 0) & (F.size("x") % parts == 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.select(F.col(f"`{key}`").alias("id"), x.alias("x")).where(usable)
    dims = kept.orderBy("id", "x").select(F.size("x")).head()
    if dims is None:
        return np.empty((parts, 0, 0), np.int64)
    kept = kept.where(F.size("x") == dims[0])

    def least(batches):
        held: dict = {}
        for b in batches:
            ids = pc.unique(b.column(0))
            ids = ids.take(pc.array_sort_indices(ids)[:entries])
            for r in b.filter(pc.is_in(b.column(0), ids)).to_pylist():
                held[r["id"]] = min(held.get(r["id"], r["x"]), r["x"])
            held = {i: held[i] for i in sorted(held)[:entries]}
        if held:
            yield pa.RecordBatch.from_pylist([{"id": i, "x": x} for i, x in held.items()], schema=pa.schema([("id", ids.type), ("x", pa.list_(pa.float64()))]))

    rows = kept.mapInArrow(least, kept.schema).groupBy("id").agg(F.min("x").alias("x")).orderBy("id").limit(entries).collect()
    _, v = integers(pa.array([r["x"] for r in rows], pa.list_(pa.float64())), scale)
    return v.reshape(len(v), parts, -1).transpose(1, 0, 2).copy()


def _round(table: DataFrame, books: np.ndarray, path: str) -> DataFrame:
    """One round's table of (v, codes) and, in rows without v, its contributions to the sums."""
    shape, dim = books.shape, books.shape[0] * books.shape[2]
    null = lambda n, kind: pa.nulls(n, kind)
    names = ["v", "codes", "part", "entry", "position", "total"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]

    def run(batches):
        counts, sums = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                v = np.frombuffer(b"".join(part.column(0).to_pylist()), "<i4").reshape(part.num_rows, dim).astype(np.int64)
                held = part.column(1).to_pylist()
                old = None if held[0] is None else np.frombuffer(b"".join(held), np.uint8).reshape(part.num_rows, shape[0])
                new, _ = assign(v, books)
                c, s = contributions(v, old, new, shape)
                counts += c
                sums += s
                codes = pa.array([r.tobytes() for r in new], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), codes, *(null(part.num_rows, k) for k in kinds)], names)
        own = _summed(counts, sums)
        yield pa.RecordBatch.from_arrays([null(own.num_rows, pa.binary()), null(own.num_rows, pa.binary()), *own.columns], names)

    schema = T.StructType.fromDDL(f"v binary, codes binary, {SUMS}")
    table.where("v IS NOT NULL").select("v", "codes").mapInArrow(tidied(run), schema).write.parquet(path)
    return table.sparkSession.read.schema(schema).parquet(path)


def train(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> np.ndarray:
    """The codebooks after `rounds` rounds over all usable vectors: integers by part, entry and position (entries <= 256)."""
    spark = vectors.sparkSession
    books = _first_books(vectors, key, vector, scale, parts, entries)
    if not books.size:
        return books
    dim = parts * books.shape[2]
    folder = f"{Workspace.folder(spark)}/{uuid.uuid4().hex}-lloyd"

    def read(batches):
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                _, v = integers(b.column(0).slice(i, ROWS), scale, dim)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in v.astype("<i4")], pa.binary()), pa.nulls(len(v), pa.binary())], ["v", "codes"])

    table = vectors.select(F.col(f"`{vector}`").cast("array<double>").alias("x")).mapInArrow(tidied(read), "v binary, codes binary")
    held = None
    for k in range(rounds):
        table = _round(table, books, f"{folder}/vectors-{k}")
        added = table.where("part IS NOT NULL").select("part", "entry", "position", "total")
        added = added if held is None else held.union(added)
        added.groupBy("part", "entry", "position").agg(F.sum("total").alias("total")).write.parquet(f"{folder}/sums-{k}")
        held = spark.read.schema(SUMS).parquet(f"{folder}/sums-{k}")
        both = np.zeros((parts, books.shape[1], books.shape[2] + 1), np.int64)
        for r in held.collect():  # parts * entries * (width + 1) rows at most
            both[r["part"], r["entry"], r["position"] + 1] = r["total"]
        counts, sums = both[:, :, 0], both[:, :, 1:]
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
        if k:
            drop(spark, f"{folder}/vectors-{k - 1}")
            drop(spark, f"{folder}/sums-{k - 1}")
    drop(spark, folder)
    return books


def encode(vectors: DataFrame, books: np.ndarray, vector: str = "embedding", scale: int = 4096) -> DataFrame:
    """Usable rows with vec_codes (array<int>, an entry a part) and vec_error (long); columns of these names are replaced."""
    dim, names = books.shape[0] * books.shape[2], [c for c in vectors.columns if c not in ("vec_codes", "vec_error")]
    plain = vectors.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{vector}`").cast("array<double>").alias("x"))
    schema = T.StructType([*plain.schema.fields[:-1], *T.StructType.fromDDL("vec_codes array<int>, vec_error long").fields])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                rows, v = integers(part.column(len(names)), scale, dim) if books.size else (np.empty(0, np.int64), None)
                if not len(rows):
                    continue
                codes, far = assign(v, books)
                kept = part.take(pa.array(rows))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1]), pa.int32()), pa.array(codes.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*kept.columns[: len(names)], listed, pa.array(far.sum(1))], schema.names)

    out = plain.mapInArrow(tidied(run), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "vec_codes", "vec_error")


def decode(codes: np.ndarray, books: np.ndarray, scale: int = 4096) -> np.ndarray:
    """Vectors that codes (rows x parts) stand for: the middle of each entry's step."""
    return (books[np.arange(books.shape[0]), codes].reshape(len(codes), -1) + 0.5) / scale


def books_digest(books: np.ndarray) -> str:
    """sha256 of all entries' components by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def errors_by(coded: DataFrame, label: str, key: str, name: str = "label_error") -> DataFrame:
    """coded and the sum of vec_error over the rows of equal label, nulls together; rows of a frequent label are split by key in the join."""
    keyed = materialize(coded.withColumns({"_none": F.col(f"`{label}`").isNull(), "_label": F.coalesce(F.col(f"`{label}`").cast("string"), F.lit(""))}))
    sums = materialize(keyed.groupBy("_none", "_label").agg(F.sum("vec_error").alias(name), F.count("*").alias("_rows")))
    return skew_join(keyed, sums, ["_none", "_label"], "_rows", [f"`{key}`"]).drop("_none", "_label", "_rows")
