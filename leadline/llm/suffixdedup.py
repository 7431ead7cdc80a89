"""Exact removal of repeated byte strings by suffix arrays (operator 2).

Every window of `length` bytes is filed under its anchor: the `GRAM`-byte string of least hash in it (the
leftmost of equals), which depends on the window's bytes alone. Consecutive windows with one anchor form
a segment. Equal windows have equal anchors, so only segments whose anchor stands elsewhere too can hold
a repeat; equal segments collapse to one with a count, and a repeated one is removed whole. Where an anchor
has different segments, a suffix array of them is built by two-stage sorting: suffixes smaller than
their successors are sorted directly, all others are induced by one scan over the buckets, and adjacent
common prefixes of `length` or more mark the windows which repeat.

An anchor with more than `split` different segments (a short passage in ever new surroundings) would be one task's work. Its
segments are first cut into finer ones by content: windows whose digest stands nowhere else can't repeat and go, and
the others are filed under further anchors, one for each of `LEVELS` other hashes. These again depend on a window's bytes
alone, so that equal windows meet; equal finer segments collapse, and the suffix arrays decide the rest as everywhere.

Keys that very many rows hold are split before rows meet: no task has more of one key than a small share of the total.

Defined results: null and empty texts have no bytes; a text shorter than `length` keeps all; offsets are bytes of the
UTF-8 text; matches never cross texts; ids are integers; rows that repeat an id must be equal rows, and repeat one another's
strings; rows with a null id are texts like others; an empty table gives an empty result; columns of the outputs' names are
replaced, all others are kept whatever their names; texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.llm.common import byte_sizes, materialize, skew_join, slices, tidied
from leadline.llm.shingles import BYTES, mix, powers, raw

U = np.uint64
GRAM = 100
#: Further anchors of the segments of a crowded anchor.
LEVELS = 6
PIECE = 1 << 20  # window starts read at once
PLACE = U((1 << 24) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(x)] = x
    grid = grid.reshape(rows, width)
    fore = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], fore[width - 1 : width - 1 + n])


def pieces(data: np.ndarray, ends: np.ndarray, length: int):
    """(bytes, [(row, first window in the text, place, windows)]) of about PIECE windows each."""
    held, where, size = [], [], 0
    for r, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        for s in range(a, b - length + 1, PIECE):
            e = min(s + PIECE, b - length + 1)
            held.append(data[s : e + length - 1])
            where.append((r, s - a, size, e - s))
            size += e - s + length - 1
            if size >= PIECE:
                yield np.concatenate(held), where
                held, where, size = [], [], 0
    if held:
        yield np.concatenate(held), where


def segments(b: np.ndarray, where: list[tuple[int, int, int, int]], length: int):
    """(row, first byte in the text, size, anchor hash, content hash) of every segment."""
    p, inv = powers(len(b) + 1)
    c = np.concatenate([[U(0)], np.cumsum(BYTES[b] * p[: len(b)])])
    g = mix((c[GRAM:] - c[:-GRAM]) * inv[: len(b) - GRAM + 1])
    least = sliding_min((g & ~PLACE) | np.arange(len(g), dtype=np.uint64), length - GRAM + 1)
    anchor = (least & PLACE).astype(np.int64)
    place = np.array([w[2] for w in where])
    ok = np.zeros(len(b) + 1, np.int64)
    ok[place] += 1
    ok[place + np.array([w[3] for w in where])] -= 1
    valid = np.flatnonzero(np.cumsum(ok)[: len(anchor)] > 0)
    own = np.searchsorted(place, valid, side="right") - 1
    new = np.concatenate([[True], (anchor[valid[1:]] != anchor[valid[:-1]]) | (own[1:] != own[:-1])])
    first = np.flatnonzero(new)
    start, last = valid[first], valid[np.append(first[1:], len(valid)) - 1]
    end = last + length
    own = own[first]
    row, at = np.array([w[0] for w in where])[own], np.array([w[1] for w in where])[own] + start - place[own]
    return row, at, end - start, g[anchor[start]].view(np.int64), mix((c[end] - c[start]) * inv[start], GRAM).view(np.int64)


def suffix_array(text: bytes, depth: int) -> np.ndarray:
    """All suffixes, ordered by at least their first `depth` bytes, by two-stage sorting."""
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    # a suffix has the type of the last place in its run of equal bytes
    at = np.searchsorted(change, np.arange(n))
    small = np.zeros(n, bool)
    has = at < len(change)
    small[has] = t[change[at[has]]] < t[change[at[has]] + 1]
    direct = sorted(np.flatnonzero(small).tolist(), key=lambda i: text[i : i + depth])
    direct = np.array(direct, np.int64)
    bounds = np.searchsorted(t[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        waiting[t[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        part = [np.concatenate(waiting[c])] if waiting[c] else []
        while part and len(part[-1]):  # suffixes that begin with runs of c induce one another
            j = part[-1] - 1
            j = j[j >= 0]
            part.append(j[(t[j] == c) & ~small[j]])
        part.append(direct[bounds[c] : bounds[c + 1]])
        done = np.concatenate(part)
        out.append(done)
        j = done - 1
        j = j[j >= 0]
        j = j[(t[j] > c) & ~small[j]]
        if len(j):
            by = np.argsort(t[j], kind="stable")
            j = j[by]
            cuts = np.flatnonzero(np.diff(t[j])) + 1
            for x in np.split(j, cuts):
                waiting[t[x[0]]].append(x)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def repeats(parts: list[bytes], length: int) -> list[np.ndarray]:
    """Of each part the window starts whose window stands elsewhere too among the parts."""
    text = b"\0".join(parts)
    starts = np.cumsum([0] + [len(p) + 1 for p in parts])[:-1]
    t = np.frombuffer(text + b"\0" * 8, np.uint8).astype(np.uint64)
    words = np.zeros(len(text), np.uint64)
    for k in range(8):
        words = (words << U(8)) | t[k : k + len(text)]
    whole = np.zeros(len(text) + 1, np.int64)
    for s, p in zip(starts.tolist(), parts):
        whole[s] += 1
        whole[s + len(p) - length + 1] -= 1
    valid = np.cumsum(whole)[:-1] > 0
    order = suffix_array(text, length + 48)
    order = order[valid[order]]
    same = np.arange(len(order) - 1)  # neighbours whose common prefix is still unbroken
    for k in range(0, length, 8):
        if not len(same):
            break
        k = min(k, length - 8)
        same = same[words[order[same] + k] == words[order[same + 1] + k]]
    hit = np.zeros(len(text) + 1, bool)
    hit[order[same]] = hit[order[same + 1]] = True
    return [np.flatnonzero(hit[s : s + len(p)]) for s, p in zip(starts.tolist(), parts)]


def runs(x: np.ndarray) -> list[dict[str, int]]:
    """Runs of consecutive ints as first and last."""
    if not len(x):
        return []
    cut = np.flatnonzero(np.diff(x) > 1)
    return [{"a": int(a), "z": int(z)} for a, z in zip(x[np.append(0, cut + 1)], x[np.append(cut, len(x) - 1)])]


RANGES = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))


def finer(part: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of a segment its digest, and a hash of its further anchors."""
    p, inv = powers(len(part) + 1)
    digest, anchors = None, np.zeros(len(part) - length + 1, np.uint64)
    for level in range(LEVELS):
        c = np.concatenate([[U(0)], np.cumsum(mix(BYTES, 3 + level)[part] * p[: len(part)])])
        if not level:
            digest = mix((c[length:] - c[:-length]) * inv[: len(c) - length])
        g = mix((c[GRAM:] - c[:-GRAM]) * inv[: len(part) - GRAM + 1], level)
        anchors = mix(anchors * U(31) + sliding_min(g, length - GRAM + 1))
    return digest.view(np.int64), anchors.view(np.int64)


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(none, k, t): a row without id is named by its text."""
    id = F.col(f"`{key}`").cast("long")
    return docs.select(id.isNull().alias("none"), F.coalesce(id, F.xxhash64(F.col(f"`{text}`"))).alias("k"), F.col(f"`{text}`").alias("t"))


def _occurrences(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for i, j in slices(byte_sizes(b.column(2)), 8 << 20):
                part = b.slice(i, j - i)
                data, ends = raw(part.column(2))
                for buffer, where in pieces(np.frombuffer(data, np.uint8), ends, length):
                    row, at, size, h, s = segments(buffer, where, length)
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(s), part.column(0).take(row), part.column(1).take(row), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32))], ["h", "s", "none", "k", "at", "size"])

    return docs.mapInArrow(tidied(run), "h long, s long, none boolean, k long, at int, size int")


def _sort_segments(parts: DataFrame, length: int, batch: int) -> DataFrame:
    """(h, s, ranges) of segments (h, s, bytes); a partition has all segments of its anchors."""

    def solve(rows):
        found = repeats([r[2] for r in rows], length)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([runs(x) for x in found], RANGES)], ["h", "s", "ranges"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for h, s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if size >= batch and h != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append((h, s, x))
                size += len(x)
        if held:
            yield solve(held)

    return parts.mapInArrow(tidied(run), "h long, s long, ranges array<struct<a:long,z:long>>")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, split: int = 2000, batch: int = 1 << 18) -> DataFrame:
    """docs with removed_spans (array<struct<start,end>> of bytes) and kept_bytes (binary); columns of these names are replaced."""
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} or more")
    names = ("removed_spans", "kept_bytes")
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in names])
    named = _named(docs, key, text)
    occ = _occurrences(named, length)
    again = materialize(occ.groupBy("h").agg(F.count("*").alias("c"), (F.min("s") != F.max("s")).alias("mixed")).where("c > 1"))
    occ = materialize(skew_join(occ, again, ["h"], "c", ["s", "k", "at"]).select("h", "s", "none", "k", "at", "size", "mixed"))
    distinct = materialize(occ.groupBy("h", "s").agg(F.count("*").alias("c"), F.min(F.struct("none", "k", "at", "size")).alias("x"), F.first("mixed").alias("mixed")).select("h", "s", "c", "x.none", "x.k", "x.at", "x.size", "mixed"))
    mixed = distinct.where("mixed")
    kinds = mixed.groupBy("h").agg(F.count("*").alias("n"))
    asked = skew_join(mixed, kinds, ["h"], "n", ["s"]).groupBy("none", "k").agg(F.collect_list(F.struct("h", "s", "at", "size", (F.col("n") > split).alias("hot"))).alias("asked"))
    texts = named.join(asked, ["none", "k"]).dropDuplicates(["none", "k"])

    def cut(batches):
        for b in batches:
            for i, j in slices(byte_sizes(b.column(0)), 2 << 20):
                out = [[], [], [], [], [], []]
                for r in range(i, j):
                    x = np.frombuffer((b.column(0)[r].as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
                    for a in b.column(1)[r].as_py():
                        part = x[a["at"] : a["at"] + a["size"]]
                        out[0].append(a["h"])
                        out[1].append(a["s"])
                        out[2].append(part.tobytes())
                        out[3].append(a["hot"])
                        w, k = finer(part, length) if a["hot"] else (None, None)
                        out[4].append(w)
                        out[5].append(k)
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], ["h", "s", "x", "hot", "ws", "ks"])

    parts = materialize(texts.select("t", "asked").mapInArrow(tidied(cut), "h long, s long, x binary, hot boolean, ws array<long>, ks array<long>"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = lambda df, *by: _sort_segments(df.repartition(n, *by).sortWithinPartitions(*by), length, batch)
    cold = sort(parts.where("not hot").select("h", "s", "x"), "h")
    # crowded anchors: windows that can repeat, in runs of one finer key, and the bytes of each run
    each = parts.where("hot").select("h", "s", F.posexplode(F.arrays_zip("ws", "ks")).alias("q", "w")).select("h", "s", "q", "w.ws", "w.ks")
    twice = each.groupBy("ws").agg(F.count("*").alias("n")).where("n > 1")
    kept = skew_join(each, twice, ["ws"], "n", ["s", "q"]).groupBy("h", "s").agg(F.sort_array(F.collect_list(F.struct("q", "ks"))).alias("qs"))
    start = F.expr("filter(qs, (x, i) -> i = 0 or x.ks <> qs[i - 1].ks or x.q <> qs[i - 1].q + 1)")
    end = F.expr("filter(qs, (x, i) -> i = size(qs) - 1 or x.ks <> qs[i + 1].ks or qs[i + 1].q <> x.q + 1)")
    runs_ = kept.select("h", "s", F.explode(F.arrays_zip(start.alias("a"), end.alias("z"))).alias("r")).select("h", "s", F.col("r.a.ks").alias("ks"), F.col("r.a.q").alias("a"), F.col("r.z.q").alias("z"))
    bytes_ = F.expr(f"substring(x, a + 1, z - a + {length})")
    fine = materialize(parts.where("hot").select("h", "s", "x").join(runs_, ["h", "s"]).select("h", "s", "ks", "a", bytes_.alias("x")).withColumn("s2", F.xxhash64("x")))
    one = fine.groupBy("h", "ks", "s2").agg(F.count("*").alias("c"), F.first("x").alias("x"))
    crowded = one.select(F.xxhash64("h", "ks").alias("h"), "s2", "c", "x")
    sorted_ = sort(crowded.select("h", F.col("s2").alias("s"), "x"), "h")
    answers = crowded.select("h", "s2", "c", F.octet_length("x").alias("size")).join(sorted_.select("h", F.col("s").alias("s2"), "ranges"), ["h", "s2"], "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("size") - length).cast("long").alias("z")))
    answers = answers.select("h", "s2", "c", F.when(F.col("c") > 1, whole).otherwise(F.col("ranges")).alias("ranges")).where(F.size("ranges") > 0)
    back = skew_join(fine.select(F.xxhash64("h", "ks").alias("g"), "s2", "h", "s", "a"), answers.withColumnRenamed("h", "g"), ["g", "s2"], "c", ["s", "a"])
    hot = back.select("h", "s", F.transform("ranges", lambda r: F.struct((F.col("a") + r["a"]).alias("a"), (F.col("a") + r["z"]).alias("z"))).alias("ranges")).groupBy("h", "s").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    found = materialize(cold.where(F.size("ranges") > 0).unionByName(hot))
    ranges = distinct.join(found, ["h", "s"], "left").select("h", "s", "c", F.when(F.col("c") > 1, whole).otherwise(F.col("ranges")).alias("ranges")).where("ranges is not null")
    marks = skew_join(occ, materialize(ranges), ["h", "s"], "c", ["k", "at"]).select("none", "k", F.transform("ranges", lambda r: F.struct((F.col("at") + r["a"]).alias("start"), (F.col("at") + r["z"] + length).alias("end"))).alias("m"))
    # equal rows have equal marks
    marks = marks.distinct().groupBy("none", "k").agg(F.flatten(F.collect_list("m")).alias("m"))
    # docs can have columns of any name: both sides are named apart
    id = F.col(f"docs.`{key}`").cast("long")
    same = (id.isNull() == F.col("marks.none")) & (F.coalesce(id, F.xxhash64(F.col(f"docs.`{text}`"))) == F.col("marks.k"))
    both = docs.alias("docs").join(marks.alias("marks"), same, "left").select("docs.*", "marks.m")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], span), T.StructField(names[1], T.BinaryType())])
    own, at = len(docs.columns), docs.columns.index(text)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def apply(batches):
        for b in batches:
            for i, j in slices(byte_sizes(b.column(at)), 4 << 20):
                part = b.slice(i, j - i)
                spans, kept = [], []
                for t, m in zip(part.column(at).to_pylist(), part.column(own).to_pylist()):
                    x = (t or "").encode("utf-8", "surrogatepass")
                    done: list[list[int]] = []
                    for a, z in sorted((s["start"], s["end"]) for s in m or ()):
                        if done and a <= done[-1][1]:
                            done[-1][1] = max(done[-1][1], z)
                        else:
                            done.append([a, z])
                    spans.append([{"start": a, "end": z} for a, z in done])
                    ends = [0, *(y for d in done for y in d), len(x)]
                    kept.append(b"".join(x[ends[k] : ends[k + 1]] for k in range(0, len(ends), 2)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(own)), pa.array(spans, kind), pa.array(kept, pa.binary())], schema.names)

    return both.mapInArrow(tidied(apply), schema)
