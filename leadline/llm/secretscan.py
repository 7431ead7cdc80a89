"""Secrets: exact base patterns, and a battery of randomness tests over tokens (operator 12).

A token is a maximal run of at least 16 characters of base64 (either alphabet); where both alphabets meet in one run, its
runs of letters and digits are tokens. The smallest encoding that holds all its characters is inferred, and its characters
become numbers. Three tests ask whether they look drawn evenly and independently: chi-squared uniformity over the alphabet
(with the exact moments of short texts), runs above and below the alphabet's middle, and serial correlation. Fisher's method
combines them into one probability, `fit`: even for random tokens, near 0 for words.

What ordinary text does is counted, not assumed: all other characters of every document, without base matches and tokens,
are cut into windows of `LENGTHS` characters that get the same tests. Of a token, at its length class, the chance is the share of
windows in the same encoding that fit as well, times the number of encodings; among all tokens of a length class the
Benjamini-Hochberg procedure accepts those whose chance keeps the share of false discoveries below `rate`. Chances are by
cells (length class, encoding, 1/64 of fit): the counts of cells are all that is shuffled, and the only thing that the
driver holds (`CELLS` of them at most).

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; equal texts have equal spans; of
base spans with one start the first kind as listed comes first, then a span of the tests; tokens that overlap a base span
are left out; tokens of digits alone are numbers and never secrets; an empty table gives an empty result; where there is little
text no chance is small enough and the base spans stand alone; a column of the output's name is replaced, all others are kept whatever
their names; texts are read whole.
"""

from __future__ import annotations

import math
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadline.llm.common import by_place, byte_sizes, slices, tidied

#: Kinds in their order and the patterns of the base spans.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RANDOM = "random"

#: Length classes of windows; a token belongs to the greatest that it reaches.
LENGTHS = (16, 20, 24, 32, 40, 64)
UPPER, LOWER, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
#: Alphabets in the order of their values, smaller ones first: the first that holds a token is its encoding.
ALPHABETS = (
    DIGITS, DIGITS + "abcdef", DIGITS + "ABCDEF", LOWER, UPPER, UPPER + "234567", DIGITS + LOWER, DIGITS + UPPER,
    UPPER + LOWER, DIGITS + UPPER + LOWER, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_",
)
BINS = 64
CELLS = len(LENGTHS) * len(ALPHABETS) * BINS
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
PLAIN = re.compile(r"[A-Za-z0-9]{16,}")
OTHER = re.compile(rb"[^A-Za-z0-9+/_-]+")

#: Of each byte the encodings that hold it, as bits, and its value in each.
HOLDS = np.zeros(256, np.int64)
VALUE = np.zeros((len(ALPHABETS), 256), np.int64)
for _e, _a in enumerate(ALPHABETS):
    for _i, _c in enumerate(_a):
        HOLDS[ord(_c)] |= 1 << _e
        VALUE[_e, ord(_c)] = _i

#: Of a standard normal |z|, in steps of 1/100, the logarithm of both tails.
TAILS = np.log([math.erfc(i / 100 / math.sqrt(2)) for i in range(3000)])


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans by start, then by kind as listed."""
    if not text:
        return []
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


def tokens(text: str | None, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Spans of the tokens that overlap no base span."""
    out = []
    for m in TOKEN.finditer(text or ""):
        a, b = m.span()
        own = m[0]
        if ("+" in own or "/" in own) and ("-" in own or "_" in own):
            out += [(a + s.start(), a + s.end()) for s in PLAIN.finditer(own)]
        else:
            out.append((a, b))
    if out and base:
        at, reach = 0, 0  # both lists come by start
        free = []
        for a, b in out:
            while at < len(base) and base[at][1] < b:
                reach = max(reach, base[at][2])
                at += 1
            if reach <= a:
                free.append((a, b))
        out = free
    return out


def _tail(z: np.ndarray) -> np.ndarray:
    return np.interp(np.abs(z) * 100, np.arange(len(TAILS)), TAILS)


def encodings(rows: np.ndarray) -> np.ndarray:
    """Of rows of bytes the first alphabet that holds each; -1 where none does."""
    held = np.bitwise_and.reduce(HOLDS[rows], axis=1)
    first = held & -held
    return np.where(held > 0, np.log2(np.maximum(first, 1)).astype(np.int64), -1)


def fits(codes: np.ndarray, k: int) -> np.ndarray:
    """Fisher's combined probability that rows of numbers below k are even and independent."""
    m, n = codes.shape
    counts = np.bincount((codes + np.arange(m)[:, None] * k).ravel(), minlength=m * k).reshape(m, k)
    x2 = (counts * counts).sum(1) * k / n - n
    shape = (k - 1) * n / (2 * (n - 1))  # of the gamma distribution with the mean and variance of x2
    z_even = (np.cbrt(x2 / (k - 1)) - (1 - 1 / (9 * shape))) * math.sqrt(9 * shape)
    high = codes >= k / 2
    ones = high.sum(1)
    mean = 1 + 2 * ones * (n - ones) / n
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    spread = np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    z_runs = np.where((ones == 0) | (ones == n), math.sqrt(2 * n * math.log(2)), (runs - mean) / spread)
    x = codes - codes.mean(1, keepdims=True)
    square = (x * x).sum(1)
    r = (x[:, 1:] * x[:, :-1]).sum(1) / np.maximum(square, 1e-9)
    z_serial = np.where(square < 1e-9, 30.0, (r + 1 / n) * math.sqrt(n))
    t = -(_tail(z_even) + _tail(z_runs) + _tail(z_serial))
    return np.exp(-t) * (1 + t + t * t / 2)


def cells(rows: np.ndarray) -> np.ndarray:
    """The cell of each row of bytes (all of one length, at least the least class): -1 for numbers and rows of no encoding."""
    n = rows.shape[1]
    of = int(np.searchsorted(LENGTHS, n, side="right")) - 1
    found = encodings(rows)
    out = np.full(len(rows), -1, np.int64)
    for e in np.unique(found[found > 0]).tolist():
        at = np.flatnonzero(found == e)
        step = max(1, (1 << 22) // max(n, len(ALPHABETS[e])))
        for i in range(0, len(at), step):
            some = at[i : i + step]
            fit = fits(VALUE[e][rows[some]], len(ALPHABETS[e]))
            out[some] = (of * len(ALPHABETS) + e) * BINS + np.minimum(BINS - 1, (fit * BINS).astype(np.int64))
    return out


def token_cells(found: list[bytes]) -> np.ndarray:
    """The cell of each token."""
    sizes = np.array([len(t) for t in found], np.int64)
    out = np.empty(len(found), np.int64)
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        out[at] = cells(np.frombuffer(b"".join(found[i] for i in at.tolist()), np.uint8).reshape(len(at), n))
    return out


def window_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(windows by cell, windows by length class) of ordinary texts; no window crosses texts."""
    turn = sum(LENGTHS)
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    counts, every = np.zeros(CELLS, np.int64), np.zeros(len(LENGTHS), np.int64)
    offset = 0
    for j, n in enumerate(LENGTHS):
        times = np.maximum(0, (sizes - offset - n) // turn + 1)
        at = np.repeat(starts + offset, times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)) * turn
        every[j] = len(at)
        for i in range(0, len(at), 1 << 15):
            c = cells(data[at[i : i + (1 << 15), None] + np.arange(n)])
            counts += np.bincount(c[c >= 0], minlength=CELLS)
        offset += n
    return counts, every


def accepted(ordinary: np.ndarray, every: np.ndarray, asked: np.ndarray, rate: float) -> np.ndarray:
    """By cell whether its tokens are secrets: Benjamini-Hochberg at `rate` in each length class.

    ordinary, asked: windows and tokens by cell; every: windows by length class.
    """
    shape = (len(LENGTHS), len(ALPHABETS), BINS)
    above = np.cumsum(ordinary.reshape(shape)[:, :, ::-1], axis=2)[:, :, ::-1]
    tested = len(ALPHABETS) - 1  # digits alone are no hypothesis
    chance = np.minimum(1, tested * (1 + above) / (1 + every[:, None, None]))
    out = np.zeros(shape, bool)
    for j, own in enumerate(asked.reshape(shape)):
        total = int(own.sum())
        if not total:
            continue
        p, n = chance[j].ravel(), own.ravel()
        order = np.argsort(p, kind="stable")
        reached = np.cumsum(n[order])
        good = p[order] * total <= rate * reached
        if good.any():
            out[j] = chance[j] <= p[order][good].max()
    return out.ravel()


def _read(texts: list[str | None]):
    """(base spans, token spans) of each text."""
    base = [base_spans(t) for t in texts]
    return base, [tokens(t, b) for t, b in zip(texts, base)]


def survey(docs: DataFrame, text: str = "text", most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows by cell, windows by length class, tokens by cell) over all documents: one pass, counts added up in every task."""

    def run(batches):
        ordinary, every, asked = np.zeros(CELLS, np.int64), np.zeros(len(LENGTHS), np.int64), np.zeros(CELLS, np.int64)
        for b in batches:
            for i, j in slices(byte_sizes(b.column(0)), most):
                texts = b.column(0).slice(i, j - i).to_pylist()
                base, found = _read(texts)
                rest, own = [], []
                for t, spans, at in zip(texts, base, found):
                    own += [t[a:z].encode() for a, z in at]
                    if not t:
                        continue
                    parts, end = [], 0
                    for a, z in sorted([(a, z) for _, a, z in spans] + at):
                        if a > end:
                            parts.append(t[end:a])
                        end = max(end, z)
                    rest.append(OTHER.sub(b"", (" ".join([*parts, t[end:]])).encode("utf-8", "surrogatepass")))
                counts, windows = window_counts(rest)
                ordinary += counts
                every += windows
                c = token_cells(own)
                asked += np.bincount(c[c >= 0], minlength=CELLS)
        both = np.concatenate([ordinary, every, asked])
        at = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(both[at])], ["cell", "n"])

    out = np.zeros(2 * CELLS + len(LENGTHS), np.int64)
    for r in docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(tidied(run), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out[:CELLS], out[CELLS : CELLS + len(LENGTHS)], out[CELLS + len(LENGTHS) :]


def find_secrets(docs: DataFrame, text: str = "text", rate: float = 0.01, most: int = 1 << 20) -> DataFrame:
    """docs with secret_spans (array<struct<kind,start,end,base>>, by start), a column of that name replaced. Two passes, no shuffle of rows."""
    secret = accepted(*survey(docs, text, most), rate)

    def scan(rows: DataFrame, names: list[str]) -> DataFrame:
        at = docs.columns.index(text)
        schema = rows.withColumn("secret_spans", F.expr("cast(null as array<struct<kind:string,start:int,end:int,base:boolean>>)")).schema
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

        def run(batches):
            for b in batches:
                for i, j in slices(byte_sizes(b.column(at)), most):
                    part = b.slice(i, j - i)
                    texts = part.column(at).to_pylist()
                    base, found = _read(texts)
                    c = token_cells([t[a:z].encode() for t, own in zip(texts, found) for a, z in own])
                    good = iter(((c >= 0) & secret[np.maximum(c, 0)]).tolist())
                    spans = []
                    for b_, own in zip(base, found):
                        added = [(a, len(KINDS), z, RANDOM) for a, z in own if next(good)]
                        every = sorted([(a, KINDS.index(k), z, k) for k, a, z in b_] + added)
                        spans.append([{"kind": k, "start": a, "end": z, "base": k != RANDOM} for a, _, z, k in every])
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, kind)], schema.names)

        return rows.mapInArrow(tidied(run), schema)

    return by_place(docs, ("secret_spans",), scan)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
