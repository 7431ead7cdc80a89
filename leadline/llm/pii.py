"""Personal data: exact base patterns, and a character BiLSTM-CRF that adds spans (operator 3).

Base spans of four kinds come from linear scans of the whole text. The model is a bidirectional LSTM
over characters with CRF transitions between BIO tags, trained here in numpy from labelled spans: up to
`sample` windows of the documents, tagged by their base spans, and generated windows in which values
stand side by side (base patterns run over such neighbours and drop both). Every digit or '@' of a text
lies well inside some window of `WINDOW` characters; windows overlap by half and each is decoded by Viterbi. A span that a
window cuts is decoded again in those of `LONG` characters around it, so that every span of up to `LONG` - 3 `MARGIN`
characters is seen whole; longer runs are none of these kinds. One reconciliation over the whole text picks the best spans
that neither overlap each other nor a base span. A model span counts only if its kind's form check holds for it.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; equal texts have equal spans,
whatever their rows; of base spans with one start the first kind as listed comes first; of model spans that overlap those of
greatest total score stay, of equal ones those found first from the left; texts without any window to learn from leave the
generated windows; an empty table gives an empty result; a column of the output's name is replaced, all others are kept
whatever their names; texts are read whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.llm.common import by_place, byte_sizes, slices, tidied

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The lookbehind only saves time: a start inside a run of digits fails where the run's start failed.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CUE = re.compile(r"[0-9@]")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
FORMS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?:\.[0-9]+){3}"),
    "card": CARD,
    "phone": re.compile(r"\+?[0-9(][ ().0-9-]+[0-9]"),
}


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(s: str) -> bool:
    d = [ord(c) - 48 for c in reversed(digits(s))]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def holds(kind: str, s: str) -> bool:
    """The check that a match of a kind's pattern must pass."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-18:]) <= 255 for p in s.split("."))
    if kind == "card":
        return 12 <= len(digits(s)) <= 19 and luhn(s)
    return kind == "email" or 9 <= len(digits(s)) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each '@' outwards: no character is read twice over."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and not NOT_LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
            at = text.find("@", end)
        else:
            end = at + 1  # '@' parts local parts
            at = text.find("@", at + 1)
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans by start, then by kind as listed."""
    if not text or not CUE.search(text):
        return []
    out = [(a, 0, b) for a, b in emails(text)]
    for k, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if holds(KINDS[k], m[0])]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


# ---- the model

WINDOW, STRIDE, MARGIN = 96, 48, 24
#: Characters of the windows around spans that a window cuts.
LONG = 384
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
LETTERS = 100  # character classes: ASCII 32..126 one by one, white space, other letters, anything else


def encode(windows: list[str], width: int = WINDOW) -> np.ndarray:
    out = np.full((len(windows), width), LETTERS - 1, np.int64)
    for i, w in enumerate(windows):
        a = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        out[i, : len(a)] = np.where((a >= 32) & (a < 127), a - 32, np.where(a < 32, 95, np.where(a < 0x2000, 96, 97)))
    return out


def tag(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for k, a, b in spans:
        y[a:b] = 2 + 2 * k
        y[a] = 1 + 2 * k
    return y


def generate(rng: np.random.Generator, n: int) -> tuple[list[str], list[np.ndarray]]:
    """Labelled windows: values of the four kinds alone and side by side among words, and look-alikes."""
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("aeionrstlhdéuäß"), rng.integers(1, 9)))

    def value(k: int) -> str:
        if k == 0:
            return word() + rng.choice([".", "", "_", "-"]) + d(rng.integers(0, 3)) + "@" + rng.choice(["mail", "post", "x", "web"]) + d(rng.integers(0, 2)) + "." + rng.choice(["example.com", "org", "test.net", "de"])
        if k == 1:
            return ".".join(str(x) for x in rng.integers(0, 256, 4))
        if k == 2:
            c = str(rng.integers(2, 7)) + d(rng.choice([14, 14, 14, 13, 15]))
            c += next(x for x in "0123456789" if luhn(c + x))
            return c if rng.random() < 0.6 else rng.choice([" ", "-"]).join(c[i : i + 4] for i in range(0, len(c), 4))
        return rng.choice(["+{} ({}) {}-{}", "+{} {} {} {}", "+{}-{}-{}-{}", "+{}{}{}{}"]).format(rng.integers(1, 99), d(3), d(3), d(4))

    texts, tags = [], []
    for _ in range(n):
        s, spans = word() + rng.choice([" ", ", ", ": ", "\n"]), []
        while len(s) < 70:
            r = rng.random()
            if r < 0.45:
                s += word()
            elif r < 0.6:
                s += rng.choice([d(rng.integers(1, 5)), "v" + d(1) + "." + d(1), "20" + d(2) + "-" + d(2) + "-" + d(2), "id=" + d(6), "token = " + bytes(rng.integers(0, 256, 8).astype(np.uint8)).hex(), "No. " + d(3), d(2) + ":" + d(2), "@" + word()])
            else:
                k = int(rng.integers(0, 4))
                v = value(k)
                if len(s) + len(v) > WINDOW - 2:
                    break
                spans.append((k, len(s), len(s) + len(v)))
                s += v + (rng.choice([".", ",", "###", ";"]) if rng.random() < 0.2 else "")
            s += " "
        s = s[:WINDOW]
        texts.append(s)
        tags.append(tag(WINDOW, spans))
    return texts, tags


class BiLstmCrf:
    def __init__(self, hidden: int = 20, embed: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        w = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.hidden = hidden
        self.p = {"e": w(LETTERS, embed) * 3, "o": w(2 * hidden, TAGS), "ob": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}
        for k in "fb":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            self.p |= {f"x{k}": w(embed, 4 * hidden), f"h{k}": w(hidden, 4 * hidden), f"c{k}": bias}

    def _lstm(self, x: np.ndarray, k: str):
        """x: time, batch, embed. States and gates for the way back."""
        n, b, h = x.shape[0], x.shape[1], self.hidden
        pre = x @ self.p[f"x{k}"] + self.p[f"c{k}"]
        hs, cs, gates = np.zeros((n + 1, b, h), np.float32), np.zeros((n + 1, b, h), np.float32), np.empty((n, b, 4 * h), np.float32)
        for t in range(n):
            g = pre[t] + hs[t] @ self.p[f"h{k}"]
            g[:, : 3 * h] = 1 / (1 + np.exp(-g[:, : 3 * h]))
            g[:, 3 * h :] = np.tanh(g[:, 3 * h :])
            gates[t] = g
            cs[t + 1] = g[:, h : 2 * h] * cs[t] + g[:, :h] * g[:, 3 * h :]
            hs[t + 1] = g[:, 2 * h : 3 * h] * np.tanh(cs[t + 1])
        return hs, cs, gates

    def emissions(self, x: np.ndarray, keep: bool = False):
        """Scores of tags: time, batch, tags."""
        e = self.p["e"][x.T]
        f, b = self._lstm(e, "f"), self._lstm(e[::-1], "b")
        both = np.concatenate([f[0][1:], b[0][1:][::-1]], axis=2)
        out = both @ self.p["o"] + self.p["ob"]
        return (out, (e, f, b, both)) if keep else out

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 260, batch: int = 48, rate: float = 0.02, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for i in range(1, steps + 1):
            at = rng.integers(0, len(x), batch)
            g = self._gradient(x[at], y[at])
            lr = rate * min(1, 2 * (1 - i / (steps + 1)))
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                self.p[k] -= lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-6)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        out, (e, f, b, both) = self.emissions(x, True)
        n, size, tr = out.shape[0], out.shape[1], self.p["t"]
        yt = y.T
        top = lambda a, ax: (a.max(axis=ax), np.exp(a - a.max(axis=ax, keepdims=True)))
        fore, back = np.empty_like(out), np.zeros_like(out)
        fore[0] = out[0]
        for t in range(1, n):
            a, z = top(fore[t - 1][:, :, None] + tr, 1)
            fore[t] = a + np.log(z.sum(1)) + out[t]
        for t in range(n - 2, -1, -1):
            a, z = top(tr + (out[t + 1] + back[t + 1])[:, None, :], 2)
            back[t] = a + np.log(z.sum(2))
        whole = fore[-1].max(1) + np.log(np.exp(fore[-1] - fore[-1].max(1, keepdims=True)).sum(1))
        d = np.exp(fore + back - whole[None, :, None])
        pair = np.exp(fore[:-1][..., None] + tr + (out[1:] + back[1:])[:, :, None, :] - whole[None, :, None, None]).sum((0, 1))
        np.add.at(pair, (yt[:-1].ravel(), yt[1:].ravel()), -1)
        d[np.arange(n)[:, None], np.arange(size)[None], yt] -= 1
        d /= size
        g = {"t": pair / size, "o": np.einsum("tbh,tbk->hk", both, d), "ob": d.sum((0, 1))}
        dh = d @ self.p["o"].T
        h = self.hidden
        de = np.zeros_like(e)
        for k, (hs, cs, gates), dd, ee, turn in (("f", f, dh[..., :h], e, 1), ("b", b, dh[::-1, :, h:], e[::-1], -1)):
            dg = np.empty_like(gates)
            carry_h, carry_c = np.zeros_like(hs[0]), np.zeros_like(cs[0])
            for t in range(n - 1, -1, -1):
                gi, gf, go, gc = (gates[t][:, j * h : (j + 1) * h] for j in range(4))
                tc = np.tanh(cs[t + 1])
                dht = dd[t] + carry_h
                dc = carry_c + dht * go * (1 - tc**2)
                dg[t] = np.concatenate([dc * gc * gi * (1 - gi), dc * cs[t] * gf * (1 - gf), dht * tc * go * (1 - go), dc * gi * (1 - gc**2)], 1)
                carry_h, carry_c = dg[t] @ self.p[f"h{k}"].T, dc * gf
            g[f"x{k}"] = np.einsum("tbe,tbg->eg", ee, dg)
            g[f"h{k}"] = np.einsum("tbh,tbg->hg", hs[:-1], dg)
            g[f"c{k}"] = dg.sum((0, 1))
            de += (dg @ self.p[f"x{k}"].T)[::turn]
        g["e"] = np.zeros_like(self.p["e"])
        np.add.at(g["e"], x.T.ravel(), de.reshape(-1, de.shape[2]))
        norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
        return {k: v * min(1, 5 / max(norm, 1e-9)) for k, v in g.items()}

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags by Viterbi, and each chosen tag's lead over the best other emission."""
        out = self.emissions(x)
        n, size = out.shape[:2]
        score, back = out[0], np.empty((n, size, TAGS), np.int8)
        for t in range(1, n):
            a = score[:, :, None] + self.p["t"]
            back[t] = a.argmax(1)
            score = a.max(1) + out[t]
        best = np.empty((n, size), np.int64)
        best[-1] = score.argmax(1)
        for t in range(n - 1, 0, -1):
            best[t - 1] = back[t][np.arange(size), best[t]]
        own = np.take_along_axis(out, best[..., None], 2)[..., 0]
        rest = out.copy()
        np.put_along_axis(rest, best[..., None], -np.inf, 2)
        return best.T, (own - rest.max(2)).T


def window_starts(text: str) -> list[int]:
    """Starts of overlapping windows which hold every cue with MARGIN characters around it, where the text has them."""
    out: list[int] = []
    for m in CUE.finditer(text):
        need = max(0, m.start() - MARGIN)
        if out and m.start() + MARGIN < out[-1] + WINDOW:
            continue
        out.append(max(need, out[-1] + STRIDE) if out and need < out[-1] + WINDOW else need)
    return out


def reconcile(found: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (score, kind, start, end) over a whole text the non-overlapping spans of greatest total score."""
    spans = sorted({(b, a, k): s for s, k, a, b in sorted(found)}.items())
    ends = [x[0][0] for x in spans]
    total, chosen = [0.0], []
    for i, ((b, a, _), s) in enumerate(spans):
        j = int(np.searchsorted(ends[:i], a, side="right"))
        chosen.append((s + total[j] > total[-1], j))
        total.append(max(total[-1], s + total[j]))
    out, i = [], len(spans)
    while i:
        take, j = chosen[i - 1]
        if take:
            (b, a, k), _ = spans[i - 1]
            out.append((a, k, b))
        i = j if take else i - 1
    return out[::-1]


def _decoded(texts: list[str | None], where: list[tuple[int, int]], model: BiLstmCrf, width: int, batch: int):
    """(text, kind, start, end, score, cut on the left, on the right) of the tagged spans of windows (text, start)."""
    for k in range(0, len(where), batch):
        part = where[k : k + batch]
        tags, lead = model.decode(encode([texts[i][s : s + width] for i, s in part], width))
        for (i, s), row, sure in zip(part, tags, lead):
            n = min(width, len(texts[i]) - s)
            for a in np.flatnonzero((row[:n] > 0) & (row[:n] % 2 == 1)).tolist():
                kind = (row[a] - 1) // 2
                b = a + 1
                while b < n and row[b] == 2 + 2 * kind:
                    b += 1
                yield i, int(kind), s + a, s + b, float(np.tanh(sure[a:b].mean())), a == 0 and s > 0, b == n and s + n < len(texts[i])


def model_spans(texts: list[str | None], base: list[list[tuple[str, int, int]]], model: BiLstmCrf, batch: int = 512) -> list[list[tuple[str, int, int]]]:
    """Spans that the model adds to the base spans of each text."""
    found: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
    again: set[tuple[int, int]] = set()

    def take(i, kind, a, b, sure):
        text = texts[i][a:b].rstrip(" .,;(")
        if FORMS[KINDS[kind]].fullmatch(text) and holds(KINDS[kind], text):
            found[i].append((len(text) + sure, kind, a, a + len(text)))

    for i, kind, a, b, sure, left, right in _decoded(texts, [(i, s) for i, t in enumerate(texts) if t for s in window_starts(t)], model, WINDOW, batch):
        if not left and not right:
            take(i, kind, a, b, sure)
        else:  # every place that the whole span can have; in steps, so that the cuts of neighbours share windows
            first, last = b + MARGIN - LONG if left else a - MARGIN, a - MARGIN if right else b + MARGIN - LONG
            again |= {(i, max(0, s)) for s in range(first // MARGIN * MARGIN, last + 1, MARGIN)}
    for i, kind, a, b, sure, left, right in _decoded(texts, sorted(again), model, LONG, batch // 4):
        if not left and not right:
            take(i, kind, a, b, sure)
    out = []
    for spans, own in zip(found, base):
        free = [f for f in spans if all(f[3] <= a or f[2] >= b for _, a, b in own)] if own else spans
        out.append([(KINDS[k], a, b) for a, k, b in reconcile(free)] if free else [])
    return out


def _training_windows(batches):
    """(order, window, starts, ends, kinds) around base spans; the order is a hash of the window."""
    import zlib

    for b in batches:
        rows = []
        for t in b.column(0).to_pylist():
            spans = base_spans(t)
            for s in window_starts(t) if spans else ():
                w = t[s : s + WINDOW]
                inside = [(KINDS.index(k), a - s, z - s) for k, a, z in spans if a >= s and z <= s + len(w)]
                rest = list(w)
                for _, a, z in inside:
                    rest[a:z] = " " * (z - a)
                if inside and sum(c.isdigit() for c in rest) < 9:
                    rows.append((zlib.crc32(w.encode("utf-8", "surrogatepass")), w, [x for i in inside for x in i]))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["o", "w", "spans"])


def train(docs: DataFrame, text: str = "text", sample: int = 600, generated: int = 1400, read: int = 4000) -> BiLstmCrf:
    """A model from at most `sample` labelled windows of the documents, least hash first, and generated ones.

    The windows are those of about `read` documents with a digit or an '@', chosen by the hash of their texts below a bound
    that comes from their number: what is read and sent does not grow with the table. They are labelled on the executors.
    """
    some = docs.select(F.col(f"`{text}`").alias("t")).where(F.col("t").rlike("[0-9@]"))
    n = some.count()
    if n > read:
        some = some.where(F.pmod(F.xxhash64("t"), F.lit(1 << 40)) < int((1 << 40) * read / n))
    own = some.mapInArrow(tidied(_training_windows), "o long, w string, spans array<long>").distinct().orderBy("o", "w", "spans").limit(sample).collect()
    texts, tags = generate(np.random.default_rng(11), generated)
    for r in own:
        texts.append(r["w"])
        tags.append(tag(WINDOW, [tuple(r["spans"][i : i + 3]) for i in range(0, len(r["spans"]), 3)]))
    model = BiLstmCrf()
    model.fit(encode(texts), np.array(tags))
    return model


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])


def find_pii(docs: DataFrame, model: BiLstmCrf | None = None, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """docs with array<struct<kind,start,end,base>> by start, then kind as listed; a column of that name is replaced, others may have any name."""
    return by_place(docs, (out,), lambda rows, names: _find_pii(rows, model, names[docs.columns.index(text)], out))


def _find_pii(docs: DataFrame, model: BiLstmCrf | None, text: str, out: str) -> DataFrame:
    model = model or train(docs, text)
    kept = [f for f in docs.schema.fields if f.name != out]
    at, keep = docs.columns.index(text), [docs.columns.index(f.name) for f in kept]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(SPAN))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for b in batches:
            for i, j in slices(byte_sizes(b.column(at)), 4 << 20):
                part = b.slice(i, j - i)
                texts = part.column(at).to_pylist()
                base = [base_spans(t) for t in texts]
                rows = []
                for own, more in zip(base, model_spans(texts, base, model)):
                    both = [(a, KINDS.index(k), z, True) for k, a, z in own] + [(a, KINDS.index(k), z, False) for k, a, z in more]
                    rows.append([{"kind": KINDS[k], "start": a, "end": z, "base": o} for a, k, z, o in sorted(both)])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(rows, kind)], schema.names)

    return docs.mapInArrow(tidied(run), schema)


def joined(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text, spans):
    """The text with every span replaced by its kind in angle brackets; overlapping spans count as one."""
    step = lambda acc, s: F.when(s["start"] < acc["at"], F.struct(acc["s"].alias("s"), F.greatest(acc["at"], s["end"]).alias("at"))).otherwise(F.struct(F.concat(acc["s"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("s"), s["end"].alias("at")))
    return F.when(F.size(spans) > 0, F.aggregate(spans, F.struct(F.lit("").alias("s"), F.lit(0).cast("long").alias("at")), step, lambda a: F.concat(a["s"], F.substring(text, a["at"].cast("int") + 1, F.length(text))))).otherwise(text)
