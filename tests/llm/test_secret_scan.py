"""Operator 12 against plain patterns and a plain battery of tests, and on rows that are odd in every way."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from leadline.llm import queries, secretscan

SMALL = "/root/testdata/sf0.001"
PATTERNS = (
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", "(AKIA[A-Z0-9]+)", 18),
    ("hex", "([0-9a-f]+)", 16),
)


def plain_base(text):
    out = [(m.start(), k, m.end()) for k, (_, p, least) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if len(m[1]) >= least]
    return [(PATTERNS[k][0], a, b) for a, k, b in sorted(out)]


# ---- one token at a time, with plain numbers


def plain_cell(token):
    n = len(token)
    fitting = [e for e, a in enumerate(secretscan.ALPHABETS) if set(token) <= set(a)]
    if not fitting or fitting[0] == 0:
        return None
    a = secretscan.ALPHABETS[fitting[0]]
    k, x = len(a), [a.index(c) for c in token]
    tail = lambda z: math.log(max(math.erfc(abs(z) / math.sqrt(2)), 1e-300))
    x2 = sum(c * c for c in Counter(x).values()) * k / n - n
    g = (k - 1) * n / (2 * (n - 1))
    logs = tail(((x2 / (k - 1)) ** (1 / 3) - (1 - 1 / (9 * g))) * math.sqrt(9 * g))
    high = [c >= k / 2 for c in x]
    ones = sum(high)
    if ones in (0, n):
        logs += tail(math.sqrt(2 * n * math.log(2)))
    else:
        mean = 1 + 2 * ones * (n - ones) / n
        runs = 1 + sum(p != q for p, q in zip(high, high[1:]))
        logs += tail((runs - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9)))
    m = sum(x) / n
    square = sum((c - m) ** 2 for c in x)
    logs += tail(30) if square < 1e-9 else tail((sum((p - m) * (q - m) for p, q in zip(x, x[1:])) / square + 1 / n) * math.sqrt(n))
    fit = math.exp(logs) * (1 - logs + logs * logs / 2)
    return max(i for i, size in enumerate(secretscan.LENGTHS) if size <= n), fitting[0], min(63, int(fit * 64))


def plain_spans(texts, rate):
    base = [plain_base(t) for t in texts]
    words, ordinary, every = [], Counter(), Counter()
    for t, own in zip(texts, base):
        t = t or ""
        cut = set()
        found = []
        for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}", t):
            if re.search("[+/]", m[0]) and re.search("[-_]", m[0]):
                found += [(m.start() + s.start(), m.start() + s.end()) for s in re.finditer("[A-Za-z0-9]{16,}", m[0])]
            else:
                found.append(m.span())
        found = [(a, z) for a, z in found if all(z <= b or a >= e for _, b, e in own)]
        words.append(found)
        for a, z in found + [(b, e) for _, b, e in own]:
            cut.update(range(a, z))
        rest = "".join(c for i, c in enumerate(t) if i not in cut and re.match("[A-Za-z0-9+/_-]", c))
        at, j = 0, 0
        while at + secretscan.LENGTHS[j] <= len(rest):
            every[j] += 1
            ordinary[plain_cell(rest[at : at + secretscan.LENGTHS[j]])] += 1
            at, j = at + secretscan.LENGTHS[j], (j + 1) % len(secretscan.LENGTHS)
    asked = Counter(c for t, own in zip(texts, words) for a, z in own if (c := plain_cell(t[a:z])))
    good = set()
    for j in range(len(secretscan.LENGTHS)):
        chance = {}
        for c in asked:
            if c[0] == j:
                n = sum(v for o, v in ordinary.items() if o and o[:2] == c[:2] and o[2] >= c[2])
                chance[c] = min(1, 11 * (1 + n) / (1 + every[j]))
        total = sum(asked[c] for c in chance)
        limit = max((p for p in chance.values() if p * total <= rate * sum(asked[c] for c in chance if chance[c] <= p)), default=-1)
        good |= {c for c, p in chance.items() if p <= limit}
    out = []
    for t, own, found in zip(texts, base, words):
        spans = [(a, secretscan.KINDS.index(k), z, k) for k, a, z in own] + [(a, 9, z, "random") for a, z in found if plain_cell(t[a:z]) in good]
        out.append([(k, a, z) for a, _, z, k in sorted(spans)])
    return out


def planted():
    rng = random.Random(11)
    draw = lambda n, a=string.ascii_letters + string.digits: "".join(rng.choice(a) for _ in range(n))
    return [f"set {draw(n)} as told" for n in (40, 40, 44, 48, 52, 60, 64, 70, 90, 120)] * 2


def spans_of(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return [[(s["kind"], s["start"], s["end"]) for s in r["secret_spans"]] for r in secretscan.find_secrets(df, **more).orderBy("id").collect()]


@pytest.mark.parametrize("rate", [0.01, 0.3])
def test_against_a_plain_battery(spark, rate):
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()] + planted()
    got = spans_of(spark, texts, rate=rate, most=1 << 16)
    assert got == plain_spans(texts, rate)
    if rate == 0.3:
        assert sum(s[0] == "random" for own in got[-20:] for s in own) >= 18


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = dict(zip([r["doc_id"] for r in docs], plain_spans([r["text"] for r in docs], 0.01)))
    text = lambda spans: ",".join(f"{k}:{a}:{z}" for k, a, z in spans)
    for r in queries.op12_secret_scan(spark, SMALL).collect():
        own = want.pop(r["doc_id"])
        base = [s for s in own if s[0] != "random"]
        assert r["spans"] == text(own) and r["base_sha256"] == hashlib.sha256(text(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in secretscan.KINDS] == [sum(s[0] == k for s in base) for k in secretscan.KINDS]
    assert not want


def test_base_spans_of_random_strings():
    rng = random.Random(7)
    parts = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "API-KEY", "toKen", "ſecret", "AKIA", "ABCDEFGHIJ1234", "deadbeef0123", "0123456789abcdef", "=", ":", " ", '"', "'", "é", "\n", "a", ".", "-", "ABCdef/+_"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        assert secretscan.base_spans(t) == plain_base(t)


def test_odd_rows(spark):
    hexes = "0123456789abcdef"
    texts = [None, "", " ", "é" * 40, "g" * 300_000, "9" * 15, f"é{hexes}", f"token={hexes}", f"token={hexes}", "AKIA" + "A1" * 7, "AKIA" + "A" * 13, "token=short", "x" * 20 + " " + "퟿" * 3]
    got = spans_of(spark, texts)
    assert got[6] == [("hex", 1, 17)] and got[7] == got[8] == [("assign", 0, 22), ("hex", 6, 22)] and got[9] == [("access", 0, 18)]
    assert all(not own for i, own in enumerate(got) if i not in (6, 7, 8, 9))
    assert spans_of(spark, []) == []
    df = spark.createDataFrame([(1, f"token={hexes}", 5, 6)], "`a.b` long, `the text` string, secret_spans int, cell int")
    out = secretscan.find_secrets(df, "the text")
    assert out.columns == ["a.b", "the text", "cell", "secret_spans"] and len(out.collect()[0]["secret_spans"]) == 2


def test_fits_are_even_for_random_tokens_and_low_for_words():
    rng = np.random.default_rng(2)
    for k, n in ((16, 32), (36, 24), (62, 20), (64, 40)):
        fit = secretscan.fits(rng.integers(0, k, (4000, n)), k)
        assert abs((fit < 0.5).mean() - 0.5) < 0.08 and (fit < 0.05).mean() < 0.12
    for word in (b"internationalisation", b"aaaaaaaaaaaaaaaaaaaa", b"ababababababababababab", b"abcdefghijklmnopqrstuvwx"):
        assert secretscan.token_cells([word])[0] % secretscan.BINS < 16


def test_false_discoveries_stay_below_the_rate():
    cells = secretscan.CELLS
    ordinary, asked = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    at = lambda j, e, b: (j * len(secretscan.ALPHABETS) + e) * secretscan.BINS + b
    ordinary[at(1, 3, 0)], ordinary[at(1, 3, 40)] = 99_000, 1000
    asked[at(1, 3, 0)], asked[at(1, 3, 40)], asked[at(1, 9, 40)] = 5000, 50, 100
    every = np.full(len(secretscan.LENGTHS), 100_000)
    good = secretscan.accepted(ordinary, every, asked, 0.05)
    assert good[at(1, 9, 40)] and not good[at(1, 3, 40)] and not good[at(1, 3, 0)]
    assert not secretscan.accepted(ordinary, np.full(len(secretscan.LENGTHS), 100), asked, 0.05)[at(1, 9, 40)]  # too little text to say
