"""Operator 13 against plain counts, and on rows that are odd in every way."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from leadline.llm import queries, resampling
from leadline.llm.common import words

SMALL = "/root/testdata/sf0.001"


def plain_features(text, most=3):
    w = words(text)
    return [zlib.crc32(b" ".join(w[i : i + n])) % 10_000 for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def plain(rows, target, percent=5):
    """rows of (id, text): (id, n_features, weight, score, rank) of each, as a list in their order."""
    s, t = Counter(b for _, x in rows for b in plain_features(x)), Counter(b for x in target for b in plain_features(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out = []
    for i, x in rows:
        own = plain_features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, own))
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [o for o, (_, x) in zip(out, rows) if len(words(x)) >= 20]
    for rank, o in enumerate(sorted(able, key=lambda o: (-o[3], o[0] is None, o[0] or 0))[: len(able) * percent // 100], 1):
        o[4] = rank
    return [tuple(o) for o in out]


def read(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet").collect()


def test_query(spark):
    want = plain([(r["doc_id"], r["text"]) for r in read(spark, "documents")], [r["text"] for r in read(spark, "benchmark")])
    assert {tuple(r) for r in queries.op13_importance_resampling(spark, SMALL).collect()} == set(want)
    assert sum(r[4] is not None for r in want) > 5


def test_shards_don_t_change_counts():
    rng = random.Random(3)
    texts = [None, "", " .", "a", "a b", "A b a B a b c", "x" * 500 + " y z", "é é é é", "a-b_c", " a", "0 1 2"] + [" ".join(rng.choice(["a", "b", "c", "dé", "x" * 70, "x" * 71, "x" * 130]) for _ in range(rng.randrange(40))) for _ in range(80)]
    want = sum((Counter(plain_features(t)) for t in texts), Counter())
    for cut in (1, 7, 100):
        got = sum(resampling.bucket_counts(texts[i : i + cut], 10_000, 3) for i in range(0, len(texts), cut))
        assert {i: int(n) for i, n in enumerate(got) if n} == dict(want)
    gain = np.random.default_rng(0).integers(-900, 900, 10_000)
    for most in (1, 2, 4):
        n, features, weight = resampling.weights(texts, gain, most)
        for t, a, b, c in zip(texts, n, features, weight):
            own = plain_features(t, most)
            assert (a, b, c) == (len(words(t)), len(own), sum(int(gain[x]) for x in own))


def test_hash_of_joined_texts():
    rng = random.Random(1)
    for n in (0, 1, 2, 63, 64, 65, 1000, 100_003):
        a, b = (bytes(rng.randrange(256) for _ in range(k)) for k in (rng.randrange(30), n))
        assert int(resampling._apply(resampling.later(n), np.array([zlib.crc32(a)], np.uint32))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_suffixes_of_large_vocabularies():
    """Beyond 62 bits of a joint key the order comes from one sort by columns: same runs."""
    rng = np.random.default_rng(2)
    seq = np.where(rng.random(2000) < 0.1, -1, rng.integers(0, 5, 2000))
    for far in (1, 1 << 40):
        wide = np.where(seq < 0, -1, seq * far)
        order, common = resampling.suffixes(wide, 3)
        keys = [tuple(_until_end(wide, i, 3)) for i in order]
        assert keys == sorted(keys)
        for (a, b), c in zip(zip(keys, keys[1:]), common[1:]):
            k = 0
            while k < 3 and a[k] == b[k] >= 0:
                k += 1
            assert c == k


def _until_end(seq, i, most):
    out = []
    for k in range(most):
        out.append(int(seq[i + k]) if i + k < len(seq) and (not out or out[-1] >= 0) else -1)
    return out


@pytest.mark.parametrize("target", [[], [None, "", "one two three four"], ["w1 w2 w3"] * 50])
def test_odd_rows(spark, target):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(30)}" for _ in range(n))
    same = text(25)
    rows = [(1, None), (2, ""), (3, "one"), (None, text(30)), (None, same), (4, same), (5, same), (5, same), (6, "y " * 60_000), (7, text(19)), (8, text(20))] + [(100 + i, text(22)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=30).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = plain(rows, target, 30)
    # rows of one id and score may change places
    assert sorted(key(r)[:4] for r in got) == sorted(key(r)[:4] for r in want)
    assert sorted(r["rank"] for r in got if r["rank"]) == sorted(r[4] for r in want if r[4])
    assert {(r["doc_id"], r["rank"]) for r in got if r["doc_id"] not in (5, None)} == {(r[0], r[4]) for r in want if r[0] not in (5, None)}


def test_empty_table_and_columns_of_any_name(spark):
    target = spark.createDataFrame([("a b c",)], "text string")
    assert resampling.resample(spark.createDataFrame([], "doc_id long, text string"), target).collect() == []
    docs = spark.createDataFrame([(1, "a b c", 5, 6)], "`the.id` long, `a text` string, weight int, n int")
    scored = resampling.score(docs, np.zeros(10_000, np.int64), "the.id", "a text")
    assert scored.columns == ["the.id", "a text", "n", "n_words", "n_features", "weight", "score"]
    assert scored.collect()[0]["n_features"] == 6
    assert resampling.resample(docs, target, "the.id", "a text").columns == ["the.id", "n_features", "weight", "score", "rank"]
