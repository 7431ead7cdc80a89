"""Operator 11 against plain Lloyd rounds, and on rows that are odd in every way."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadline.llm import queries, vectorcodes

SMALL = "/root/testdata/sf0.001"


def plain(rows, parts=8, entries=16, rounds=6):
    """rows of (id, vector): books, and of each usable row (id, codes, error), with Python's own integers."""
    ok = lambda v: v is not None and v and all(c is not None and math.isfinite(c) for c in v) and len(v) % parts == 0
    kept = [(i, v) for i, v in rows if ok(v)]
    named = sorted((r for r in kept if r[0] is not None), key=lambda r: r)
    if not named:
        return [], []
    dim = len(named[0][1])
    kept = [(i, [math.floor(4096 * c) for c in v]) for i, v in kept if len(v) == dim]
    first = {}
    for i, v in named:
        if len(v) == dim:
            first.setdefault(i, [math.floor(4096 * c) for c in v])
    w = dim // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    books = [[cut(first[i])[p] for i in sorted(first)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: [min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e)) for p, x in enumerate(cut(v))]
    for _ in range(rounds):
        codes = [nearest(v) for _, v in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v)[p] for (_, v), c in zip(kept, codes) if c[p] == e]
                if own:
                    mean = [sum(col) // len(own) for col in zip(*own)]
                    books[p] = [*books[p][:e], mean, *books[p][e + 1 :]]
    out = []
    for i, v in kept:
        c = nearest(v)
        out.append((i, tuple(c), sum(far(x, books[p][c[p]]) for p, x in enumerate(cut(v)))))
    return books, out


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    books = vectorcodes.train(df, **more)
    return books, vectorcodes.encode(df, books).collect()


def test_query_against_plain_rounds(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    books, want = plain([r[:2] for r in rows])
    labels = {r[0]: r[2] for r in rows}
    sums = {}
    for i, _, e in want:
        sums[labels[i]] = sums.get(labels[i], 0) + e
    digest = vectorcodes.books_digest(np.array(books))
    got = {tuple(r) for r in queries.op11_vector_codes(spark, SMALL).collect()}
    assert got == {(i, "".join(f"{c:02x}" for c in cs), e, sums[labels[i]], digest) for i, cs, e in want}


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    nan, inf = float("nan"), float("inf")
    vectors = np.round(rng.normal(size=(40, 16)), 2).tolist()
    rows = [(10 + i, v) for i, v in enumerate(vectors)]
    rows += [(3, None), (4, []), (5, [nan] * 16), (6, [None] * 16), (7, [inf] * 16), (8, [1.0] * 15), (9, [1.0] * 24)][:-1]
    rows += [(None, vectors[0]), (10, vectors[5]), (10, vectors[5]), (200, vectors[1]), (201, vectors[1]), (202, [0.0] * 16), (203, [-0.0] * 16), (204, [2.0] * 24)]
    books, got = run(spark, rows)
    want_books, want = plain(rows)
    assert books.tolist() == want_books
    assert sorted((r["vec_id"] or -1, tuple(r["vec_codes"]), r["vec_error"]) for r in got) == sorted((i or -1, c, e) for i, c, e in want)


@pytest.mark.parametrize("scale", [1.0, 3.0e4])
def test_large_components_are_exact(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=16) * scale / 4).tolist()) for i in range(60)]
    rows = [(i, [max(-scale, min(scale, x)) for x in v]) for i, v in rows]
    books, got = run(spark, rows)
    want_books, want = plain(rows)
    assert books.tolist() == want_books and sorted(tuple(r["vec_codes"]) for r in got) == sorted(c for _, c, _ in want)
    assert sum(r["vec_error"] for r in got) == sum(e for _, _, e in want)


def test_out_of_range_components_count_as_the_bound(spark):
    _, got = run(spark, [(1, [1e300] * 8), (2, [-1e300] * 8), (3, [0.0] * 8)])
    assert [r["vec_error"] for r in got] == [0, 0, 0] and len({tuple(r["vec_codes"]) for r in got}) == 3


def test_few_and_no_vectors(spark):
    books, got = run(spark, [(2, [0.5] * 8), (1, [0.25] * 8)])
    assert books.shape == (8, 2, 1) and [(r["vec_id"], r["vec_codes"], r["vec_error"]) for r in got] == [(2, [1] * 8, 0), (1, [0] * 8, 0)]
    for rows in ([], [(1, None)], [(None, [1.0] * 8)]):
        books, got = run(spark, rows)
        assert not books.size and got == []


def test_columns_of_any_name_and_labels(spark):
    df = spark.createDataFrame([(1, [0.0] * 8, "a", 7), (2, [1.0] * 8, None, 7), (3, [0.5] * 8, None, 8), (4, [0.1] * 8, "a", 9)], "`an id` long, `a.b` array<double>, `label.x` string, vec_codes int")
    books = vectorcodes.train(df, "an id", "a.b", entries=2)
    coded = vectorcodes.encode(df, books, "a.b")
    assert coded.columns == ["an id", "a.b", "label.x", "vec_codes", "vec_error"]
    rows = vectorcodes.errors_by(coded, "label.x", "an id").collect()
    by = {}
    for r in rows:
        by[r["label.x"]] = by.get(r["label.x"], 0) + r["vec_error"]
    assert {(r["label.x"], r["label_error"]) for r in rows} == set(by.items()) and len(rows) == 4


def test_contributions_move_only_what_changed():
    rng = np.random.default_rng(5)
    v = rng.integers(-4096, 4096, (500, 8))
    old, new = rng.integers(0, 4, (500, 4)), rng.integers(0, 4, (500, 4))
    new[:, 1] = old[:, 1]
    shape = (4, 4, 2)
    at = lambda codes: vectorcodes.contributions(v, None, codes, shape)
    counts, sums = vectorcodes.contributions(v, old, new, shape)
    assert not counts[1].any() and not sums[1].any()
    assert (at(old)[0] + counts == at(new)[0]).all() and (at(old)[1] + sums == at(new)[1]).all()


def test_decoded_vectors_are_near(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet").where(F.col("embedding").isNotNull())
    books = vectorcodes.train(df)
    rows = vectorcodes.encode(df, books).collect()
    back = vectorcodes.decode(np.array([r["vec_codes"] for r in rows]), books)
    x = np.array([r["embedding"] for r in rows])
    assert ((x - back) ** 2).mean() < 0.8 * (x**2).mean()
