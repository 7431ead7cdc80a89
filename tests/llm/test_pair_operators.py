"""Operators 2, 9 and 10 and the pipeline against plain versions, and on rows that are odd in every way."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadline.llm import neardup, queries, suffixdedup, vectordup
from leadline.llm.common import components, skew_join

SMALL = "/root/testdata/sf0.001"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def least(nodes, edges):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        at[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (350, 2))] + [(1000 + i, 1001 + i) for i in range(200)]
    want = least({x for e in edges for x in e}, edges)
    df = spark.createDataFrame([*edges, (None, 3), (5, None)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert components(df.limit(0)).collect() == []


# ---- operator 2


def plain_removed(rows, length):
    """Of each row (text or None) the removed spans."""
    data = [(t or "").encode() for t in rows]
    seen = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        hit = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                hit[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(int)])))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        out.append((len(x), int(hit.sum()), len(spans), sha(x if not spans else bytes(np.frombuffer(x, np.uint8)[~hit[:-1]]))))
    return out


def test_suffix_dedup_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = {r["doc_id"]: w for r, w in zip(docs, plain_removed([r["text"] for r in docs], 400))}
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op2_suffix_dedup(spark, SMALL).collect()} == want


@pytest.mark.parametrize("split", [2000, 2])
def test_suffix_dedup_odd(spark, split):
    rng = np.random.default_rng(5)
    letters = lambda n: "".join(rng.choice(list("ab é"), n))
    passage = letters(260)
    rows = [None, "", "short", "a" * 5000, "a" * 900, "ab" * 700, letters(3000), passage, passage + letters(300)] + [letters(150) + passage + letters(int(rng.integers(0, 300))) for _ in range(12)]
    rows += [rows[6], rows[6][500:1500] + "tail" * 60, "x" * 119, "x" * 120, rows[-1][:200]]
    rows += [letters(150) + passage + letters(200), letters(400)]
    rows += [rows[-1][100:] + "x"]
    df = spark.createDataFrame([(i if i < len(rows) - 3 else None, t, 1, 2, i, "x") for i, t in enumerate(rows)], "doc_id long, text string, removed_spans int, k int, t int, none string")
    got = suffixdedup.remove_repeats(df, length=120, split=split).orderBy("t").collect()
    mine = [(len((t or "").encode()), sum(s["end"] - s["start"] for s in r["removed_spans"]), len(r["removed_spans"]), sha(bytes(r["kept_bytes"]))) for t, r in zip(rows, got)]
    assert mine == plain_removed(rows, 120)
    assert suffixdedup.remove_repeats(df.limit(0)).collect() == []


def test_suffix_dedup_sql():
    duckdb = pytest.importorskip("duckdb")
    rows = duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()
    got = duckdb.sql(queries.ORACLE["op2_suffix_dedup"].replace("FROM documents", f"FROM '{SMALL}/documents.parquet'")).fetchall()
    assert {r[0]: r[1:] for r in got} == {i: w for (i, _), w in zip(rows, plain_removed([t for _, t in rows], 400))}


def test_suffix_array():
    rng = np.random.default_rng(2)
    for t in (b"", b"a", b"aaaa", b"banana", bytes(rng.integers(97, 100, 500).astype(np.uint8)), b"\0a\0a\0"):
        assert suffixdedup.suffix_array(t, len(t) + 1).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


# ---- operator 9


def plain_links(ids, vectors, cosine):
    ok = [i for i, v in enumerate(vectors) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    edges = []
    for k, a in enumerate(ok):
        x = np.array(vectors[a], float)
        for b in ok[k + 1 :]:
            y = np.array(vectors[b], float)
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                edges.append((a, b))
    return edges


def test_vector_query(spark):
    rng = np.random.default_rng(7)
    rows = [r["embedding"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()]
    base = rng.normal(size=(60, 64))
    rows = base.tolist() + [(b + rng.normal(0, s, 64)).tolist() for b in base for s in (0.1, 0.25, 0.33)] + base[:10].tolist() + [None, [], [0.0] * 64, [float("nan")] * 64, [None] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0], [1e300] * 64, [1e-300] * 64]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        scaled = [None if v is None else v if not v or any(x is None for x in v) or not np.isfinite(v).all() or not any(v) else (np.array(v) / np.abs(v).max()).tolist() for v in rows]
    edges = plain_links(range(len(rows)), scaled, 0.95)
    for tile, recall in ((8192, 0.985), (16, 0.985), (64, 1.0)):
        got = {r["vec_id"]: r for r in vectordup.near_vectors(df, tile=tile, recall=recall).collect()}
        assert len(got) == len(rows)
        true, found = Counter(x for e in edges for x in e), {i: r["n_links"] for i, r in got.items()}
        assert all(found[i] <= true[i] for i in found)
        assert sum(found.values()) >= 0.97 * sum(true.values())
        if recall == 1:
            at = least(range(len(rows)), edges)
            assert found == {i: true[i] for i in found} and all(r["component_id"] == at[i] for i, r in got.items())
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) and r["component_id"] <= r["vec_id"] for r in got.values())
    assert vectordup.near_vectors(df.limit(0)).collect() == []


def test_codes_estimate_without_bias():
    rng = np.random.default_rng(4)
    for d in (64, 100, 384):
        x = vectordup.unit(rng.normal(size=(2000, d)))
        y = vectordup.unit(x + rng.normal(size=(2000, d)) * rng.choice([0.02, 0.05, 0.3], (2000, 1)) * 3 / np.sqrt(d) ** 0.5)
        codes = vectordup.Codes.read(vectordup.Codes.of(np.concatenate([x, y])).rows(), d)
        i = np.arange(2000)
        guess, error = codes.estimates(i, i + 2000)
        off = guess - (x * y).sum(1)
        assert abs(off.mean()) < 0.006 and (np.abs(off) <= vectordup.SPREAD * error).mean() > 0.999
        near = np.flatnonzero((x * y).sum(1) >= 0.95)
        found = {p for a, b in codes.possible(i, i + 2000, 0.95) for p in zip(a.tolist(), (b - 2000).tolist())}
        assert len(near) and len(found & set(zip(near.tolist(), near.tolist()))) >= 0.995 * len(near)
        assert len(found) < 20 * 2000  # of 4,000,000


def test_vector_recall_of_50000(spark):
    """Pairs planted at the threshold among 50,000 vectors, with the bits and tables that go with that number."""
    rng = np.random.default_rng(8)
    base = vectordup.unit(rng.normal(size=(40_000, 64)))
    other = vectordup.unit(rng.normal(size=(10_000, 64)))
    other = vectordup.unit(other - (other * base[:10_000]).sum(1, keepdims=True) * base[:10_000])
    c = rng.uniform(0.9501, 0.97, (10_000, 1))
    rows = np.concatenate([base, c * base[:10_000] + np.sqrt(1 - c * c) * other])
    assert vectordup.plan(50_000, 0.95, 0.985)[0] == 5
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(50_000), "embedding": pa.FixedSizeListArray.from_arrays(rows.ravel(), 64).cast(pa.list_(pa.float64()))}))
    got = vectordup.near_vectors(df).where("n_links > 0").collect()
    named = {r["vec_id"]: r["component_id"] for r in got}
    assert sum(named.get(40_000 + i) == i for i in range(10_000)) >= 9_800
    x = vectordup.unit(rows)
    assert all(float((x[i] * x[r]).sum()) >= 0.95 for i, r in named.items() if i != r and i - r == 40_000)


def test_vectors_from_tables_brought_near(spark):
    """The table's own vectors have no pair at the threshold: each fourth one is copied nearby."""
    sf = SMALL.replace("0.001", "0.01")
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()], float)
    x = np.concatenate([x, x[::4] + np.random.default_rng(9).normal(0, 0.02, x[::4].shape)])
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    true = (u @ u.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in vectordup.near_vectors(df).collect()}
    assert true.sum() >= 200 and sum(got.values()) >= 0.97 * true.sum() and all(got[i] <= t for i, t in enumerate(true))


# ---- operator 10


def shingles(t, size=5):
    w = "".join(c.lower() if c.isascii() else c for c in t or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def plain_near(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    at = least({r[0] for r in rows}, links)
    return {(d, len(s), at[d]) for (d, _), s in zip(rows, sets)}


def test_ngram_query(spark):
    sf = SMALL.replace("0.001", "0.01")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {tuple(r) for r in queries.op10_ngram_join(spark, sf).collect()} == plain_near(rows)


@pytest.mark.parametrize("tile", [1 << 14, 4])
def test_ngram_odd(spark, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    rng = np.random.default_rng(9)
    base = [" ".join(rng.choice([f"w{i}" for i in range(50)], n)) for n in (6, 12, 40, 90, 300)]
    rows = [None, "", " \t", "one", "One", "one two", "a b c d", "A B\nC d", "x " * 20000] + base
    for t in base:
        w = t.split()
        for k in (1, 2, 3, 5, 8):
            v = list(w)
            for p in rng.integers(0, len(v), k):
                v[p] = "new"
            rows += [" ".join(v), " ".join(w[k:]), t]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(rows)], "doc_id long, text string, n int, d1 int")
    assert {tuple(r) for r in neardup.near_duplicates(df).collect()} == plain_near(list(enumerate(rows)))
    assert neardup.near_duplicates(df.limit(0)).collect() == []


def test_columns_come_in_pieces(monkeypatch):
    """Whatever the batches, and where a column has more rows than are counted."""
    rng = np.random.default_rng(11)
    h = np.sort(rng.choice([1, 2, 3, 5, 8, 9], 400, p=[0.6, 0.1, 0.1, 0.1, 0.09, 0.01]))
    d = np.concatenate([np.sort(rng.integers(0, 150, int((h == x).sum()))) for x in np.unique(h)])
    batches = lambda size: [pa.RecordBatch.from_arrays([pa.array(h[i : i + size]), pa.array(d[i : i + size])], ["h", "d1"]) for i in range(0, 400, size)]
    rows = Counter(x for x, _ in set(zip(h.tolist(), d.tolist())))
    for counted in (1 << 22, 10):
        monkeypatch.setattr(neardup, "COUNTED", counted)
        for size in (1, 7, 400):
            got = [tuple(r.values()) for b in neardup._shared(batches(size)) for r in b.to_pylist()]
            assert [g[:2] for g in got] == sorted({x for x in zip(h.tolist(), d.tolist()) if rows[x[0]] > 1})
            if counted > 400:
                assert all(n == rows[x] for x, _, n in got)
            assert len({(x, n) for x, _, n in got}) == len({x for x, _, _ in got})  # one number a column
    for most in (1, 50, 1000):
        parts = list(neardup._columns_of(iter(batches(7)), 1, most))
        assert sum(map(len, parts)) == 400 and not any(set(a.column(0).to_pylist()) & set(b.column(0).to_pylist()) for a, b in zip(parts, parts[1:]))


def test_skew_join(spark):
    many = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id % 50) as k", "id").union(spark.createDataFrame([(None, 1)], "k long, id long"))
    few = many.groupBy("k").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, skew_join(many, few, ["k"], "n", ["id"]).collect())) == sorted(map(tuple, many.join(few, "k").select("k", "id", "n").collect()))
    assert skew_join(many.limit(0), few.limit(0), ["k"], "n", ["id"]).collect() == []


# ---- the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = corpus_pipeline.run(spark, SMALL)
    assert set(docs.columns) <= set(out.columns)
    got = {r["doc_id"]: r for r in out.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, SMALL)
    toxic = {r["doc_id"] for r in queries.op8_toxicity(spark, SMALL).where("score >= 0.5").collect()}
    left = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in toxic]
    left = [d for d in left if d[0] in {x[0] for x in plain_near(left) if x[0] == x[2]}]
    dirty = {r["doc_id"] for r in queries.op6_decontaminate(spark, SMALL).where("contaminated").collect()}
    assert set(got) == {d for d, _ in left if d not in dirty} == {r["doc_id"] for r in kept.collect()}
    assert all(len(r["bpe_ids"]) == r["n_tokens"] for r in got.values())
    texts = dict(left)
    plain = [i for i, r in got.items() if "@" not in texts[i] and not any(c.isdigit() for c in texts[i])]
    assert plain and all(got[i]["text"] == texts[i] for i in plain)
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (None, "", None, None, None), (3, "a@b.cc x", "en", "s", 8), (3, "a@b.cc x", "en", "s", 8)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        odd = stage(spark, odd, SMALL)
    assert {"<EMAIL> x"} <= {r["text"] for r in odd.collect()}


def test_products_of_a_block():
    rng = np.random.default_rng(8)
    for _ in range(20):
        rows = lambda: [None if rng.random() < 0.2 else sorted(set(rng.integers(-20, 20, rng.integers(0, 15)).tolist())) for _ in range(12)]
        x, y = rows(), rows()
        nx, ny, both = neardup.products(pa.array(x, pa.list_(pa.int64())), pa.array(y, pa.list_(pa.int64())))
        assert nx.tolist() == [len(a or []) for a in x] and ny.tolist() == [len(a or []) for a in y]
        assert both.tolist() == [len(set(a or []) & set(b or [])) for a, b in zip(x, y)]
        part = pa.array([*x, *y], pa.list_(pa.int64()))  # slices of one buffer
        assert neardup.products(part.slice(0, 12), part.slice(12))[2].tolist() == both.tolist()


def test_the_count_decides(spark):
    """With a mask that lets every pair through the links are the same: nothing but the accumulated counts makes them."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        words = list(base)
        for i in rng.choice(60, rng.integers(0, 5), replace=False):
            words[i] = f"x{rng.integers(0, 1000)}"
        texts.append(" ".join(words))
    texts += ["one two", "one two", "one two three", "", None]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))} if t and t.split() else set()
    sets = [shingles(t) for t in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = least(range(len(texts)), edges)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = lambda: {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    assert got() == want
    features = neardup._features(df, "doc_id", "text", 5)  # the product by itself, over all pairs of rows
    rows = features.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    pairs = rows.select(F.col("d1").alias("a")).join(rows.select(F.col("d1").alias("b")), F.col("a") < F.col("b"))
    links = {frozenset(r) for r in neardup._links(pairs, rows, df, "doc_id", "text", 5, 80).collect()}
    first = {i: min(j for j in range(len(texts)) if sets[j] == sets[i]) for i in range(len(texts)) if sets[i]}
    assert links == {frozenset((first[i], first[j])) for i, j in edges if first[i] != first[j]}
