"""What a run asks of the driver: it holds every job, plan and thread of a step, so links that crowd no node cost few of them."""

from __future__ import annotations

import numpy as np
import pytest

from leadline.llm import common, neardup
from leadline.llm.common import components


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_stars_take_no_rounds(spark):
    df = spark.createDataFrame([(10 * i, 10 * i + j) for i in range(50) for j in (1, 2, 3)], "u long, v long").coalesce(1)
    got, n = jobs(spark, "stars", lambda: {r["node"]: r["component"] for r in components(df).collect()})
    assert got == {10 * i + j: 10 * i for i in range(50) for j in range(4)}
    assert n <= 12  # 23 before, most of them in a round that changes nothing


def test_rounds_of_paths_take_few_jobs(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long").repartition(4)
    got, n = jobs(spark, "paths", lambda: {r["node"]: r["component"] for r in components(df).collect()})
    assert got == dict.fromkeys(range(201), 0)
    assert n <= 80  # 165 before


@pytest.mark.parametrize("most", [2, 10**9])
def test_crowded_or_not(spark, monkeypatch, most):
    """Split nodes and plain joins give the same components and the same links."""
    for module in (common, neardup):
        monkeypatch.setattr(module, "crowded", lambda total: most)
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000, 1000 + i) for i in range(300)] + [(1300, 1301 + i) for i in range(20)]
    low = {n: n for e in edges for n in e}
    for _ in low:
        new = dict(low)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == low:
            break
        low = new
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}
    assert got == {n: low[n] for e in edges if e[0] != e[1] for n in e}
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(words + [f"own{i}"])) for i in range(30)] + [(100 + i, " ".join(f"x{i}y{j}" for j in range(20))) for i in range(5)]
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert found == {i: 0 for i in range(30)} | {100 + i: 100 + i for i in range(5)}
