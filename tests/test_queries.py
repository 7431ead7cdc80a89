"""Every registered query that has SQL gives that SQL's rows."""

from __future__ import annotations

import datetime
import math

import pytest

from leadline import functions as fn
from leadline import plans, streaming

SMALL = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_rows(spark, duck, name):
    df = plans.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    want = duck.execute(plans.ORACLE[name])
    names = [x[0] for x in want.description]
    rows = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in want.fetchall()), key=str)
    assert sorted(names) == cols
    assert got == rows and rows


def test_functions(spark):
    from pyspark.sql import functions as F

    rows = [("https://www.Acme.com/team?x=1", "acme.com"), ("a@B.org", "b.org"), (" http://u:p@x.net:80. ", "x.net"), ("WWW.x.org.", "x.org"), ("http://x.net#a@b", "x.net"), ("x.net?q=a/b", "x.net"), ("", None), ("https://", None), (None, None)]
    got = spark.createDataFrame([(a,) for a, _ in rows], "c string").select(fn.normalize_domain(F.col("c"))).collect()
    assert [r[0] for r in got] == [b for _, b in rows]
    slugs = [("The Näme Co.", "name"), ("Łódź Straße ﬁn", "odz-strae-fin"), ("Acme Consulting, LLC", "acme-consulting"), ("Group & Co", "group-and-co"), ("ＡＢ１ ½", "ab1-12"), ("漢字", None), (None, None)]
    got = spark.createDataFrame([(a,) for a, _ in slugs], "c string").select(fn.slug_name(F.regexp_replace("c", "&", "and"))).collect()
    assert [r[0] for r in got] == [b for _, b in slugs]
    one = spark.createDataFrame([("+1 (5) 6", "The Acme Co. Ltd", "sales.eu")], "p string, n string, l string")
    r = one.select(fn.normalize_phone(F.col("p")), fn.slug_name(F.col("n")), fn.is_role(F.col("l"))).head()
    assert tuple(r) == ("+156", "acme", True)


def test_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    assert streaming.replay(events, 5).where("event_id <= 5").count() == 0
