"""One order over a whole table without one task: places, running totals and ranks within groups of any size.

Rows are dealt into ranges of the order (as many tasks as there are shuffle partitions), sorted within them and numbered
there; the ranges' row counts, one row a range, give each range its first place. A frame is written once between the two steps,
as the ranges of two runs would differ. Rows that tie in the whole order are told apart by where they were read, so
that a third of all rows may be equal and still spread over ranges.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadline.sources.shared import written

#: Spark numbers rows of a partition from partition << 33.
SHIFT = 33


def quoted(name: str) -> str:
    """A column's name as it is, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def _columns(order: tuple) -> list[Column]:
    return [F.col(quoted(o)) if isinstance(o, str) else o for o in order]


def ranged(df: DataFrame, *order: str | Column) -> DataFrame:
    """df, written in order, with `_at`: its range above bit 33, its place there below."""
    read = F.monotonically_increasing_id()
    rows = df.withColumn("_read", read)
    by = [*_columns(order), F.col("_read")]
    return written(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_read").withColumn("_at", F.monotonically_increasing_id()))


def numbered(df: DataFrame, *order: str | Column, name: str = "n") -> DataFrame:
    """df with each row's place in the whole order, from 1 (long). Rows that tie come in any order."""
    rows = ranged(df, *order)
    part = F.shiftright("_at", SHIFT)
    sizes = sorted(rows.groupBy(part.alias("p")).count().collect())  # one row a range
    first = dict(zip([r["p"] for r in sizes], accumulate([0] + [r["count"] for r in sizes])))
    return _with(rows, first, "long", lambda f: f + F.col("_at").bitwiseAND(F.lit((1 << SHIFT) - 1)) + 1, name)


def running(df: DataFrame, value: str, *order: str | Column, name: str = "total") -> DataFrame:
    """df with the sum of `value` over all rows up to each in the whole order (nulls add nothing); integers stay exact.

    A range's own running sums are one window over that range, which holds a bounded share of the rows.
    """
    from pyspark.sql import Window

    rows = ranged(df, *order).withColumn("_part", F.shiftright("_at", SHIFT))
    sums = sorted(rows.groupBy("_part").agg(F.coalesce(F.sum(value), F.lit(0)).alias("s")).collect())
    first = dict(zip([r["_part"] for r in sums], accumulate([0] + [r["s"] for r in sums])))
    kind = rows.select(F.sum(value).alias("s")).schema["s"].dataType
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return _with(rows.withColumn("_own", own), first, kind.simpleString(), lambda f: (f + F.col("_own")).cast(kind), name).drop("_part", "_own")


def _with(rows: DataFrame, first: dict, kind: str, value, name: str) -> DataFrame:
    if not first:
        return rows.drop("_at").withColumn(name, F.lit(None).cast(kind))
    firsts = rows.sparkSession.createDataFrame([(p, f) for p, f in first.items()], f"_p long, _first {kind}")
    kept = [quoted(c) for c in rows.columns if c not in ("_at", name)]
    return rows.join(F.broadcast(firsts), F.shiftright("_at", SHIFT) == F.col("_p")).select(*kept, value(F.col("_first")).alias(name))


def ranked_in(df: DataFrame, group: list[str], *order: str | Column, name: str = "rank") -> DataFrame:
    """df with each row's place in its group, from 1, for groups of any size: a group's rows are numbered in the order of the
    whole table (group first), less the places before its first one. Null keys are groups like others."""
    rows = written(numbered(df, *group, *order, name="_place"))
    first = rows.groupBy(*map(quoted, group)).agg(F.min("_place").alias("_begin"))
    return grouped_join(rows, first, group).withColumn(name, F.col("_place") - F.col("_begin") + 1).drop("_place", "_begin")


def grouped_join(rows: DataFrame, groups: DataFrame, keys: list[str], spread: str = "_place", hot: int = 1 << 20, how: str = "inner") -> DataFrame:
    """rows with the columns of their group (one row a group, null-safe keys); groups of more than `hot` rows are split by `spread`.

    At most one group in `hot` rows can be that large, which bounds what is broadcast.
    """
    big = rows.groupBy(*map(quoted, keys)).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).withColumn("_salts", F.ceil(F.col("_n") / hot).cast("int")).drop("_n")
    on = big.toDF(*[f"_g{i}" for i in range(len(keys))], "_salts")
    meet = lambda df: [df[quoted(k)].eqNullSafe(on[f"_g{i}"]) for i, k in enumerate(keys)]
    left = rows.join(F.broadcast(on), meet(rows), "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1))).cast("int")).select(*map(quoted, rows.columns), "_salt")
    right = groups.join(F.broadcast(on), meet(groups), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).select(*map(quoted, groups.columns), "_salt")
    right = right.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)} | {"_salt": "_s"})
    out = left.join(right, [left[quoted(k)].eqNullSafe(right[f"_k{i}"]) for i, k in enumerate(keys)] + [left["_salt"] == right["_s"]], how)
    return out.select(*map(quoted, rows.columns), *[quoted(c) for c in groups.columns if c not in keys])
