"""What several operators share: tables, checkpoints, word splitting, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: UTF-8 bytes after lower-casing A-Z: word characters are 0-9, a-z and all non-ASCII bytes.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: As ALNUM, but only space and \t \n \v \f \r part words.
SPACED = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 11, 12, 13, 32) else c for c in range(256))


#: Rows and bytes that go to a Python worker at once: texts and column lists are long, and a batch is held on both sides.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name. A session that has Spark's own sizes of Arrow batches gets smaller ones."""
    for key, (own, ours) in BATCHES.items():
        if spark.conf.get(key, None) == own:
            spark.conf.set(key, ours)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where none is named a temporary one, on a local master alone."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leadline-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get()
    return named.rstrip("/")


class Workspace:
    """A folder of its own for what a run writes on its way, in this thread: everything materialized inside goes when it ends.

    What is materialized outside of any workspace lies in the session's folder, which goes with the session's JVM.
    """

    _held: ContextVar[str | None] = ContextVar("workspace", default=None)

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}-run"

    def __enter__(self) -> Workspace:
        self._token = self._held.set(self.path)
        return self

    def __exit__(self, *_) -> None:
        self._held.reset(self._token)
        drop(self.spark, self.path)

    @classmethod
    def folder(cls, spark: SparkSession) -> str:
        if held := cls._held.get():
            return held
        path = f"{checkpoint_dir(spark)}/session-{spark.sparkContext.applicationId}"
        fs, p = _path(spark, path)
        if not fs.exists(p):
            fs.mkdirs(p)
            fs.deleteOnExit(p)
        return path


def materialize(df: DataFrame) -> DataFrame:
    """Written once to the shared folder and read back: later steps neither recompute nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{Workspace.folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def drop(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def by_place(df: DataFrame, made: Sequence[str], run: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """run(frame, names) on df under the names c0, c1, ..., and its result under df's own names again.

    The names handed to run are those of df's columns in the frame. Columns of df that are named as one of `made` don't reach
    the result: run adds those. So a column may have any name, dots, blanks and clashes included.
    """
    inner = [f"c{i}" for i in range(len(df.columns))]
    out = run(df.select(*[F.col(f"`{c.replace('`', '``')}`").alias(i) for c, i in zip(df.columns, inner)]), inner)
    return out.select(*[F.col(i).alias(c) for c, i in zip(df.columns, inner) if c not in made], *made)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow over one batch at a time."""

    def run(batches):
        for b in batches:
            yield from f(b)

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives memory that was freed back to the system: worker processes outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: What operators keep in a worker process between their tasks, by operator, and how it is dropped.
CACHES: dict[str, Callable[[], None]] = {}
_LAST: list[str | None] = [None]


def forget(keeps: str | None) -> None:
    """Drops what other operators keep in this worker process, when the operator at work changes."""
    if _LAST[0] != keeps:
        for name, drop_ in CACHES.items():
            if name != keeps:
                drop_()
        _LAST[0] = keeps
        release()


def tidied(run: Callable, keeps: str | None = None) -> Callable:
    """run, with the caches of other operators than `keeps` dropped before it, and what it freed given back at its end."""

    def wrapped(batches):
        from leadline.llm import common  # the worker's own module, not a copy that came with this function

        common.forget(keeps)
        yield from run(batches)
        common.release()

    return wrapped


def slices(sizes: np.ndarray, most: int, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Ranges of at most `rows` rows whose sizes sum to at most `most`; a larger row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (total + n > most or i - start >= rows):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def byte_sizes(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def words(text: str | None, kind: bytes = ALNUM) -> list[bytes]:
    """Lower-cased words as UTF-8 bytes; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(kind).split() if text else []


def crowded(total: int) -> int:
    """Rows of one key beyond which a join of so many rows splits it. At most 50,000 keys can hold so much, which bounds what is broadcast."""
    return max(256, total // 50_000)


def skew_join(many: DataFrame, few: DataFrame, on: list[str], rows: str, spread: list[str], total: int | None = None, counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """many joined with few on `on`; few has one row a key, whose column `rows` says how many rows of many hold it, or `counts` has that column.

    Keys of more rows than a share of the total are split by a hash of the columns `spread` of many: a task gets at most about
    that share of one key.
    """
    told = few if counts is None else counts
    if total is None:
        total = told.agg(F.coalesce(F.sum(rows), F.lit(0))).head()[0]
    most = crowded(total)
    salts = F.ceil(F.col(rows) / most).cast("int")
    hot = F.broadcast(told.where(F.col(rows) > most).select(*on, salts.alias("_salts")))
    if counts is None:
        few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(rows) > most, salts - 1).otherwise(0))))
    else:
        few = few.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    many = many.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    return many.join(few, [*on, "_salt"], how).drop("_salt")


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to its component's least node, over these edges alone."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, low[a], least)
        np.minimum.at(new, low[b], least)
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    has = low != np.arange(len(nodes))
    return nodes[has], nodes[low[has]]


def _local(edges: DataFrame) -> DataFrame:
    """Each partition's edges reduced to a forest; edges of up to `held` at a time."""
    held = 1_000_000

    def run(batches):
        us, vs, n = [], [], 0
        for b in batches:
            us.append(b.column(0).to_numpy())
            vs.append(b.column(1).to_numpy())
            n += len(us[-1])
            if n > held:
                u, v = forest(np.concatenate(us), np.concatenate(vs))
                if len(u) > held // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                    us, vs, n = [], [], 0
                else:
                    us, vs, n = [u], [v], len(u)
        if n:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return edges.mapInArrow(tidied(run), "u long, v long")


def _shape(e: DataFrame) -> tuple[int, int, int]:
    """Of edges (u, v) their number, the most that meet in one node, and the nodes that keep them from being stars: those of two parents, and parents that have one."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    found = ends.agg(F.sum("up"), F.max(F.col("up") + F.col("down")), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).head()
    return found[0] or 0, found[1] or 0, found[2]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u long, v long) links to (node, component), component the least node reachable; nodes without links have no row.

    Alternating large and small stars, each a grouped minimum, until nothing changes; a partition first shrinks its own edges to a
    forest. A hub's edges are split: the minimum is joined back. Where no node has that many, both stars are one plan of two windows, as
    the driver holds every plan, stage and thread of a round. Null ends and loops count as no link.
    """
    e = materialize(_local(edges.where("u <> v").select("u", "v")).selectExpr("u", "v").where("u > v").distinct())
    for _ in range(rounds):
        size, most, loose = _shape(e)
        # a star forest: every node has one parent, and no parent has one itself
        if not loose:
            roots = e.select(F.col("v").alias("root")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("root", F.col("root").alias("component")))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if most <= crowded(2 * size):  # a node gets no more in the small star than it has in the large one
            least = F.min("v").over(Window.partitionBy("u"))
            large = both.withColumn("m", F.least("u", least)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
            small = large.withColumn("m", least)
        else:
            low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
            large = materialize(skew_join(both, low, ["u"], "n", ["v"], 2 * size).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v"))
            least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
            small = skew_join(large, least, ["u"], "n", ["v"], 2 * size)
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u > v")
        e = materialize(small.distinct())
    raise RuntimeError("components did not settle")
