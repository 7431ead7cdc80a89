"""A stored table of one row a key: buckets by key, of which a write replaces those that change, each whole.

    <path>/v<n>/_bucket=<b>/*.parquet     what write n made of bucket b
    <path>/manifest-<n>                   of every bucket the write that holds it

Readers take the newest manifest. A write reads the buckets that its rows fall into, merges and writes them, and keeps those alone in
which a row came out different; then it puts down the next manifest under a name that can be taken once, so that of two writers at a time one fails
and may try again on what the other left. A write that changes nothing leaves nothing. Lost executors cost their tasks, a lost
driver costs a folder that no manifest names, which `clean` removes.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.sources.shared import exists, path_of, remove, scratch, written

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer was first."""


class KeyedTable:
    """schema: the columns, `key` among them, which no row lacks; buckets: how many, fixed with the first write."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: str, buckets: int = 16):
        self.spark, self.path, self.key, self._buckets = spark, path, key, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    # ---- manifests

    def versions(self) -> list[int]:
        if not exists(self.spark, self.path):
            return []
        fs, p = path_of(self.spark, self.path)
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return sorted(int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-"))

    def manifest(self, version: int | None = None) -> dict:
        """{"buckets": how many, "at": {bucket: write}} of a version, the newest if none is named."""
        found = self.versions()
        if not found:
            return {"buckets": self._buckets, "at": {}}
        fs, p = path_of(self.spark, f"{self.path}/manifest-{found[-1] if version is None else version:08d}")
        source = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def _commit(self, version: int, manifest: dict) -> None:
        fs, p = path_of(self.spark, f"{self.path}/manifest-{version:08d}")
        try:
            out = fs.create(p, False)  # fails where the name is taken
        except Exception as e:  # noqa: BLE001  (whatever the store calls it)
            raise Conflict(f"version {version} of {self.path} is another's") from e
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    # ---- rows

    def bucket(self, count: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(count)).cast("int")

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/v{v}/{BUCKET}={b}" for b, v in sorted(manifest["at"].items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def _fields(self) -> list[str]:
        return [f"`{c}`" for c in self.schema.names]

    def write(self, rows: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> int:
        """Merges rows into the table; how many buckets changed.

        merge makes one row a key of old and new rows, which have the table's columns; it must give a row again where nothing is new to it. A key
        that it leaves out is taken from the table.
        """
        manifest = self.manifest()
        version, count = (self.versions() or [-1])[-1] + 1, manifest["buckets"]
        new = rows.select(*self._fields())
        touched = sorted(r[0] for r in new.select(self.bucket(count).alias("b")).distinct().collect())  # `buckets` at most
        if not touched:
            return 0
        old = self._rows(manifest, touched)
        at = f"{self.path}/v{version}"
        merge(old.unionByName(new)).select(*self._fields()).withColumn(BUCKET, self.bucket(count)).write.option("compression", "zstd").partitionBy(BUCKET).parquet(at)
        fs, p = path_of(self.spark, at)
        filled = {int(n.partition("=")[2]) for n in (f.getPath().getName() for f in fs.listStatus(p)) if n.startswith(f"{BUCKET}=")}
        was, now = self._digests(old, count), self._digests(self._rows({"at": {str(b): version for b in filled}}), count)
        changed = sorted(b for b in was.keys() | now.keys() if was.get(b) != now.get(b))
        for b in filled.difference(changed):
            remove(self.spark, f"{at}/{BUCKET}={b}")
        if changed:
            left = {b: v for b, v in manifest["at"].items() if int(b) not in changed}
            self._commit(version, {"buckets": count, "at": left | {str(b): version for b in changed if b in filled}})
        else:
            remove(self.spark, at)
        return len(changed)

    def _digests(self, rows: DataFrame, count: int) -> dict[int, tuple]:
        """Of every bucket how many rows it has and what their digests come to in any order: one row a bucket is all that is shuffled."""
        row = F.to_json(F.struct(*self._fields()), {"ignoreNullFields": "false"})
        digest = rows.select(self.bucket(count).alias("b"), F.xxhash64(row).alias("d"), F.xxhash64(row, F.lit(1)).alias("e"))
        sums = digest.groupBy("b").agg(F.count("*"), F.sum(F.col("d").cast("decimal(20,0)")), F.bit_xor("d"), F.bit_xor("e"))
        return {r[0]: tuple(r)[1:] for r in sums.collect()}  # `buckets` at most

    def find(self, keys: DataFrame) -> DataFrame:
        """The table's rows of the keys in a column of the table's key's name: only buckets that hold one are read."""
        asked = keys.select(F.col(f"`{self.key}`")).distinct()
        return self.near(asked).join(asked, self.key, "left_semi")

    def near(self, keys: DataFrame) -> DataFrame:
        """The rows of all buckets that hold one of the keys."""
        manifest = self.manifest()
        touched = [r[0] for r in keys.select(self.bucket(manifest["buckets"]).alias("b")).distinct().collect()] if manifest["at"] else []
        return self._rows(manifest, touched)

    def clean(self, keep: int = 1) -> None:
        """Drops all but the newest `keep` manifests, and the buckets that none of those names."""
        found = self.versions()
        for v in found[:-keep]:
            remove(self.spark, f"{self.path}/manifest-{v:08d}")
        held = {(int(v), int(b)) for n in found[-keep:] for b, v in self.manifest(n)["at"].items()}
        fs, p = path_of(self.spark, self.path)
        for f in list(fs.listStatus(p)):
            name = f.getPath().getName()
            if name.startswith("_merging-"):
                remove(self.spark, f"{self.path}/{name}")
            elif name.startswith("v"):
                kept = 0
                for b in list(fs.listStatus(f.getPath())):
                    at = b.getPath().getName()
                    if at.startswith(f"{BUCKET}=") and (int(name[1:]), int(at.partition("=")[2])) in held:
                        kept += 1
                    elif at.startswith(f"{BUCKET}="):
                        remove(self.spark, f"{self.path}/{name}/{at}")
                if not kept:
                    remove(self.spark, f"{self.path}/{name}")


class ResultCache:
    """What providers said, by question: an answer, or that there is none, until it expires.

    A question is a namespace and its parts, trimmed and in lower case. Each namespace keeps answers for its own time.
    """

    #: Days that answers of lookups and of verifications hold.
    DAYS = {"lookup": 90, "verify": 30}
    SCHEMA = "key string, namespace string, answer string, asked_at timestamp, expires_at timestamp"

    def __init__(self, spark: SparkSession, path: str, days: dict[str, int] | None = None, buckets: int = 16):
        self.days = days or self.DAYS
        self.table = KeyedTable(spark, path, self.SCHEMA, "key", buckets)

    @staticmethod
    def key(namespace: Column, *parts: Column) -> Column:
        """A key that no other question has: the parts stand apart, and a null part is an empty one."""
        text = [F.lower(F.trim(F.coalesce(p.cast("string"), F.lit("")))) for p in parts]
        return F.concat(namespace, F.lit(":"), F.substring(F.sha2(F.concat_ws("|", *text), 256), 1, 32))

    def ask(self, questions: DataFrame, now: Column) -> DataFrame:
        """questions (with `key`) and hit, answer: a known answer that holds at `now`; an empty answer is a hit without one."""
        known = self.table.near(questions).where(F.col("expires_at") > now).select("key", "answer", F.lit(True).alias("hit"))
        return questions.hint("merge").join(known, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

    def keep(self, answers: DataFrame, now: Column) -> int:
        """Stores answers (key, namespace, answer, null where there is none) as of now; the newest answer of a key counts."""
        days = F.create_map(*[F.lit(x) for kv in self.days.items() for x in kv])
        rows = answers.select("key", "namespace", "answer", now.cast("timestamp").alias("asked_at"), (now.cast("timestamp") + F.make_dt_interval(days=F.element_at(days, F.col("namespace")))).alias("expires_at"))
        newest = lambda both: both.groupBy("key").agg(F.max(F.struct("asked_at", "answer", "namespace", "expires_at")).alias("x")).select("key", "x.*")
        return self.table.write(rows, newest)

    def compact(self, now: Column) -> int:
        """Drops expired answers from the buckets that hold one; how many changed."""
        old = self.table.read().where(F.col("expires_at") <= now)
        return self.table.write(old, lambda both: both.where(F.col("expires_at") > now).dropDuplicates(["key"]))

    def through(self, questions: DataFrame, now: Column, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """questions (key, namespace, ...) with hit and answer: those without a known answer go to `answer`, each question once, which gives (key, answer)
        or nothing; what it gives, nothing too, is kept."""
        at = scratch(self.table.spark)
        first = F.row_number().over(Window.partitionBy("key").orderBy("hit")) == 1  # of the rows of a question, which come to one task for `ask` already
        asked = self.ask(questions, now).withColumn("_first", first).persist(StorageLevel.DISK_ONLY)
        try:
            asked.count()  # from here on what it is dealt by is known, and neither a question nor its answer is dealt again
            new = answer(asked.where("_first AND NOT hit").drop("hit", "answer", "_first")).select("key", F.col("answer").alias("_new"))
            said = F.when(F.col("hit"), F.col("answer")).otherwise(F.col("_new"))
            out = written(asked.hint("merge").join(new, "key", "left").withColumn("answer", said).drop("_new"), at)
        finally:
            asked.unpersist()
        self.keep(out.where("_first AND NOT hit"), now)
        return out.drop("_first")
