"""Keys in hash buckets: a log of upserts that is folded as it grows, and filters that tell which keys can't be known."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.operators import relational as R
from millrace.sources.claims import Claims


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


@dataclass
class KeyedLog:
    """Upserts of rows by ``key``; of rows that share one the newest by ``newest`` counts, ties as in :func:`relational.latest`.

    Each append adds files by hash bucket and claims the next number of the log. After ``every`` appends the newest rows of all keys are
    written as one version, which claims a number in the same way: a read takes the last version and what was added after it, at most some
    ``every`` appends, however long the history. A writer that loses a number takes the next; files without a claim are never read.
    """

    spark: SparkSession
    root: str
    ddl: str
    key: str
    newest: str
    buckets: int = 16
    every: int = 8

    @property
    def log(self) -> Claims:
        return Claims(self.spark, f"{self.root}/log")

    def _written(self, rows: DataFrame) -> tuple[str, int]:
        name, seen = uuid.uuid4().hex, Observation()
        own = rows.withColumn("bucket", bucket_of(F.col(self.key), self.buckets)).observe(seen, F.count(F.lit(1)).alias("n"))
        own.repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{name}")
        return name, seen.get["n"]

    def _claim(self, text: str) -> int:
        number = max(self.log.numbers(), default=0) + 1
        while not self.log.claim(str(number), text):
            number += 1
        return number

    def parts(self) -> tuple[list[str], int, int]:
        """Folders to read, how many of them are appends, and the last number they cover."""
        numbers = self.log.numbers()
        last, found, floor = max(numbers, default=0), [], 0
        for n in reversed(numbers):
            if n <= floor:
                break
            kind, name, *upto = self.log.text(str(n)).split()
            if kind == "fold":
                if int(upto[0]) > floor:
                    floor = int(upto[0])
                    base = name
            else:
                found.append((n, name))
        added = [name for n, name in found if n > floor]
        return ([base] if floor else []) + added, len(added), last

    def append(self, rows: DataFrame) -> int:
        """Adds rows and says how many; folds the log when it is time."""
        schema = _empty(self.spark, self.ddl).schema
        own = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        name, n = self._written(own)
        self._claim(f"add {name}")
        if self.parts()[1] >= self.every:
            self.fold()
        return n

    def fold(self) -> None:
        """Writes the newest rows of all keys as a version that stands for all that is in the log now."""
        folders, _, last = self.parts()
        name, _ = self._written(self._latest(folders))
        self._claim(f"fold {name} {last}")

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return _empty(self.spark, f"{self.ddl}, bucket int")
        paths = [f"{self.root}/data/{f}" for f in folders]
        # Each folder is its own table, so that its partitions are found; a folder without rows has none.
        read = [self.spark.read.schema(f"{self.ddl}, bucket int").parquet(p) for p in paths]
        return read[0] if len(read) == 1 else _union(read)

    def _latest(self, folders: list[str]) -> DataFrame:
        return R.latest(self._rows(folders).drop("bucket"), self.key, F.col(self.newest))

    def read(self) -> DataFrame:
        """The newest row of each key."""
        return self._latest(self.parts()[0])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@dataclass
class Filters:
    """Bloom filters of keys, one a hash bucket, as rows of 64 bits: ``(bucket, word, bits)``.

    Keys are added as rows of their own and met by ``bit_or`` when read, so nothing is rewritten. ``words`` of 64 bits a bucket; at ten
    bits a key about one key of a hundred that isn't there passes.
    """

    spark: SparkSession
    root: str
    buckets: int = 16
    words: int = 4096
    hashes: int = 5

    def _bits(self, keys: DataFrame, key: str) -> DataFrame:
        places = F.array(*[F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(self.words * 64)) for i in range(self.hashes)])
        rows = keys.select(F.col(key).alias("key"), bucket_of(F.col(key), self.buckets).alias("bucket"), F.explode(F.array_distinct(places)).alias("place"))
        return rows.select("key", "bucket", F.expr("cast(place div 64 as int)").alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit"))

    def add(self, keys: DataFrame, key: str) -> None:
        rows = self._bits(keys.where(F.col(key).isNotNull()), key).groupBy("bucket", "word").agg(F.bit_or("bit").alias("bits"))
        rows.repartition(self.buckets, "bucket").write.mode("append").partitionBy("bucket").parquet(self.root)

    def maybe(self, keys: DataFrame, key: str) -> DataFrame:
        """``(key, bucket)`` of the distinct keys that may be known; all others surely aren't."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return _empty(self.spark, "key string, bucket int")
        filters = self.spark.read.schema("word int, bits long, bucket int").parquet(self.root)
        asked = self._bits(keys.select(key).where(F.col(key).isNotNull()).distinct(), key)
        held = filters.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
        met = asked.join(held, ["bucket", "word"], "left").groupBy("key", "bucket")
        return met.agg(F.min(F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))).alias("all")).where("all").select("key", "bucket")


def unknown(rows: DataFrame, filters: Filters, known: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key isn't in ``known (key, bucket)``, a table laid out by bucket.

    Keys that a filter rules out are new at once; for the others only their buckets of ``known`` are read, and of these the key alone.
    """
    maybe = filters.maybe(rows, key)
    touched = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]  # at most a number a bucket
    own = known.where(F.col("bucket").isin(touched)).select(F.col(key).alias("key"))
    there = own.join(maybe.select("key"), "key", "left_semi").distinct().withColumnRenamed("key", key)
    return rows.join(there, key, "left_anti")
