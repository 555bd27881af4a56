"""Operators with state: a cache of requests with a time to live, and candidates that wait for their group's gate.

Both take rows in the order of their times within a key, so the same rows give the same result in whatever micro-batches
they arrive in order. Rows behind the watermark are dropped, as streams do, and so are times up to 1970-01-01, where it begins; a key's rows
of one micro-batch are held together.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from millrace.operators.relational import ARTICLES, PRIORITY
from millrace.sources.pages import TTL

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def stateful(spark: SparkSession):
    """Queries that start in here keep their state in RocksDB, which these operators need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def appended(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stateful stream's rows to files until all that is there is done."""
    with stateful(rows.sparkSession):
        return rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def micros(at: str) -> Column:
    """A time's microseconds, of whatever kind of timestamp, that order and subtract as it does."""
    return F.unix_micros(F.col(at).cast("timestamp"))


# --- cache with a time to live ---------------------------------------------------------------------------

CACHED = "key string, id long, hit boolean"


class Cache(StatefulProcessor):
    """State: when a key was fetched last. It goes when a timer finds it past its time."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.fetched = handle, handle.getValueState("fetched", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        asked = pd.concat(list(rows)).sort_values(["micros", "id"], kind="stable")
        held = self.fetched.get()
        first = last = held[0] if held else None
        hits = []
        for at in asked["micros"].tolist():
            hits.append(last is not None and at < last + self.ttl)
            last = last if hits[-1] else at
        if last != first:
            self.fetched.update((last,))
            self.handle.registerTimer((last + self.ttl) // 1000 + 1)
        yield pd.DataFrame({"key": [key[0]] * len(asked), "id": asked["id"].to_numpy(), "hit": hits})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.fetched.get()
        if held and (held[0] + self.ttl) // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.fetched.clear()
        return iter(())

    def close(self) -> None:
        pass


def cached(requests: DataFrame, ttl: int = TTL, late: str = "10 minutes") -> DataFrame:
    """``(key, id, hit)`` of a stream ``requests (key, id, at)``: whether a page fetched for the key less than ``ttl`` seconds before answers; else it is fetched then."""
    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.col("at").cast("timestamp").alias("at"))
    rows = rows.withColumn("micros", micros("at")).withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(Cache(ttl), CACHED, "Append", "EventTime")


# --- candidates that wait for their gate -----------------------------------------------------------------

ISSUE = "grp string, issue long, n_articles long, max_score int, ids array<long>, expired boolean"


class Gate(StatefulProcessor):
    """State: a group's candidates and how many issues it had. Whatever waits longer than ``patience`` seconds is given out as expired."""

    def __init__(self, articles: int, priority: int, patience: int | None) -> None:
        self.articles, self.priority, self.patience = articles, priority, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.issues = handle.getListState("waiting", "id long, score int, at long"), handle.getValueState("issues", "n long")

    def _issue(self, key: tuple, number: int, held: list[tuple], expired: bool) -> tuple:
        scores = [s for _, s, _ in held if s is not None]
        return key[0], number, len(held), max(scores, default=None), [i for i, _, _ in held], expired

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values(["micros", "id"], kind="stable")
        held = [tuple(w) for w in self.waiting.get()]
        number, out, before = (self.issues.get() or (0,))[0], [], len(held)
        for i, score, at in zip(new["id"].tolist(), new["score"].tolist(), new["micros"].tolist(), strict=True):
            held.append((i, None if pd.isna(score) else int(score), at))
            if len(held) > self.articles or (held[-1][1] is not None and held[-1][1] >= self.priority):
                number += 1
                out.append(self._issue(key, number, held, False))
                held = []
        if out:
            self.issues.update((number,))
            self.waiting.clear()
        if held and (out or len(held) > before):
            self.waiting.put(held)
            if self.patience and (out or not before):
                self.handle.registerTimer(held[0][2] // 1000 + self.patience * 1000)
        yield pd.DataFrame(out, columns=["grp", "issue", "n_articles", "max_score", "ids", "expired"]).astype({"max_score": "Int32"})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(w) for w in self.waiting.get()]
        if held and held[0][2] // 1000 + self.patience * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            number = (self.issues.get() or (0,))[0] + 1
            self.issues.update((number,))
            self.waiting.clear()
            yield pd.DataFrame([self._issue(key, number, held, True)], columns=["grp", "issue", "n_articles", "max_score", "ids", "expired"]).astype({"max_score": "Int32"})

    def close(self) -> None:
        pass


def issues(scored: DataFrame, articles: int = ARTICLES, priority: int = PRIORITY, patience: int | None = None, late: str = "10 minutes") -> DataFrame:
    """Issues of each group of a stream ``scored (grp, id, score, at)``: candidates wait, in the order of their times, until there are more than
    ``articles`` or one scores ``priority``; all that wait make the issue. A row without score counts but opens nothing."""
    rows = scored.select(F.col("grp").cast("string").alias("grp"), F.col("id").cast("long").alias("id"), F.col("score").cast("int").alias("score"), F.col("at").cast("timestamp").alias("at"))
    rows = rows.withColumn("micros", micros("at")).withWatermark("at", late)
    return rows.groupBy("grp").transformWithStateInPandas(Gate(articles, priority, patience), ISSUE, "Append", "EventTime")
