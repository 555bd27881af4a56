"""Crawling with limits a host, as a stage over any number of requests and as a data source over a few.

All requests of a host meet in one task, which asks it for at most so many pages at a time and starts them at a given rate; hosts don't
wait for each other. A host with most of the requests takes as long as its limit says, on any number of machines; nothing is dropped.
"""

from __future__ import annotations

import asyncio
import importlib
import json
import time
from collections import Counter, defaultdict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition

from millrace.sources import catalog
from millrace.sources.pages import CONCURRENCY, PAGE, Fetcher

PAGE_ARROW = pa.schema([("key", pa.string()), ("url", pa.string()), ("html", pa.string()), ("status", pa.int32()), ("error", pa.string())])
#: Requests a task holds at a time, and pages that leave it together.
WINDOW, CHUNK = 256, 32


@dataclass(frozen=True)
class Limits:
    """What a host is asked for: ``at_once`` requests at a time, ``rate`` starts a second (None: any) after ``burst`` at once; a task has ``in_task`` under way."""

    at_once: int = 2
    rate: float | None = None
    burst: int = 1
    in_task: int = 4


class Gate:
    """One host's turns: a token bucket behind a number of slots. Tokens may be owed; who owes them waits."""

    def __init__(self, limits: Limits) -> None:
        self.limits, self.slots = limits, asyncio.Semaphore(limits.at_once)
        self.tokens, self.at = float(limits.burst), time.monotonic()

    async def turn(self) -> None:
        if not self.limits.rate:
            return
        now = time.monotonic()
        held = min(self.limits.burst, self.tokens + (now - self.at) * self.limits.rate)
        self.tokens, self.at = held - 1, now
        await asyncio.sleep(max(0.0, (1 - held) / self.limits.rate))


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def host(url: Column) -> Column:
    """An address's host in lower case, without user and port; empty without one."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?(\[[^\]/?#]*\]|[^:/?#]*)", 1))


def asked(requests: Iterator[dict], fetcher: Fetcher, limits: Limits) -> Iterator[list[tuple]]:
    """Rows of PAGE for requests (key, url, method, body), a few at a time, as they are answered."""
    loop, gates, pending, done = asyncio.new_event_loop(), {}, set(), []

    async def one(r: dict) -> tuple:
        gate = gates.get(name := host_of(r["url"])) or gates.setdefault(name, Gate(limits))
        async with gate.slots:
            await gate.turn()
            html, status, error = await loop.run_in_executor(pool, fetcher.one, r["url"], r.get("method"), r.get("body"))
        return r.get("key") or r["url"], r["url"], html, status, error

    def wait(most: int) -> None:
        while len(pending) > most:
            over, _ = loop.run_until_complete(asyncio.wait(pending, return_when=asyncio.FIRST_COMPLETED))
            pending.difference_update(over)
            done.extend(t.result() for t in over)

    with ThreadPoolExecutor(limits.in_task) as pool:
        try:
            for r in requests:
                pending.add(loop.create_task(one(r)))
                wait(WINDOW - 1)
                if len(done) >= CHUNK:
                    yield done
                    done = []
            wait(0)
        finally:
            loop.close()
    if done:
        yield done


def _batch(rows: list[tuple], schema: pa.Schema = PAGE_ARROW) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def fetch_by_host(requests: DataFrame, fetcher: Fetcher, limits: Limits = Limits(), tasks: int = CONCURRENCY) -> DataFrame:  # noqa: B008
    """Pages of ``requests`` (key, url, method, body; key may be missing), each host from one of ``tasks`` tasks; store the result before parsing.

    In a task requests come in an order that mixes hosts, so that one host's line doesn't hold up the others.
    """
    named = requests if "key" in requests.columns else requests.withColumn("key", F.col("url"))
    held = named.select("key", "url", "method", "body", host(F.col("url")).alias("host"), F.xxhash64("url", "key").alias("mix"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in asked((r for b in batches for r in b.to_pylist()), fetcher, limits):
            yield _batch(rows)

    return held.repartition(tasks, "host").sortWithinPartitions("mix").mapInArrow(run, PAGE)


# --- data source ----------------------------------------------------------------------------------------

SOURCE = "millrace_pages"
#: Requests that the source plans at most; more than a catalogue of boards goes through :func:`fetch_by_host`.
MOST = 10_000
_SOURCE_ARROW = pa.schema([("target_id", pa.string()), *PAGE_ARROW])


@dataclass
class Hosts(InputPartition):
    """The requests of some hosts."""

    requests: list[dict] = field(default_factory=list)


class PageReader(DataSourceReader):
    """Plans a partition for some hosts' requests and reads pages under the hosts' limits; filters on the board or address drop requests before."""

    def __init__(self, options: dict) -> None:
        self.requests = json.loads(options["requests"]) if "requests" in options else [
            {"target_id": r[2], "key": r[2], "url": r[4], "method": "GET", "body": None} for r in catalog.target_rows() if r[8]
        ]
        module, _, name = options.get("fetcher", "millrace.sources.pages:Fetcher").partition(":")
        made = getattr(importlib.import_module(module), name)
        self.fetcher = made() if isinstance(made, type) else made
        self.limits, self.tasks = Limits(**json.loads(options.get("limits", "{}"))), int(options.get("tasks", CONCURRENCY))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            at = f.attribute[0] if len(f.attribute) == 1 and f.attribute[0] in ("target_id", "url") else None
            if at and isinstance(f, (EqualTo, EqualNullSafe)):
                self.requests = [r for r in self.requests if r[at] == f.value]
            elif at and isinstance(f, In):
                self.requests = [r for r in self.requests if r[at] in f.value]
            else:
                yield f

    def partitions(self) -> list[Hosts]:
        if len(self.requests) > MOST:
            raise ValueError(f"{len(self.requests)} requests are too many for a data source; use fetch_by_host")
        own = defaultdict(list)
        for r in self.requests:
            own[host_of(r["url"])].append(r)
        parts, load = [Hosts() for _ in range(max(1, min(self.tasks, len(own))))], Counter()
        for name in sorted(own, key=lambda h: (-len(own[h]), h)):
            to = min(range(len(parts)), key=lambda i: (load[i], i))
            parts[to].requests += own[name]
            load[to] += len(own[name])
        return parts

    def read(self, partition: Hosts) -> Iterator[pa.RecordBatch]:
        boards = {(r.get("key") or r["url"], r["url"]): r["target_id"] for r in partition.requests}
        for rows in asked(iter(partition.requests), self.fetcher, self.limits):
            yield _batch([(boards[r[0], r[1]], *r) for r in rows], _SOURCE_ARROW)


class PageSource(DataSource):
    """``spark.read.format("millrace_pages")``: pages of requests as they are read.

    Options: ``requests``, JSON of rows (target_id, key, url, method, body), else the enabled boards' lists; ``fetcher``, "module:name" of
    a Fetcher or of what makes one; ``limits``, JSON of :class:`Limits`; ``tasks``.
    """

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return f"target_id string, {PAGE}"

    def reader(self, schema: object) -> PageReader:
        return PageReader(self.options)


def read_pages(spark: SparkSession, requests: DataFrame | None = None, fetcher: str | None = None, limits: Limits | None = None, tasks: int = CONCURRENCY) -> DataFrame:
    """:class:`PageSource` over at most ``MOST`` requests (target_id, key, url, method, body)."""
    spark.dataSource.register(PageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(SOURCE).option("tasks", tasks).option("limits", json.dumps(asdict(limits or Limits())))
    if fetcher:
        reader = reader.option("fetcher", fetcher)
    if requests is not None:
        rows = requests.select("target_id", "key", "url", "method", "body").limit(MOST + 1).collect()
        reader = reader.option("requests", json.dumps([r.asDict() for r in rows]))
    return reader.load()
