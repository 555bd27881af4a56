"""One run from pages to an issue: list, keep what is new, read details, analyse, gate, render, save."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import extract
from millrace.operators import relational as R
from millrace.plans import render
from millrace.sources import catalog, pages
from millrace.sources.calls import CallLedger
from millrace.sources.store import Store


class Analyst(Protocol):
    """What a model says about articles; runs in executors, so it must survive pickling."""

    def tags(self, title: str, content: str, known: list[str]) -> list[str]: ...
    def image_context(self, title: str, content: str) -> str | None: ...
    def score(self, title: str, content: str, tags: list[str]) -> int: ...


class Writer(Protocol):
    """Writes an issue from its articles, on the driver."""

    def write(self, articles: list[dict]) -> tuple[str, str]: ...


@dataclass(frozen=True)
class KeywordAnalyst:
    """A deterministic stand-in: tags are the keywords in a text, the score counts them."""

    keywords: dict[str, int] = field(default_factory=dict)

    def tags(self, title: str, content: str, known: list[str]) -> list[str]:
        return sorted(k for k in {*self.keywords, *known} if k in f"{title} {content}")

    def image_context(self, title: str, content: str) -> str | None:
        return None

    def score(self, title: str, content: str, tags: list[str]) -> int:
        return min(10, 1 + sum(self.keywords.get(t, 0) for t in tags))


ANALYSIS = "detail_url string, tags array<string>, image_context string, score int, analysed_at timestamp"


#: Tries of one model call, and of an article's whole chain of calls.
CALLS, ATTEMPTS = 5, 3


def tried(times: int, pause: float, f: Callable, *args: object) -> object:
    """``f(*args)``, tried again after growing pauses; its last failure stands."""
    for turn in range(times - 1):
        try:
            return f(*args)
        except Exception:
            time.sleep(pause * (turn + 1))
    return f(*args)


def analyse(articles: DataFrame, analyst: Analyst, known_tags: list[str], calls: int = CALLS, attempts: int = ATTEMPTS, pause: float = 0.5, ledger: CallLedger | None = None) -> DataFrame:
    """Analysis of every article. Save it before it is used again: a model's call isn't free.

    With a ledger no answered call is made twice, in whatever task or run; without one a failed task starts over.
    """

    def call(f: Callable, *args: object) -> object:
        made = (ledger.call, f.__name__, f) if ledger else (f,)
        return tried(calls, pause, *made, *args)

    def chain(r: object) -> tuple:
        title, content = r.title or "", r.detail_content or ""
        tags = list(call(analyst.tags, title, content, known_tags))
        image = call(analyst.image_context, title, content) if r.has_attached_image else None
        return r.detail_url, tags, image, call(analyst.score, title, content, tags), pd.Timestamp.now(tz="UTC")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [tried(attempts, pause, chain, r) for r in rows.itertuples()]
            yield pd.DataFrame(out, columns=["detail_url", "tags", "image_context", "score", "analysed_at"])

    return articles.select("detail_url", "title", "detail_content", "has_attached_image").mapInPandas(run, ANALYSIS)


def crawl(lists: DataFrame, detail_pages: Callable[[DataFrame], DataFrame], store: Store, as_of: date, task_id: int) -> int:
    """Saves the new articles of ``lists (target_id, html)``; ``detail_pages`` gives (detail_url, html) of new items
    (detail_url, uniq_id, detail_spec, params).

    New items and their pages are stored before they are used, so that no page is asked for twice. List rows and pages that
    fail are kept in the store's ``failures`` and not saved as articles.
    """
    spark = lists.sparkSession
    boards = catalog.targets(spark)
    held = lists.join(F.broadcast(boards), "target_id").withColumn("page_id", F.col("target_id"))
    items = store.scratch(extract.list_items(held, F.lit(as_of)).withColumnRenamed("page_id", "target_id"), "items")
    # Known addresses go before any detail page is read.
    fresh = store.new_articles(R.one_per_url(items.where("error is null")).drop("error"))
    fresh = R.with_context(fresh, boards, task_id)
    fresh = store.scratch(fresh.join(F.broadcast(boards.select("target_id", "detail_spec", "params")), "target_id"), "fresh")
    read = store.scratch(detail_pages(fresh.select("detail_url", "uniq_id", "detail_spec", "params")), "read").select("detail_url", "html")
    details = store.scratch(extract.details(R.with_details(fresh.drop("params"), read)), "details")
    failed = lambda rows, key: rows.where("error is not null").select(F.lit(task_id).cast("long").alias("task_id"), F.col(key).alias("source"), "error")
    store.append("failures", failed(items, "target_id").unionByName(failed(details, "detail_url")))
    return store.save_articles(details.where("error is null"))


def crawl_boards(store: Store, fetcher: pages.Fetcher, as_of: date, task_id: int) -> int:
    """:func:`crawl` of all enabled boards with pages that ``fetcher`` gets, by form where a board takes one. Pages that fail are the store's ``failures``."""

    def got(requests: DataFrame) -> DataFrame:
        good, bad = pages.sound(store.scratch(pages.fetch(requests, fetcher), "pages"))
        store.append("failures", bad.select(F.lit(task_id).cast("long").alias("task_id"), F.col("key").alias("source"), "error"))
        return good.select("key", "html")

    lists = got(pages.list_requests(catalog.targets(store.spark))).withColumnRenamed("key", "target_id")
    return crawl(lists, lambda fresh: got(pages.detail_requests(fresh)).withColumnRenamed("key", "detail_url"), store, as_of, task_id)


#: Articles that a writer reads: the best of an issue's.
READ = 200


def publish(store: Store, writer: Writer, most: int = READ) -> str | None:
    """Saves the next issue if the gate opens, else None: candidates then stay for a later one.

    The writer, on the driver, reads the ``most`` best articles; all that waited count as used. Neither they nor their texts come to the driver.
    """
    spark = store.spark
    rows = store.find_candidates(catalog.score_floors(spark))
    gate = R.publication_gate(rows.withColumn("issue", F.lit(1)), ["issue"]).first()
    if gate is None or not gate["publish"]:
        return None
    chosen = R.top_articles(rows, most)
    title, content = writer.write([r.asDict() for r in chosen.select("title", "detail_url", "detail_content", "tags", "effective_score").collect()])
    number = store.next_issue()
    html = render.render(render.template(catalog.targets(spark)), title, content)
    issue = spark.createDataFrame([(str(number), number, title, html)], "id string, issue_order int, title string, html string")
    return store.save_newsletter(issue, rows.select("detail_url"))


def run(store: Store, lists: DataFrame, detail_pages: Callable[[DataFrame], DataFrame], analyst: Analyst, writer: Writer, as_of: date) -> str | None:
    """A whole run under one task number."""
    task = store.create_task()
    try:
        crawl(lists, detail_pages, store, as_of, task)
        known = [r["tag"] for r in store.find_tags().orderBy("tag").toLocalIterator()]
        store.append("analysis", analyse(store.find_unscored(), analyst, known))
        return publish(store, writer)
    finally:
        store.complete_task(task)
