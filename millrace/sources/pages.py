"""Raw pages: a cache with a time to live, and fetching as a stage of its own."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds for which a cached page is fresh, and fetches at a time.
TTL, CONCURRENCY = 300, 5

REQUESTS = "url string, method string, body string"
PAGE = "key string, url string, html string, status int, error string"

#: Where the boards that are rendered by script take their forms, and the layout of these boards.
FORM_LIST, FORM_DETAIL = "http://www.yngogo.or.kr/module/ntt/unity/selectNttListAjax.ink", "http://www.yngogo.or.kr/module/ntt/unity/selectNttDetailAjax.ink"
FORM_LAYOUT = "yngogo"


def http_get(url: str, method: str, body: str | None, headers: dict) -> tuple[int, str]:
    """A request over HTTP, for :class:`Fetcher`: its status and text. A body goes as a form."""
    form = {"Content-Type": "application/x-www-form-urlencoded"} if body is not None else {}
    request = urllib.request.Request(url, body.encode() if body is not None else None, {**headers, **form}, method=method)
    try:
        with urllib.request.urlopen(request, timeout=30) as answer:
            return answer.status, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""


@dataclass(frozen=True)
class Fetcher:
    """``get(url, method, body, headers)`` gives (status, text); it must survive pickling.

    Failures are retried ``attempts`` times with growing pauses; a status beyond 2xx is an error, not a page.
    """

    get: Callable[[str, str, str | None, dict], tuple[int, str]] = http_get
    attempts: int = 3
    pause: float = 0.5
    headers: dict = field(default_factory=lambda: {"User-Agent": "millrace"})

    def one(self, url: str, method: str, body: str | None) -> tuple[str | None, int | None, str | None]:
        status, error = None, None
        for turn in range(self.attempts):
            try:
                status, text = self.get(url, method or "GET", body, self.headers)
            except Exception as e:  # a page's failure is a row, not the job's end
                error = f"{type(e).__name__}: {e}"
            else:
                if 200 <= status < 300:
                    return text, status, None
                error = f"HTTP {status}"
                if 400 <= status < 500:
                    break
            time.sleep(self.pause * turn)
        return None, status, error


def fetch(requests: DataFrame, fetcher: Fetcher, concurrency: int = CONCURRENCY) -> DataFrame:
    """Pages of ``requests`` (of REQUESTS), by at most ``concurrency`` tasks at a time; store the result before parsing.

    A ``key`` of the requests comes back with their pages, as one address may take many forms; without one it is the address.
    """
    asked = requests if "key" in requests.columns else requests.withColumn("key", F.col("url"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = [fetcher.one(r.url, r.method, r.body) for r in rows.itertuples()]
            yield pd.DataFrame({"key": rows["key"], "url": rows["url"], "html": [g[0] for g in got], "status": pd.array([g[1] for g in got], "Int32"), "error": [g[2] for g in got]})

    return asked.select("key", "url", "method", "body").repartition(concurrency).mapInPandas(run, PAGE)


def form_body(values: dict[str, Column]) -> Column:
    """A form's body from columns."""
    return F.concat_ws("&", *[F.concat(F.lit(f"{k}="), F.url_encode(F.coalesce(v, F.lit("")))) for k, v in values.items()])


def list_form(params: Column) -> Column:
    """The form that the boards that are rendered by script are asked with, first page only."""
    return form_body({
        "siteSeq": F.lit("32000001030"), "bbsSeq": params["bbs"], "pageIndex": F.lit("1"), "menuSeq": params["menu"], "pageMode": F.lit("B"), "sitecntntsSeq": params["contents"],
        "tabTyCode": F.lit("dataManage"), "mngrAt": F.lit("N"), "searchCondition": F.lit(""), "searchKeyword": F.lit(""), "nttSeq": F.lit(""),
    })


def detail_form(params: Column, post: Column) -> Column:
    """The form for one post of such a board."""
    return form_body({
        "siteSeq": F.lit("32000001030"), "bbsSeq": params["bbs"], "nttSeq": post, "pageIndex": F.lit("1"), "ordrSe": F.lit("D"), "searchCnd": F.lit("frstRegistPnttm"),
        "checkNttSeq": F.lit(""), "menuSeq": params["menu"], "mngrAt": F.lit("N"), "parntsNttSeq": F.lit(""), "secretAt": F.lit(""), "searchAt": F.lit(""), "sitecntntsSeq": params["contents"],
        "cmntUseAt": F.lit("N"), "atchFilePosblAt": F.lit("Y"), "atchFilePosblCo": F.lit("3"), "listCount": F.lit("10"), "searchCondition": F.lit("1"), "searchKeyword": F.lit(""),
    })


def list_requests(boards: DataFrame) -> DataFrame:
    """``(key, url, method, body)`` of every board's list; key: the board."""
    formed = F.col("list_spec") == FORM_LAYOUT
    return boards.select(
        F.col("target_id").alias("key"), F.when(formed, FORM_LIST).otherwise(F.col("url")).alias("url"), F.when(formed, "POST").otherwise("GET").alias("method"), F.when(formed, list_form(F.col("params"))).alias("body")
    )


def detail_requests(items: DataFrame) -> DataFrame:
    """``(key, url, method, body)`` of items (detail_url, uniq_id, detail_spec, params); key: the item's address."""
    formed = F.col("detail_spec") == FORM_LAYOUT
    return items.select(
        F.col("detail_url").alias("key"), F.when(formed, FORM_DETAIL).otherwise(F.col("detail_url")).alias("url"), F.when(formed, "POST").otherwise("GET").alias("method"), F.when(formed, detail_form(F.col("params"), F.col("uniq_id"))).alias("body")
    )


def sound(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages to parse, and those that failed."""
    good = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    return pages.where(good), pages.where(~good)


def fresh(cache: DataFrame, now: Column, ttl: int = TTL, fetched: str = "fetched_at") -> DataFrame:
    """Cached rows younger than ``ttl`` seconds."""
    return cache.where(F.col(fetched) > now - F.make_dt_interval(secs=F.lit(ttl)))


def to_fetch(requests: DataFrame, cache: DataFrame, now: Column, ttl: int = TTL) -> DataFrame:
    """Requests that no fresh cached page answers."""
    return requests.join(fresh(cache, now, ttl).select("url").distinct(), "url", "left_anti")
