"""Scalar functions on the traps that their definitions name, and their properties."""

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars as S


def one(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_js_trim(spark):
    assert one(spark, S.js_trim, ["  　﻿\t\na\n  ", "", None, "a b"]) == ["a", "", None, "a b"]


def test_get_date(spark):
    cases = {"2024.01.15": "2024-01-15", "2024.01.15\n2024.01.20": "2024-01-15 ~ 2024-01-20", "2024.01.15.": "2024-01-15-", "a\n  b \nc": "a ~ b"}
    assert one(spark, S.get_date, list(cases)) == list(cases.values())


def test_derived_dates(spark):
    values = ["2024.1.5 ~ 2024.01.20", "2024.01.15.", "5000", "", "2024.02.30", None]
    assert one(spark, S.start_date, values) == [datetime.date(2024, 1, 5), None, None, None, None, None]
    assert one(spark, S.end_date, values)[0] == datetime.date(2024, 1, 20)
    day = F.lit("2024-01-19").cast("date")
    assert one(spark, lambda c: S.is_after(c, day), ["2024.01.20", "2024.01.19", "x", None]) == [True, False, False, False]


CLEAN = {
    "https://example.com/path;jsessionid=123456?id=123&pageIndex=1": "https://example.com/path?id=123",
    "https://h/p?c=61/101/105": "https://h/p?c=61%2F101%2F105",
    "https://h/p?a=x%20y&b": "https://h/p?a=x+y&b=",
    "https://h/p?pageIndex=1": "https://h/p",
    "https://h": "https://h/",
    "http://h:80/a/../b?x=~!*()": "http://h/b?x=%7E%21*%28%29",
    "https://h/p;jsessionid=1?a=1;b=2&c=3": "https://h/p?a=1",
    "https://h/p?sdate=1&edate=2&searchWrd=x&strWhere=&pageUnit=9&k=v#top": "https://h/p?k=v#top",
    "HTTPS://Host.Example:443/A b": "https://host.example/A%20b",
    "not a url": "not a url",
    "/relative?pageIndex=1": "/relative?pageIndex=1",
    "": "",
}


def test_clean_url(spark):
    assert one(spark, S.clean_url, list(CLEAN)) == list(CLEAN.values())
    assert one(spark, S.clean_url, [None]) == [None]


def test_clean_url_is_idempotent(spark):
    assert one(spark, lambda c: S.clean_url(S.clean_url(c)), list(CLEAN)) == list(CLEAN.values())


@pytest.mark.parametrize(("href", "want"), [
    ("/a?b=1", "https://h.kr/a?b=1"), ("a/b", "https://h.kr/a/b"), ("./a", "https://h.kr/a"), ("?x=1", "https://h.kr/?x=1"),
    ("https://o.kr/z", "https://o.kr/z"), ("//o.kr/z", "https://o.kr/z"), (" /a ", "https://h.kr/a"),
])
def test_resolve(spark, href, want):
    assert one(spark, lambda c: S.resolve(c, F.lit("https://h.kr")), [href]) == [want]


def test_url_parts(spark):
    urls = ["https://h/p?id=a%20b&id=c", "https://h/p?x=1#id=3", "https://h/p?id", "https://h/a/b/", "https://h/a/b?c=d/e"]
    assert one(spark, lambda c: S.query_param(c, "id"), urls) == ["a b", None, "", None, None]
    assert one(spark, S.last_segment, urls) == ["p", "p", "p", "", "b"]


def test_script_ids(spark):
    text = ["fnView('1005200642', 'admin', '', '','');", "goView('1'); goView('2')", "nttSeq=1005200644", "nttSeq='1005200644'", "none"]
    assert one(spark, lambda c: S.call_first(c, "fnView"), text) == ["1005200642", "", "", "", ""]
    assert one(spark, lambda c: S.call_argument(c, "goView"), text)[1] == "1'); goView('2"
    assert one(spark, S.post_id, text) == ["", "", "1005200644", "1005200644", ""]


def test_seoul_days(spark):
    rows = spark.sql("SELECT timestamp_ntz'2024-10-14 15:00:00' AS t UNION ALL SELECT timestamp_ntz'2024-01-04 14:59:59' ORDER BY 1")
    got = [(r[0], r[1]) for r in rows.select(S.kst_date(F.col("t")), S.kst_display(F.col("t"))).collect()]
    assert got == [("2024-01-04", "2024년 1월 4일"), ("2024-10-15", "2024년 10월 15일")]


def test_display_helpers(spark):
    assert one(spark, S.escape_html, ["<a href=\"x\">'&amp;'</a>"]) == ["&lt;a href=&quot;x&quot;&gt;&#039;&amp;amp;&#039;&lt;/a&gt;"]
    assert one(spark, S.truncate_url, ["x" * 61, "x" * 60, "", None]) == ["x" * 57 + "...", "x" * 60, "-", "-"]
    assert one(spark, lambda c: S.or_else(c, F.lit("z")), ["", None, "a"]) == ["z", "z", "a"]
