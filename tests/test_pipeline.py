"""Repositories, relational rules, a whole run, and the stream."""

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import relational as R
from millrace.plans import pipeline, render
from millrace.sources import catalog, pages
from millrace.sources.store import Store, TaskRunning
from millrace.streaming import incremental

KRAS = "한국고고학회_공지사항"


class Issue:
    def write(self, articles):
        return f"{len(articles)} articles", "\n".join(f"<p>{a['title']}</p>" for a in articles)


def board(n, start=0):
    rows = "".join(f"<tr><td>{i}<td><a href='/?m=bbs&uid={i}'>dig {i}</a><td><td><td>2024.01.{i + 1:02}</tr>" for i in range(start, start + n))
    return f"<table>{rows}</table>"


def details(fresh):
    return fresh.withColumn("html", F.lit("<div id='vContent'>dig report</div>"))


def lists(spark, html):
    return spark.createDataFrame([(KRAS, html)], "target_id string, html string")


def test_a_run_carries_over_until_the_gate_opens(spark, tmp_path):
    store, analyst, day = Store(spark, str(tmp_path / "s")), pipeline.KeywordAnalyst({"dig": 1}), datetime.date(2024, 1, 1)
    assert pipeline.run(store, lists(spark, board(4)), details, analyst, Issue(), day) is None
    assert store.read("articles").count() == 4 and store.find_unscored().count() == 0
    assert [r["tag"] for r in store.find_tags().collect()] == ["dig"]
    waiting = store.find_candidates(catalog.score_floors(spark)).collect()
    assert [r["effective_score"] for r in waiting] == [6] * 4  # the board's floor
    # Two more: the four that waited come along.
    assert pipeline.run(store, lists(spark, board(6)), details, analyst, Issue(), day) == "1"
    assert store.read("articles").count() == 6 and store.read("newsletter_articles").count() == 6
    assert store.find_candidates(catalog.score_floors(spark)).count() == 0 and store.next_issue() == 2
    html = store.read("newsletters").first()["html"]
    assert "<h1>6 articles</h1>" in html and "dig 5" in html and html.count("<li>") == 53
    # A second save of an issue changes nothing.
    again = store.read("newsletters").limit(1)
    assert store.save_newsletter(again, store.read("articles")) == "1" and store.read("newsletter_articles").count() == 6
    assert store.find_by_urls(store.read("articles").limit(2).select("detail_url")).count() == 2


def test_tasks_run_one_at_a_time(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    first = store.create_task()
    with pytest.raises(TaskRunning):
        store.create_task()
    store.complete_task(first)
    with pytest.raises(TaskRunning):
        store.complete_task(first)
    assert store.create_task() == first + 1


def test_floors_and_gate(spark):
    scored = spark.createDataFrame([("a", "u", 3), ("b", "u", None), ("c", "v", 9)], "detail_url string, target_url string, score int")
    floors = spark.createDataFrame([("u", 6), ("u", 2)], "target_url string, min_score int")
    got = {r["detail_url"]: r["effective_score"] for r in R.effective_score(scored, floors).collect()}
    assert got == {"a": 6, "b": None, "c": 9}
    for n, best, out in ((5, 7, False), (6, 1, True), (1, 8, True)):
        rows = spark.createDataFrame([("g", best)] * n, "g string, effective_score int")
        assert R.publication_gate(rows, ["g"]).first()["publish"] is out
    assert catalog.score_floors(spark).count() == 14


def test_latest_wins_and_ties_are_settled(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "w")], "k string, t int, v string")
    assert {r["k"]: r["v"] for r in R.latest(rows, "k", F.col("t")).collect()} == {"a": "z", "b": "w"}


def test_new_and_existing_split_the_input(spark):
    crawled = spark.range(20).select(F.concat(F.lit("u"), F.col("id") % 15).alias("detail_url"))
    known = spark.range(5).select(F.concat(F.lit("u"), "id").alias("detail_url"))
    assert R.new_articles(crawled, known).count() + R.existing_articles(crawled, known).count() == 20


def test_top_k_is_a_total_order(spark):
    rows = spark.createDataFrame([("b", 5, "g"), ("a", 5, "g"), ("c", 9, "h")], "detail_url string, effective_score int, grp string")
    assert [r["detail_url"] for r in R.top_articles(rows, 2).collect()] == ["c", "a"]
    assert {(r["detail_url"], r["rank"]) for r in R.top_articles(rows, 1, by=["grp"]).collect()} == {("c", 1), ("a", 1)}


def test_targets(spark):
    assert catalog.find_target(spark, "news", KRAS).first()["list_spec"] == "kras"
    assert catalog.find_target(spark, "news", KRAS, "https://x/").first()["url"] == "https://x/"
    assert catalog.find_target(spark, "news", KRAS, "").first()["url"].startswith("https://www.kras")
    with pytest.raises(catalog.TargetNotFound):
        catalog.find_target(spark, "business", KRAS)
    assert [len(r["targets"]) for r in catalog.groups(spark).collect()] == [42, 4, 7]


def test_fetch_quarantines_failures(spark):
    def get(url, method, body, headers):
        if "boom" in url:
            raise OSError("down")
        return (404, "no") if "404" in url else (200, f"{method} {body}")

    asked = spark.createDataFrame([("u/1", "POST", "a=b"), ("u/404", "GET", None), ("u/boom", "GET", None)], pages.REQUESTS)
    good, bad = pages.sound(pages.fetch(asked, pages.Fetcher(get, attempts=2, pause=0)))
    assert [(r["url"], r["html"]) for r in good.collect()] == [("u/1", "POST a=b")]
    assert {r["url"]: r["error"] for r in bad.collect()} == {"u/404": "HTTP 404", "u/boom": "OSError: down"}
    form = spark.createDataFrame([({"menu": "1", "bbs": "2", "contents": "3"},)], "p map<string,string>").select(pages.list_form(F.col("p"))).first()[0]
    assert form.startswith("siteSeq=32000001030&bbsSeq=2&pageIndex=1&menuSeq=1") and form.endswith("nttSeq=")


def test_cache_is_strictly_younger_than_its_time(spark):
    now = F.lit("2024-01-01 00:05:00").cast("timestamp_ntz")
    cache = spark.sql("SELECT 'a' AS url, timestamp_ntz'2024-01-01 00:00:00' AS fetched_at UNION ALL SELECT 'b', timestamp_ntz'2024-01-01 00:00:01'")
    assert [r["url"] for r in pages.fresh(cache, now).collect()] == ["b"]
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    assert sorted(r["url"] for r in pages.to_fetch(asked, cache, now).collect()) == ["a", "c"]


def test_template_has_both_markers(spark):
    page = render.template(catalog.targets(spark))
    assert render.TITLE in page and render.CONTENT in page and render.UNSUBSCRIBE in page and "6 articles" in page
    assert "<i>x</i>" in render.render(page, "t", "<i>x</i>")


def test_stream_saves_each_page_once(spark, tmp_path):
    source, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"))
    row = "SELECT 't' AS target_id, '{u}' AS url, 'generic' AS detail_spec, 'x' AS title, '<article>hello <img></article>' AS html, current_timestamp() AS fetched_at"
    for batch in (("u1", "u2"), ("u2", "u3")):
        spark.sql(" UNION ALL ".join(row.format(u=u) for u in batch)).write.mode("append").parquet(source)
        incremental.ingest(incremental.pages(spark, source), store, str(tmp_path / "cp")).awaitTermination()
    got = store.read("articles").collect()
    assert sorted(r["detail_url"] for r in got) == ["u1", "u2", "u3"] and all(r["has_attached_image"] for r in got)


def test_boards_are_crawled_by_page_and_by_form(spark, tmp_path):
    listing = board(2)

    def get(url, method, body, headers):
        if url == pages.FORM_LIST:
            assert method == "POST"
            return (200, "<table class='basic-table01'><tr><td>1<td><a onclick=\"fnView('77', 'a')\">dig</a><td><td>2024.01.02</tr></table>") if "bbsSeq=32000001157" in body else (200, "")
        if url == pages.FORM_DETAIL:
            return (200, "<div class='conM_txt'>by form</div>") if "nttSeq=77" in body else (500, "")
        if url.startswith("https://www.kras.or.kr/?") and "uid=" not in url:
            return (200, listing) if "notice" in url or "bbs" in url else (200, "")
        return (200, "<div id='vContent'>by page</div>") if url.endswith("uid=0") else (404, "") if "uid=" in url else (200, "")

    store = Store(spark, str(tmp_path / "c"))
    assert pipeline.crawl_boards(store, pages.Fetcher(get, attempts=1, pause=0), datetime.date(2024, 1, 1), 1) > 0
    got = {r["detail_url"]: r["detail_content"] for r in store.read("articles").collect()}
    assert "by form" in got.values() and "by page" in got.values() and not any(u.endswith("uid=1") for u in got)
    assert {r["error"] for r in store.read("failures").collect()} == {"HTTP 404"}


def test_calls_are_tried_again():
    left = [3]

    def f(x):
        left[0] -= 1
        if left[0]:
            raise OSError("busy")
        return x

    assert pipeline.tried(5, 0, f, "a") == "a" and left == [0]
    with pytest.raises(OSError):
        pipeline.tried(2, 0, lambda: (_ for _ in ()).throw(OSError("down")))


def test_the_package_offers_its_names():
    import millrace

    assert millrace.Store is Store and all(getattr(millrace, n) for n in millrace.__all__)
