"""Registered queries of the core library and the SQL that gives the same rows.

The test tables stand in for the library's own: documents for articles, labels for analyses, pages for raw
pages, events for the fetch and run logs, conversations for ordered parts of a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import addresses
from millrace.functions import scalars as S
from millrace.operators import extract
from millrace.operators import relational as R
from millrace.plans import layout_pages, pipeline, render
from millrace.sources import catalog, crawl, keyed, mirror, pages
from millrace.sources.store import Store, TaskRunning, scratch_root
from millrace.streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The fixed day and instant that queries look from.
AS_OF, NOW = "1996-01-01", "2024-01-15 00:00:00"
#: Floors by source, with a repeated entry as real lists have.
FLOORS = [("src0", 6), ("src1", 6), ("src0", 6), ("src2", 2)]
FLOOR_VALUES = ", ".join(f"('{s}', {n})" for s, n in FLOORS)


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- scalars ------------------------------------------------------------------------------------------

_QUERY = r"regexp_extract(u, '^[^?#]*\?([^#]*)', 1)"


@query(r"""
WITH s AS (SELECT page_id, regexp_replace(url, ';[^?#]*', '', 'g') AS u FROM pages),
p AS (SELECT page_id, u, list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ('pageIndex', 'pageUnit', 'strWhere', 'searchWrd', 'sdate', 'edate')) AS ps FROM s)
SELECT page_id, regexp_extract(u, '^[^?#]*', 0) || CASE WHEN regexp_matches(u, '^[a-z]+://[^/?#]+([?#]|$)') THEN '/' ELSE '' END
  || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(list_transform(ps, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') ELSE '' END
  || regexp_extract(u, '#.*$', 0) AS clean_url FROM p""")
def clean_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", S.clean_url(F.col("url")).alias("clean_url"))


_DOTTED = "(n >> 24) || '.' || (n >> 16 & 255) || '.' || (n >> 8 & 255) || '.' || (n & 255)"


@query(f"""
WITH c AS ({ORACLES["clean_url"]}), a AS (SELECT page_id, page_id AS i, (page_id % 4194304) * 257 + 16777216 AS n FROM pages)
SELECT page_id, CASE i % 10 WHEN 0 THEN 'https://Me:a%20b@host' || i || '.kr/d?id=' || i WHEN 1 THEN 'http://' || {_DOTTED} || '/' WHEN 2 THEN 'http://' || {_DOTTED} || '/?q=%EA%B0%80'
  WHEN 3 THEN 'http://[2001:db8::' || lower(to_hex(i % 65535 + 1)) || ']:8080/a' WHEN 4 THEN 'http://xn--bcher-kva.example/' || i || '#' WHEN 5 THEN 'mailto:a' || i || '@b.kr?subject=x+y'
  WHEN 6 THEN 'ftp://h' || i || '/x' WHEN 7 THEN 'file:///C:/' || i WHEN 8 THEN 'http://1.2.3.' || (256 + i) || '/;a?sdate=1' ELSE clean_url END AS address FROM a JOIN c USING (page_id)""")
def clean_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with user info, numeric and internationalised hosts, of other schemes, and such that are none, one of ten kinds for each page."""
    i, n = F.col("page_id").cast("string"), (F.col("page_id") % 4194304) * 257 + 16777216
    made = [
        F.concat(F.lit("HTTPS://Me:a b@Host"), i, F.lit(".KR:443/x/../d?id="), i, F.lit("&sdate=1")),
        F.concat(F.lit("http://"), n.cast("string"), F.lit("?pageIndex=2")),
        F.concat(F.lit("http://0x"), F.hex(n), F.lit("\\?q=가")),
        F.concat(F.lit("http://[2001:DB8:0:0:0:0:0:"), F.hex(F.col("page_id") % 65535 + 1), F.lit("]:8080/a")),
        F.concat(F.lit("http://BÜCHER.example/"), i, F.lit(";s=1?pageUnit=9#")),
        F.concat(F.lit("mailto:a"), i, F.lit("@b.kr?sdate=1&subject=x y")),
        F.concat(F.lit("ftp://h"), i, F.lit(":21/./x")),
        F.concat(F.lit("file:///C|/../"), i),
        F.concat(F.lit("http://1.2.3."), (256 + F.col("page_id")).cast("string"), F.lit("/;a?sdate=1")),
        F.col("url"),
    ]
    address = F.element_at(F.array(*made), (F.col("page_id") % len(made) + 1).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", address.alias("a")).select("page_id", addresses.clean_address(F.col("a")).alias("address"))


@query(r"""
SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page_no,
  list_extract(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), -1) AS last_segment FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", S.query_param(url, "page").alias("page_no"), S.last_segment(url).alias("last_segment"))


@query(r"""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS one, strftime(o_orderdate, '%Y-%m-%d') || ' ~ ' || strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') AS many,
  CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate + INTERVAL 7 DAY AS DATE) AS end_date FROM orders""")
def date_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda c: F.date_format(c, "yyyy.MM.dd")
    one = shown(F.col("o_orderdate"))
    both = F.concat(one, F.lit("\n　"), shown(F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")), F.lit(" "))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", one.alias("a"), both.alias("b"))
    return rows.select("o_orderkey", S.get_date(F.col("a")).alias("one"), S.get_date(F.col("b")).alias("many"), S.start_date(F.col("b")).alias("start_date"), S.end_date(F.col("b")).alias("end_date"))


@query(f"""
SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) > DATE '{AS_OF}' THEN 'DURATION' ELSE 'REGISTERED' END AS date_type FROM orders""")
def date_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.date_format("o_orderdate", "yyyy.MM.dd")
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.when(S.is_after(end, F.lit(AS_OF).cast("date")), "DURATION").otherwise("REGISTERED").alias("date_type"))


@query("""
SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS iso_date,
  CAST(year(ts + INTERVAL 9 HOUR) AS VARCHAR) || '년 ' || CAST(month(ts + INTERVAL 9 HOUR) AS VARCHAR) || '월 ' || CAST(day(ts + INTERVAL 9 HOUR) AS VARCHAR) || '일' AS display_date FROM events""")
def kst_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", S.kst_date(F.col("ts")).alias("iso_date"), S.kst_display(F.col("ts")).alias("display_date"))


@query("""
SELECT page_id, replace(replace(replace(replace(replace(url || '<"''&>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS escaped,
  CASE WHEN length(url || repeat('/x', page_id % 30)) > 60 THEN left(url || repeat('/x', page_id % 30), 57) || '...' ELSE url || repeat('/x', page_id % 30) END AS shown FROM pages""")
def escape_and_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = F.concat("url", F.expr("repeat('/x', cast(page_id % 30 as int))"))
    return _table(spark, sf_dir, "pages").select("page_id", S.escape_html(F.concat("url", F.lit("<\"'&>"))).alias("escaped"), S.truncate_url(long).alias("shown"))


@query("SELECT page_id, url AS trimmed FROM pages")
def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("　﻿ \t"), "url", F.lit("\n  "))
    return _table(spark, sf_dir, "pages").select("page_id", S.js_trim(padded).alias("trimmed"))


@query("""
SELECT event_id, regexp_extract('fnView(''' || event_id || ''', ''admin'', '''')', 'fnView\\(''([^'']*)''', 1) AS first_argument,
  CAST(event_id AS VARCHAR) AS argument, CAST(event_id AS VARCHAR) AS post FROM events""")
def script_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    call = F.concat(F.lit("fnView('"), n, F.lit("', 'admin', '')"))
    greedy = F.concat(F.lit("return goView('"), n, F.lit("')"))
    return _table(spark, sf_dir, "events").select(
        "event_id", S.call_first(call, "fnView").alias("first_argument"), S.call_argument(greedy, "goView").alias("argument"), S.post_id(F.concat(F.lit("nttSeq='"), n, F.lit("'"))).alias("post")
    )


# --- pages --------------------------------------------------------------------------------------------


@query(r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) AS n_links,
  CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n_paragraphs FROM pages""")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")
    return _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), count("<a ").alias("n_links"), count("<p>").alias("n_paragraphs"))


@query()
def detail_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "pages").select("page_id", S.clean_url(F.col("url")).alias("detail_url"), "html", F.lit("generic").alias("detail_spec"))
    return extract.details(own).drop("error")


@query(r"""
WITH n AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<li><a href="[^"]*">[^<]*</a></li>') AS items FROM pages),
x AS (SELECT page_id, unnest(range(1, len(items) + 1)) AS pos, unnest(items) AS item FROM n)
SELECT page_id, CAST(pos AS BIGINT) AS pos, regexp_extract(item, '>([^<]*)</a>', 1) AS title, regexp_extract(item, 'href="([^"]*)"', 1) AS href FROM x""")
def list_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(extract.raw_items("html", F.lit("navigation"))).alias("n", "r"))
    return own.select("page_id", (F.col("n") + 1).cast("long").alias("pos"), "r.title", "r.href")


@query(f"""
SELECT event_id FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE""")
def fetch_cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.fresh(_table(spark, sf_dir, "events"), F.lit(NOW).cast("timestamp_ntz"), fetched="ts").select("event_id")


# --- catalogue ----------------------------------------------------------------------------------------

_TARGET_VALUES = ",\n".join("(" + ", ".join([_quoted(r[0]), _quoted(r[2]), _quoted(r[3]), _quoted(r[4]), str(r[8]), str(r[10])]) + ")" for r in catalog.target_rows())
_TARGETS = f"(VALUES {_TARGET_VALUES}) AS t(group_id, target_id, target_name, url, enabled, pos)"


@query(f"SELECT group_id, target_id, target_name, url FROM {_TARGETS} WHERE enabled")
def target_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.groups(spark).select(F.col("id").alias("group_id"), F.explode("targets").alias("t")).select("group_id", F.col("t.id").alias("target_id"), F.col("t.name").alias("target_name"), "t.url")


@query(f"SELECT group_id, count(*) AS n_targets FROM {_TARGETS} WHERE enabled GROUP BY group_id")
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.targets(spark).groupBy("group_id").agg(F.count("*").alias("n_targets"))


@query(f"""
SELECT string_agg('<li><a href="' || replace(replace(url, '&', '&amp;'), '''', '&#039;') || '">' || target_name || '</a></li>', chr(10) ORDER BY pos) AS sources
FROM {_TARGETS} WHERE enabled""")
def render_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.source_list(catalog.targets(spark))


# --- articles -----------------------------------------------------------------------------------------


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def new_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.new_articles(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT d.doc_id, d.source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def existing_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.existing_articles(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    analysis = _table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 1).alias("score"))
    return R.unscored(_table(spark, sf_dir, "documents"), analysis, "doc_id").select("doc_id")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.with_details(_table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), _table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select("doc_id", "source", "lang", (F.col("quality") * 5 + F.col("toxic")).cast("int").alias("score"))
    return R.effective_score(rows, spark.createDataFrame(FLOORS, "target_url string, min_score int"), url="source")


_SCORED = f"""
f AS (SELECT source, max(m) AS m FROM (VALUES {FLOOR_VALUES}) AS v(source, m) GROUP BY source),
s AS (SELECT d.doc_id, d.source, d.lang, CAST(l.quality * 5 + l.toxic AS INTEGER) AS score, CAST(greatest(l.quality * 5 + l.toxic, coalesce(f.m, -1)) AS INTEGER) AS effective_score
      FROM documents d JOIN labels l USING (doc_id) LEFT JOIN f ON f.source = d.source)"""
_GATE = """
g AS (SELECT source, lang, count(*) AS n_articles, max(effective_score) AS max_score, count(*) > 5 OR max(effective_score) >= 8 AS publish FROM s GROUP BY source, lang)"""


@query(f"WITH {_SCORED} SELECT doc_id, source, score, effective_score FROM s")
def effective_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "source", "score", "effective_score")


@query(f"WITH {_SCORED}, {_GATE} SELECT * FROM g")
def publication_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.publication_gate(_scored(spark, sf_dir), ["source", "lang"])


@query(f"WITH {_SCORED}, {_GATE} SELECT doc_id, source FROM s WHERE NOT EXISTS (SELECT 1 FROM g WHERE publish AND g.source = s.source AND g.lang = s.lang)")
def carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    return R.carry_over(rows, R.publication_gate(rows, ["source", "lang"]), ["source", "lang"]).select("doc_id", "source")


@query(f"WITH {_SCORED} SELECT doc_id, effective_score FROM s WHERE doc_id NOT IN (SELECT item_id FROM benchmark) ORDER BY effective_score DESC, doc_id LIMIT 20")
def candidates_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return R.top_articles(R.candidates(_scored(spark, sf_dir), used, "doc_id"), 20, "doc_id").select("doc_id", "effective_score")


@query(f"""WITH {_SCORED}
SELECT doc_id, source, effective_score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY effective_score DESC, doc_id) AS r FROM s) WHERE r <= 3""")
def top_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_articles(_scored(spark, sf_dir), 3, "doc_id", ["source"]).select("doc_id", "source", "effective_score", "rank")


@query("SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def one_per_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("name"))
    return R.one_per_url(named, "name", ("doc_id",)).select("doc_id", "source", "lang")


@query("SELECT coalesce(max(o_orderkey), 0) + 1 AS next_issue FROM orders")
def next_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.next_issue(_table(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT DISTINCT lang AS tag FROM documents UNION SELECT DISTINCT source FROM documents")
def tag_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tag_vocabulary(_table(spark, sf_dir, "documents").select(F.array("lang", "source").alias("tags")))


@query("SELECT source, count(*) AS n_articles FROM documents GROUP BY source")
def saved_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_articles"))


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", F.col("event_id"))


@query("""
SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS completed_at, count(*) AS n_events
FROM events GROUP BY user_id, event_type""")
def crawl_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    rows = _table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n_events"))
    return rows.select("user_id", "event_type", shown("a").alias("started_at"), shown("b").alias("completed_at"), "n_events")


@query("SELECT conv_id, string_agg(CAST(turn AS VARCHAR) || '. **' || role || '**' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def journal_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.concat(F.col("turn").cast("string"), F.lit(". **"), "role", F.lit("**\n"), "text")
    return R.rolled_up(_table(spark, sf_dir, "conversations"), "conv_id", "turn", part)


@query("SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || '}' AS json FROM documents")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", "n_chars")).alias("json"))


# --- every board layout -------------------------------------------------------------------------------

#: The days of a page by its number: (SQL, Spark).
_FIRST, _LAST = ("DATE '2023-12-01' + CAST(page_id % 60 AS INTEGER)", "date_add(DATE'2023-12-01', cast(page_id % 60 as int))"), ("DATE '2023-12-01' + CAST(page_id % 60 + page_id % 45 AS INTEGER)", "date_add(DATE'2023-12-01', cast(page_id % 60 + page_id % 45 as int))")
_LIST_DAY = "2024-01-01"


@query(f"""
WITH l AS (SELECT * FROM {layout_pages.values(layout_pages.LISTS, "layout, url, shown, kind")}),
p AS (SELECT CAST(page_id AS VARCHAR) AS n, {_FIRST[0]} AS a, {_LAST[0]} AS b FROM pages),
x AS (SELECT l.*, p.*, CASE kind WHEN 'period' THEN TRUE WHEN 'later' THEN b > DATE '{_LIST_DAY}' WHEN 'range' THEN a <> b ELSE FALSE END AS period FROM p, l)
SELECT layout || '/' || n AS page_id, n AS uniq_id, 'T' || n AS title,
  CASE WHEN kind = 'range' AND NOT period THEN strftime(a, '%Y-%m-%d') ELSE replace(replace(shown, '{{d}}', strftime(a, '%Y-%m-%d')), '{{e}}', strftime(b, '%Y-%m-%d')) END AS date,
  CAST(a AS DATE) AS start_date, replace(url, '{{n}}', n) AS detail_url, CASE WHEN period THEN 'DURATION' ELSE 'REGISTERED' END AS date_type FROM x""")
def list_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of each of the 31 list layouts for every page's number, through the whole list extraction."""
    made = layout_pages.list_pages(_table(spark, sf_dir, "pages"), "page_id", F.expr(_FIRST[1]), F.expr(_LAST[1]))
    return extract.list_items(made, F.lit(_LIST_DAY).cast("date")).select("page_id", "uniq_id", "title", "date", "start_date", "detail_url", "date_type")


@query(f"""
WITH l AS (SELECT * FROM {layout_pages.values(layout_pages.DETAILS, "layout, files, images")}),
p AS (SELECT page_id, CAST(page_id AS VARCHAR) AS n FROM pages)
SELECT page_id, layout, CASE WHEN files = 'journal' THEN '## 논문 목록' || chr(10) || chr(10) || n || '. **T' || n || '**' || chr(10) || '   저자: kim'
    ELSE '## head ' || n || chr(10) || chr(10) || '**bold** and [link](/a?b=' || n || ')' || chr(10) || chr(10) || '*   one' || chr(10) || '*   two' || CASE WHEN page_id % 2 = 0 THEN chr(10) || chr(10) || '![](/i' || n || '.png)' ELSE '' END END AS detail_content,
  CASE files WHEN 'yes' THEN TRUE WHEN 'journal' THEN TRUE WHEN 'no' THEN FALSE ELSE page_id % 3 = 0 END AS has_attached_file, images AND page_id % 2 = 0 AS has_attached_image FROM p, l""")
def detail_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of each of the 25 detail layouts for every page's number: flags and Markdown."""
    n = F.col("page_id").cast("string")
    image = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<p><img src="/i'), n, F.lit('.png"></p>'))).otherwise("")
    content = F.concat(F.lit("<h2>head "), n, F.lit('</h2><p><b>bold</b>\n and <a href="/a?b='), n, F.lit('">link</a></p><ul><li>one</li><li>two</li></ul>'), image)
    made = layout_pages.detail_pages(_table(spark, sf_dir, "pages"), "page_id", content, F.col("page_id") % 3 == 0)
    return extract.details(made).select("page_id", "layout", "detail_content", "has_attached_file", "has_attached_image")


# --- repositories -------------------------------------------------------------------------------------


def _article_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("u/"), "doc_id").alias("detail_url"), F.col("doc_id").cast("string").alias("uniq_id"), F.col("lang").alias("target_id"), F.col("source").alias("group_id"), F.lit(7).alias("task_id"))


@query("""
SELECT source AS group_id, lang AS target_id, 7 AS task_id, count(*) AS n_articles, (SELECT count(*) FROM documents) AS n_saved, 0 AS n_again FROM documents GROUP BY source, lang""")
def save_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles saved with their context, once more to no effect, and read back from the store."""
    store = Store(spark, scratch_root(spark))
    first, again = store.save_articles(_article_rows(spark, sf_dir)), store.save_articles(_article_rows(spark, sf_dir))
    held = store.read("articles").groupBy("group_id", "target_id", F.col("task_id").cast("int").alias("task_id")).agg(F.count("*").alias("n_articles"))
    return held.select("*", F.lit(first).cast("long").alias("n_saved"), F.lit(again).alias("n_again"))


@query("""
SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 0 UNION ALL SELECT -1 UNION ALL SELECT -2""")
def save_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An issue saved with the articles of quality 1 as used, twice to one effect: candidates that are left, the issue (-1), the next number (-2)."""
    store = Store(spark, scratch_root(spark))
    store.save_articles(_article_rows(spark, sf_dir))
    labels = _table(spark, sf_dir, "labels").select(F.concat(F.lit("u/"), "doc_id").alias("detail_url"), F.col("quality").cast("int").alias("score"))
    store.append("analysis", labels)
    used = labels.where("score = 1")
    issue = spark.createDataFrame([("n1", 1, "t", "h")], "id string, issue_order int, title string, html string")
    names = [store.save_newsletter(issue, used) for _ in range(2)]
    left = store.find_candidates(catalog.score_floors(spark)).select(F.substring("detail_url", 3, 20).cast("long").alias("doc_id"))
    told = [(-1,)] * (names == ["n1", "n1"]) + [(-2,)] * (store.next_issue() == 2)
    return left.unionByName(spark.createDataFrame(told, "doc_id long"))


@query("SELECT CAST(row_number() OVER (ORDER BY r_regionkey) AS INTEGER) AS task_id, row_number() OVER (ORDER BY r_regionkey) < count(*) OVER () AS completed, 1 AS n_refused FROM region")
def task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each region, each started twice, which one start survives; all but the last are completed."""
    store, refused = Store(spark, scratch_root(spark)), []
    regions = [r["r_regionkey"] for r in _table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]  # a handful of rows
    for n, _ in enumerate(regions):
        task = store.create_task()
        try:
            store.create_task()
        except TaskRunning:
            refused.append((task, 1))
        if n < len(regions) - 1:
            store.complete_task(task)
    log = store.read("tasks").groupBy(F.col("task_id").cast("int").alias("task_id")).agg(F.max(F.col("completed_at").isNotNull()).alias("completed"))
    return log.join(spark.createDataFrame(refused, "task_id int, n_refused int"), "task_id", "left")


@query("SELECT d.doc_id, d.source FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def known_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose address isn't among the labelled ones: filters by bucket first, then the buckets that they can't rule out."""
    root = scratch_root(spark)
    filters = keyed.Filters(spark, f"{root}/filters")
    known = _table(spark, sf_dir, "labels").select(F.concat(F.lit("u/"), "doc_id").alias("detail_url"))
    filters.add(known, "detail_url")
    by_bucket = known.withColumn("bucket", keyed.bucket_of(F.col("detail_url"), filters.buckets))
    by_bucket.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/known")
    held = spark.read.schema("detail_url string, bucket int").parquet(f"{root}/known")
    asked = _table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("u/"), "doc_id").alias("detail_url"))
    return keyed.unknown(asked, filters, held, "detail_url").select("doc_id", "source")


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def analysis_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user, from a log that got them in ten appends and was folded in between."""
    log = keyed.KeyedLog(spark, scratch_root(spark), "user_id long, event_id long, event_type string", "user_id", "event_id", buckets=4, every=4)
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    for part in range(10):
        log.append(events.where(F.pmod(F.xxhash64("event_id"), F.lit(10)) == part))  # together they are all rows
    return log.read()


# --- crawling -----------------------------------------------------------------------------------------


@query(f"""
SELECT page_id, CASE length(url) % {mirror.TURN} WHEN {mirror.LOST} THEN NULL WHEN {mirror.MISSING} THEN 404 ELSE 200 END AS status,
  CASE length(url) % {mirror.TURN} WHEN {mirror.LOST} THEN 'OSError: no route' WHEN {mirror.MISSING} THEN 'HTTP 404' END AS error,
  CASE WHEN length(url) % {mirror.TURN} > 1 THEN '<title>' || url || '</title><p>' || CASE WHEN page_id % 3 = 0 THEN 'POST id=' || page_id ELSE 'GET ' END || '</p>' END AS html FROM pages""")
def fetch_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for every page, a third of them by form, under limits a host, from a getter that answers without a network: pages, missing ones, failures."""
    formed, n = F.col("page_id") % 3 == 0, F.col("page_id").cast("string")
    asked = _table(spark, sf_dir, "pages").select(n.alias("key"), "url", F.when(formed, "POST").otherwise("GET").alias("method"), F.when(formed, pages.form_body({"id": n})).alias("body"))
    return crawl.fetch_by_host(asked, mirror.fetcher()).select(F.col("key").cast("long").alias("page_id"), "status", "error", "html")


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^:/?#]*)', 1))"


@query(f"""
SELECT {_HOST} AS target_id, min(url) AS url, CASE length(min(url)) % {mirror.TURN} WHEN {mirror.LOST} THEN NULL WHEN {mirror.MISSING} THEN 404 ELSE 200 END AS status
FROM pages WHERE {_HOST} <> '' GROUP BY 1""")
def page_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first address of each host of the pages, read through the page source."""
    rows = _table(spark, sf_dir, "pages").groupBy(crawl.host(F.col("url")).alias("target_id")).agg(F.min("url").alias("url")).where("target_id <> ''")
    asked = rows.select("target_id", F.col("target_id").alias("key"), "url", F.lit("GET").alias("method"), F.lit(None).cast("string").alias("body"))
    return crawl.read_pages(spark, asked, "millrace.sources.mirror:FETCHER").select("target_id", "url", "status")


_BOARDS = "(SELECT *, CAST(row_number() OVER (ORDER BY pos) - 1 AS BIGINT) AS n FROM " + _TARGETS + " WHERE enabled)"


@query(f"""
WITH b AS {_BOARDS}, k AS (SELECT count(*) AS k FROM b)
SELECT b.group_id, b.target_id, b.target_name, b.url AS target_url, (SELECT count(*) FROM b AS o WHERE o.group_id = b.group_id) AS n_targets, count(d.doc_id) AS n_articles, 9 AS task_id
FROM b CROSS JOIN k LEFT JOIN documents d ON d.doc_id % k = b.n GROUP BY ALL""")
def article_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to the enabled boards in turn, with each board's group and address, counted; boards flattened from their groups, with the group's size."""
    boards = catalog.groups(spark).select(F.col("id").alias("group_id"), F.posexplode("targets").alias("at", "t"), F.size("targets").cast("long").alias("n_targets"))
    boards = boards.select("group_id", F.col("t.id").alias("target_id"), F.col("t.name").alias("target_name"), "n_targets")
    own = catalog.targets(spark)
    names = [r["target_id"] for r in own.orderBy("pos").collect()]  # a few dozen
    dealt = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % len(names) + 1).cast("int"))
    items = R.with_context(_table(spark, sf_dir, "documents").select("doc_id", dealt.alias("target_id")), own, 9)
    counts = items.groupBy("target_id", "group_id", "target_url", F.col("task_id").cast("int").alias("task_id")).agg(F.count("*").alias("n_articles"))
    held = boards.join(own.select("target_id", F.col("url").alias("target_url")), "target_id").join(counts.drop("target_url"), ["target_id", "group_id"], "left")
    return held.select("group_id", "target_id", "target_name", "target_url", "n_targets", F.coalesce("n_articles", F.lit(0)).alias("n_articles"), F.coalesce("task_id", F.lit(9)).alias("task_id"))


@query(f"""
WITH b AS {_BOARDS}, k AS (SELECT count(*) AS k FROM b),
a AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'nowhere' END AS gone, CASE WHEN page_id % 4 <> 0 THEN url WHEN page_id % 8 = 0 THEN '' END AS custom, CASE WHEN page_id % 3 <> 0 THEN url WHEN page_id % 6 = 0 THEN '' END AS detail, page_id % k AS n FROM pages, k)
SELECT page_id, coalesce(gone, b.target_id) AS target_id, CASE WHEN gone IS NOT NULL THEN 404 WHEN coalesce(detail, '') = '' THEN 400 ELSE 200 END AS status,
  CASE WHEN gone IS NOT NULL THEN 'no such board: ' || b.group_id || '/nowhere' WHEN coalesce(detail, '') = '' THEN 'the address of the detail page is missing' END AS error,
  CASE WHEN gone IS NULL AND coalesce(detail, '') <> '' THEN coalesce(nullif(custom, ''), b.url) END AS url FROM a JOIN b USING (n)""")
def board_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for a board's detail page for every page: boards that aren't there, addresses that stand in for the board's, missing details."""
    rows = [(r["group_id"], r["target_id"]) for r in catalog.targets(spark).orderBy("pos").collect()]  # a few dozen
    dealt = F.element_at(F.array(*[F.struct(F.lit(g).alias("g"), F.lit(t).alias("t")) for g, t in rows]), (F.col("page_id") % len(rows) + 1).cast("int"))
    given = lambda by, twice: F.when(F.col("page_id") % by != 0, F.col("url")).when(F.col("page_id") % twice == 0, "")
    asked = _table(spark, sf_dir, "pages").select(
        "page_id", dealt["g"].alias("group_id"), F.when(F.col("page_id") % 5 == 0, "nowhere").otherwise(dealt["t"]).alias("target_id"), given(4, 8).alias("custom_url"), given(3, 6).alias("detail_url")
    )
    return catalog.answered(asked, needs_detail=True).select("page_id", "target_id", "status", "error", "url")


@query(r"""
SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), '1') AS page_no FROM pages""")
def defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", S.or_else(S.query_param(F.col("url"), "page"), F.lit("1")).alias("page_no"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", S.json_fields(F.col("props"), "k long")["k"].alias("k"))


# --- streams with state -------------------------------------------------------------------------------


def _streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files. A table that is one file is no folder, which a stream takes only by a pattern."""
    return spark.readStream.schema(_table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _ran(spark: SparkSession, stream: DataFrame) -> DataFrame:
    root = scratch_root(spark)
    stateful.appended(stream, f"{root}/rows", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


#: Seconds for which a fetched page answers, in the query over events.
_HELD = 12 * 3600


@query(f"""
WITH RECURSIVE f(user_id, since) AS (SELECT user_id, min(ts) FROM events GROUP BY user_id
  UNION ALL SELECT f.user_id, min(e.ts) FROM f JOIN events e ON e.user_id = f.user_id AND e.ts >= f.since + INTERVAL {_HELD} SECOND GROUP BY f.user_id),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS k FROM events)
SELECT event_id, NOT (k = 1 AND f.since IS NOT NULL) AS hit FROM r LEFT JOIN f ON f.user_id = r.user_id AND f.since = r.ts""")
def request_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of requests by user: which of them a page fetched in the twelve hours before answers."""
    asked = _streamed(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return _ran(spark, stateful.cached(asked, _HELD)).select(F.col("id").alias("event_id"), "hit")


@query("""
WITH RECURSIVE s AS (SELECT source, d.doc_id, l.quality * 5 + l.toxic * 4 AS score, row_number() OVER (PARTITION BY source ORDER BY d.doc_id) AS k FROM documents d JOIN labels l USING (doc_id)),
w(source, k, doc_id, score, n, issue) AS (SELECT source, k, doc_id, score, 1, 1 FROM s WHERE k = 1
  UNION ALL SELECT s.source, s.k, s.doc_id, s.score, CASE WHEN w.n > 5 OR w.score >= 8 THEN 1 ELSE w.n + 1 END, w.issue + CASE WHEN w.n > 5 OR w.score >= 8 THEN 1 ELSE 0 END FROM w JOIN s ON s.source = w.source AND s.k = w.k + 1)
SELECT source, CAST(issue AS BIGINT) AS issue, count(*) AS n_articles, CAST(max(score) AS INTEGER) AS max_score, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids
FROM w GROUP BY source, issue HAVING max(n) > 5 OR max(score) >= 8""")
def waiting_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as a stream by their ids: the issues of each source, whose candidates wait until the gate opens."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 5 + F.col("toxic") * 4).alias("score"))
    rows = _streamed(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id")
    scored = rows.select(F.col("source").alias("grp"), F.col("doc_id").alias("id"), "score", F.timestamp_seconds(F.col("doc_id") + 86400).alias("at"))
    return _ran(spark, stateful.issues(scored)).select(F.col("grp").alias("source"), "issue", "n_articles", "max_score", F.array_join("ids", ",").alias("ids"))


# --- analysis and issues ------------------------------------------------------------------------------

#: Words that the stand-in for a model looks for, with what they add to a score.
_WORDS = {"the": 2, "license": 3, "der": 1, "que": 4}


@query(f"""
WITH k AS (SELECT * FROM (VALUES {", ".join(f"('{w}', {n})" for w, n in _WORDS.items())}) AS v(word, n)),
m AS (SELECT doc_id, string_agg(word, ',' ORDER BY word) AS tags, sum(n) AS n FROM documents JOIN k ON contains(source || ' ' || coalesce(text, ''), word) GROUP BY doc_id)
SELECT d.doc_id, coalesce(m.tags, '') AS tags, CAST(least(10, 1 + coalesce(m.n, 0)) AS INTEGER) AS score FROM documents d LEFT JOIN m USING (doc_id)""")
def analyse_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and score of every document by an analyst that looks for words."""
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("detail_url"), F.col("source").alias("title"), F.col("text").alias("detail_content"), F.lit(False).alias("has_attached_image"))
    found = pipeline.analyse(rows, pipeline.KeywordAnalyst(_WORDS), [])
    return found.select(F.col("detail_url").cast("long").alias("doc_id"), F.array_join("tags", ",").alias("tags"), "score")


def _page_sql() -> str:
    """The page with its sources from the catalogue's values, as a text of SQL."""
    numbers = {"enough": R.ARTICLES + 1, "few": R.ARTICLES, "priority": R.PRIORITY, "unsubscribe": render.UNSUBSCRIBE, "title": render.TITLE, "content": render.CONTENT}
    before, after = render.PAGE.safe_substitute(numbers).split("$sources")
    return f"{_quoted(before)} || (SELECT sources FROM src) || {_quoted(after)}"


@query(f"""
WITH src AS ({ORACLES["render_sources"]}),
{_SCORED},
t AS (SELECT source, lang, count(*) AS n, string_agg('<p>' || doc_id || ': ' || effective_score || '</p>', chr(10) ORDER BY doc_id) AS content FROM s GROUP BY source, lang HAVING count(*) > 5 OR max(effective_score) >= 8)
SELECT source, lang, replace(replace({_page_sql()}, '{render.TITLE}', source || ' & ' || lang || ': ' || n), '{render.CONTENT}', content) AS html FROM t""")
def issue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An issue's page for every source and language whose gate is open, from its articles."""
    rows, by = _scored(spark, sf_dir), ["source", "lang"]
    opened = R.publication_gate(rows, by).where("publish").select(*by, "n_articles")
    part = F.concat(F.lit("<p>"), F.col("doc_id").cast("string"), F.lit(": "), F.col("effective_score").cast("string"), F.lit("</p>"))
    texts = R.rolled_up(rows.join(opened, by).withColumn("grp", F.struct(*by, "n_articles")), "grp", "doc_id", part, "\n").select("grp.*", "text")
    page = render.template(catalog.targets(spark))
    title = F.concat("source", F.lit(" & "), "lang", F.lit(": "), F.col("n_articles").cast("string"))
    return texts.select(*by, render.rendered(page, title, F.col("text")).alias("html"))


# --- odd list pages, and lists in SQL ------------------------------------------------------------------

#: Kind of page, layout, page.
_ODD = [
    ("pinned", "heritage_agency", "<table class='board_list'><thead><tr><th>no</th></tr></thead><tbody><tr class='top'><td>1<td><a href='/p?bbIdx=0'>pinned</a></tr><tr><th>head</th></tr><tr><td>2<td><a href='/p?bbIdx={n}'>t</a><td><td><td>2024.01.01</tr></tbody></table>"),
    ("absolute", "kaah", "<table class='board-table-list'><tbody><tr><td>1<td><a href='/news/{n}'>t</a><td><td>2024.01.01</tr><tr><td>1<td><a href='https://www.kaah.kr/news/{n}'>t</a><td><td>2024.01.01</tr></tbody></table>"),
    ("no address", "kras", "<table><tbody><tr><td>1<td><a>none</a><td><td><td>2024.01.01</tr><tr><td>1<td><a href=''>empty</a><td><td><td>2024.01.01</tr><tr><td>1<td><a href='/?m=bbs&uid={n}'>t</a><td><td><td>2024.01.01</tr></tbody></table>"),
    ("malformed", "kras", "<table><![foo[x]]><tbody><tr><td>1<td></b></i><a href='/?m=bbs&uid={n}'>t</a><td><td><td>2024.01.01</tr></tbody>"),
    ("unknown", "nope", "<p>{n}</p>"),
    ("empty", "kras", "<table></table>"),
]


@query("""
WITH k AS (SELECT * FROM (VALUES ('pinned', 1, 'https://www.kh.or.kr/p?bbIdx='), ('absolute', 1, NULL), ('absolute', 2, 'https://www.kaah.kr/news/'), ('no address', 3, 'https://www.kras.or.kr/?m=bbs&uid='),
  ('malformed', 1, 'https://www.kras.or.kr/?m=bbs&uid='), ('unknown', NULL, NULL)) AS v(kind, pos, addr))
SELECT kind || '/' || page_id AS page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN addr IS NOT NULL THEN CAST(page_id AS VARCHAR) END AS uniq_id, addr || page_id AS detail_url,
  CASE WHEN kind = 'unknown' THEN 'no such layout: nope' WHEN addr IS NULL THEN 'the address is neither absolute nor has it a base' END AS error FROM pages, k""")
def list_odd_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List pages with rows that are skipped, pinned, headless or fail, one of each kind for every page's number."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(layout).alias("layout"), F.lit(html).alias("html")) for k, layout, html in _ODD])
    made = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("n"), F.explode(kinds).alias("k"))
    own = made.select(F.concat_ws("/", "k.kind", "n").alias("page_id"), F.replace(F.col("k.html"), F.lit("{n}"), F.col("n")).alias("html"), F.col("k.layout").alias("list_spec"), F.create_map().cast("map<string,string>").alias("params"))
    return extract.list_items(own, F.lit(_LIST_DAY).cast("date")).select("page_id", "pos", "uniq_id", "detail_url", "error")


@query(ORACLES["list_layouts"])
def list_layouts_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`list_layouts` with its rows from a table function in SQL."""
    made = layout_pages.list_pages(_table(spark, sf_dir, "pages"), "page_id", F.expr(_FIRST[1]), F.expr(_LAST[1]))
    extract.register(spark)
    made.createOrReplaceTempView("board_pages")
    return extract.finished(spark.sql(extract.RAW_SQL), F.lit(_LIST_DAY).cast("date")).select("page_id", "uniq_id", "title", "date", "start_date", "detail_url", "date_type")
