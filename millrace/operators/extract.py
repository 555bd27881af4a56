"""Extraction of typed relations from raw pages.

Walking the HTML tree is the one thing that built-in functions can't do; it happens in two Arrow UDFs that
return raw strings by layout. Ids, addresses, dates and their kinds follow in columns, from the table of
layouts, so that Catalyst sees and prunes them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import scalars as S
from millrace.functions.addresses import clean_address
from millrace.functions.dom import Node, markdown, parse, trim
from millrace.sources import catalog
from millrace.sources.specs import DETAIL_SPECS, LIST_SPECS, DetailSpec, ListSpec

RAW_ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("href", "on_click", "title", "date", "end_date", "error")])
DETAIL = T.StructType([T.StructField("detail_content", T.StringType()), T.StructField("has_attached_file", T.BooleanType()), T.StructField("has_attached_image", T.BooleanType()), T.StructField("error", T.StringType())])
ARROW_ITEMS = pa.list_(pa.struct([(n, pa.string()) for n in RAW_ITEM.names]))
ARROW_DETAIL = pa.struct([(f.name, pa.bool_() if f.dataType == T.BooleanType() else pa.string()) for f in DETAIL])
#: Pages whose results are Python objects at once.
SLICE = 200

# --- lists --------------------------------------------------------------------------------------------


def _texts(nodes: list[Node]) -> str:
    return "".join(n.text() for n in nodes)


def _without(nodes: list[Node], tags: set[str], deep: bool) -> str:
    return "".join(n.text(frozenset(tags), deep) for n in nodes)


def _title(spec: ListSpec, cell: Node, anchors: list[Node], cells: list[Node]) -> str:
    if spec.mode == "attr" and anchors and "title" in anchors[0].attrs:
        return trim(anchors[0].attrs["title"])
    if spec.mode == "bare":
        return trim(_without(anchors, {"span", "i"}, True)) or trim(anchors[0].attrs.get("title", "") if anchors else "")
    if spec.mode == "image":
        image = cells[0].first("img") if cells else None
        return (image.attrs.get("alt", "") if image else "") or _texts(cell.find("strong"))
    if spec.mode == "strong":
        return trim(_without(cell.find("strong"), {"span"}, False))
    return trim(_texts(anchors))


def _row(spec: ListSpec, row: Node) -> dict | None:
    cells = row.find(spec.cells) if spec.cells else [row]
    if not cells:
        return None
    empty = Node("", {}, None)
    cell = cells[spec.title_col] if spec.title_col < len(cells) else empty
    anchors = cell.find(spec.anchor) if spec.anchor else [row]
    dated = cells[spec.date_col] if spec.date_col < len(cells) else empty
    if spec.date_part:
        date = "-".join(trim(_texts(dated.find(p))) for p in spec.date_part.split("|"))
    else:
        date = trim(dated.text())
    end = cells[spec.end_col] if 0 <= spec.end_col < len(cells) else empty
    called = cell if spec.call_on_cell else anchors[0] if anchors else empty
    return {
        "href": anchors[0].attrs.get("href") if anchors else None,
        "on_click": called.attrs.get("onclick") or "",
        "title": _title(spec, cell, anchors, cells),
        "date": date,
        "end_date": trim(end.text()),
    }


def page_rows(page: str | None, layout: str | None) -> list[dict]:
    """A page's rows of RAW_ITEM; one row with an error for a page that fails or whose layout isn't known."""
    spec = LIST_SPECS.get(layout)
    if spec is None:
        return [{"error": f"no such layout: {layout}"}]
    try:
        found = [_row(spec, r) for r in parse(page or "").find(spec.rows) if not spec.skip_class or spec.skip_class not in r.classes()]
    except Exception as e:  # a page's failure is a row, not the job's end
        return [{"error": f"{type(e).__name__}: {e}"}]
    return [r for r in found if r is not None]


def _by_slices(kind: pa.DataType, of: Callable[[str | None, str | None], object], html: pa.Array, layout: pa.Array) -> pa.Array:
    """``of`` each page. Its result is Python objects, which take many times what they take as Arrow: those of ``SLICE`` pages stand at once."""
    done = []
    for at in range(0, len(html), SLICE):
        pages = zip(html.slice(at, SLICE).to_pylist(), layout.slice(at, SLICE).to_pylist(), strict=True)
        done.append(pa.array([of(p, n) for p, n in pages], kind))
    return pa.concat_arrays(done) if done else pa.array([], kind)


@F.arrow_udf(T.ArrayType(RAW_ITEM))
def raw_items(html: pa.Array, layout: pa.Array) -> pa.Array:
    return _by_slices(ARROW_ITEMS, page_rows, html, layout)


class ListRows:
    """Rows of a page in its order, for SQL: ``LATERAL list_rows(html, layout)``."""

    def eval(self, html: str | None, layout: str | None):  # noqa: D102, ANN201
        for n, r in enumerate(page_rows(html, layout)):
            yield n, *[r.get(c) for c in RAW_ITEM.names]


def register(spark: SparkSession) -> None:
    """Names ``list_rows(html, layout)`` and the table ``list_layout_rules`` for SQL of this session."""
    kind = T.StructType([T.StructField("n", T.IntegerType()), *RAW_ITEM.fields])
    # Pickled: by Arrow each page's rows are a batch of their own, which takes longer than parsing them; Arrow's own table functions can't stand in LATERAL.
    spark.udtf.register("list_rows", F.udtf(ListRows, returnType=kind, useArrow=False))
    catalog.list_specs(spark).createOrReplaceTempView("list_layout_rules")


#: Rows of a view ``board_pages (page_id, html, list_spec, params)`` as :func:`finished` takes them.
RAW_SQL = """
SELECT p.page_id, p.params, p.list_spec, l.n, struct(l.href, l.on_click, l.title, l.date, l.end_date, l.error) AS r
FROM board_pages AS p, LATERAL list_rows(p.html, p.list_spec) AS l"""


def _filled(template: Column, ident: Column) -> Column:
    names = ["menu", "bbs", "contents", "prefix", "list"]
    filled = reduce(lambda t, n: F.replace(t, F.lit(f"{{{n}}}"), F.coalesce(F.col("params")[n], F.lit(""))), names, template)
    return F.replace(filled, F.lit("{id}"), F.coalesce(ident, F.lit("")))


def _replace_first(c: Column, old: Column, new: Column) -> Column:
    at = F.call_function("locate", old, c)
    return F.when(at > 0, F.concat(F.substring(c, 1, at - 1), new, F.substring(c, at + F.length(old), F.length(c)))).otherwise(c)


def list_items(pages: DataFrame, as_of: Column) -> DataFrame:
    """All list rows of ``pages (page_id, html, list_spec, params)``, in page order by ``pos`` from 1.

    Columns: page_id, pos, uniq_id, title, date, start_date, end_date, detail_url, date_type, error. Rows that a
    layout skips are gone; a row whose address can't be made keeps its place with an error; a page that can't be
    read, or whose layout isn't known, is one row without place that holds nothing but its error. ``as_of``: the
    day against which ends of periods are seen.
    """
    return finished(pages.select("page_id", "params", "list_spec", F.posexplode(raw_items("html", "list_spec")).alias("n", "r")), as_of)


def finished(held: DataFrame, as_of: Column) -> DataFrame:
    """Typed rows from raw ones: ``(page_id, params, list_spec, n, r)``, r of RAW_ITEM and n its place from 0."""
    spec = F.broadcast(catalog.list_specs(held.sparkSession))  # one row per layout
    failed = F.col("r.error").isNotNull()
    rows = held.join(spec, "list_spec", "left").select("*", "r.*").where(failed | ~F.col("need_href") | (F.coalesce("href", F.lit("")) != ""))
    target = (
        F.when(F.col("url_rule") == "prefix", F.concat(_filled(F.col("url_arg"), F.lit("")), F.col("href")))
        .when(F.col("url_rule") == "replace", _replace_first(F.col("href"), F.col("url_arg"), F.col("url_to")))
        .otherwise(F.col("href"))
    )
    located = F.when(F.col("url_rule") == "absolute", F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), S.js_trim(target))).otherwise(S.resolve(target, F.col("origin")))
    rows = rows.withColumn("located", located)
    call = lambda f: S.call_argument(F.col("on_click"), f)
    ident = (
        F.when(F.col("id_rule") == "param", S.query_param(F.col("located"), F.col("id_arg")))
        .when(F.col("id_rule") == "segment", S.last_segment(F.col("located")))
        .when(F.col("id_rule") == "first", S.call_first(F.col("on_click"), "fnView"))
        .otherwise(F.when(F.col("id_arg") == "dataSelected", call("dataSelected")).when(F.col("id_arg") == "goView", call("goView")).otherwise(call("fnViewPage")))
    )
    rows = rows.withColumn("uniq_id", ident).where(failed | ~F.col("need_id") | (F.coalesce("uniq_id", F.lit("")) != ""))
    address = F.when(F.col("url_rule") == "template", F.concat("origin", _filled(F.col("url_arg"), F.col("uniq_id")))).otherwise(F.col("located"))
    text = S.js_trim(F.when(F.col("drop_text") != "", F.replace(F.col("date"), F.col("drop_text"), F.lit(""))).otherwise(F.col("date")))
    text = F.when(F.col("widen_tilde"), _replace_first(text, F.lit("~ "), F.lit(" ~ "))).otherwise(text)
    # Each step is a column of its own, so that no expression is written out again in the next.
    rows = rows.withColumns({"address": address, "shown": S.get_date(F.concat("date_prefix", text))})
    address, date = F.col("address"), F.col("shown")
    days = F.split(date, " ~ ")
    period = (
        (F.col("date_rule") == "duration")
        | ((F.col("date_rule") == "future") & S.is_after(F.col("end_date"), as_of))
        | ((F.col("date_rule") == "tilde") & F.contains(date, F.lit("~")))
        | ((F.col("date_rule") == "range") & (F.get(days, F.lit(1)).isNotNull()) & (F.get(days, F.lit(0)) != F.get(days, F.lit(1))))
    )
    rows = rows.withColumn("period", period)
    rows = rows.withColumn("shown", F.when((F.col("date_rule") == "range") & ~F.col("period"), F.get(days, F.lit(0))).otherwise(date))
    period, shown = F.col("period"), F.when(~failed, F.col("shown"))
    return rows.select(
        "page_id",
        F.when(~failed, F.col("n") + 1).alias("pos"),
        F.when(~failed, F.col("uniq_id")).alias("uniq_id"),
        "title",
        shown.alias("date"),
        S.start_date(shown).alias("start_date"),
        S.end_date(shown).alias("end_date"),
        F.coalesce(clean_address(F.when(F.col("clean"), address)), address).alias("detail_url"),
        F.when(~failed, F.when(period, "DURATION").otherwise("REGISTERED")).alias("date_type"),
        F.when(failed, F.col("error")).when(address.isNull(), "the address is neither absolute nor has it a base").alias("error"),
    )


# --- details ------------------------------------------------------------------------------------------


#: A journal issue's heading and the word before its authors.
HEADING, AUTHOR = "## 논문 목록", "저자"


def _journal(root: Node) -> str:
    for n in root.find("script, style"):
        n.remove()
    lines = []
    for row in root.find("table.table-list tbody tr"):
        cells = row.find("td")
        text = [trim(cells[i].text()) if i < len(cells) else "" for i in (0, 2)]
        title = trim(_texts(cells[1].find("a"))) if len(cells) > 1 else ""
        if title and text[1]:
            lines.append(f"{text[0]}. **{title}**\n   {AUTHOR}: {text[1]}")
    return "\n\n".join([HEADING, *lines]) if lines else ""


def _detail(spec: DetailSpec, page: str, compat: bool) -> dict:
    root = parse(page)
    if spec.journal:
        return {"detail_content": _journal(root), "has_attached_file": True, "has_attached_image": False}
    found = root.find(spec.content)
    rows = len(found)
    if spec.nth >= 0:
        found = found[spec.nth].find("td") if spec.nth < len(found) else []
    if spec.up:
        found = list({id(n.parent): n.parent for n in found if n.parent}.values())
    last = [x for n in found for x in n.find(spec.drop_last)] if spec.drop_last else []
    for x in [x for n in found for x in n.find(spec.drop)] if spec.drop else last[-1:]:
        x.remove()
    if spec.files.startswith("more:"):
        files = rows > int(spec.files[5:])
    else:
        files = spec.files == "yes" if spec.files in ("yes", "no") else bool(root.find(spec.files))
    if spec.inverted and compat:
        files = not files
    return {"detail_content": markdown(found[0] if found else None), "has_attached_file": files, "has_attached_image": spec.images and any(n.find("img") for n in found)}


def _detail_udf(compat: bool):
    def of(page: str | None, name: str | None) -> dict:
        spec = DETAIL_SPECS.get(name)
        if spec is None:
            return {"error": f"no such layout: {name}"}
        try:
            return _detail(spec, page or "", compat)
        except Exception as e:  # a page's failure is a row, not the job's end
            return {"error": f"{type(e).__name__}: {e}"}

    @F.arrow_udf(DETAIL)
    def details(html: pa.Array, layout: pa.Array) -> pa.Array:
        return _by_slices(ARROW_DETAIL, of, html, layout)

    return details


def details(pages: DataFrame, compat: bool = False) -> DataFrame:
    """``pages (html, detail_spec)`` with ``detail_content, has_attached_file, has_attached_image, error`` in place of these two.

    Other columns come along, so that nothing need be joined back. A page of an unknown layout is a row with an error.
    ``compat``: keep the one layout's attachment flag that is set where there is none.
    """
    rest = [c for c in pages.columns if c not in ("html", "detail_spec", *DETAIL.names)]
    return pages.select(*rest, _detail_udf(compat)("html", "detail_spec").alias("d")).select(*rest, "d.*")
