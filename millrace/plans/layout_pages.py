"""A small page of every board layout with what it must give, to run all layouts over a table.

``{n}`` stands for a row's number, ``{d}`` and ``{e}`` for its days as boards write them, ``{c}`` for content and ``{f}`` for an attachment,
which only some rows have. The expected forms are written out here and don't come from the layouts' records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parameters of a board, where a layout takes some.
PARAMS = {"menu": "m1", "bbs": "b2", "contents": "c3", "prefix": "/pre", "list": "9"}


def _table(head: str, row: str) -> str:
    return f"{head}<tbody><tr>{row}</tr></tbody></table>"


def _cells(*cells: str, tag: str = "td") -> str:
    return "".join(f"<{tag}>{c}</{tag}>" for c in cells)


_A = lambda href, text="T{n}", more="": f'<a href="{href}"{more}>{text}</a>'
_EXC = lambda *cells: _table('<table class="td_left">', _cells(*cells)).replace("<tr>", '<tr class="list_tr">')
_CALL = lambda call, text="x", more="": f"<a href=\"#\" onclick=\"{call}('{{n}}')\"{more}>{text}</a>"
_UL = lambda *cells: f'<div class="board-list-tbody"><ul>{_cells(*cells, tag="li")}</ul></div>'
_TITLE = ' title="T{n}"'

#: Layout, page, expected address, expected date, and what kind of date it is.
LISTS = [
    ("khs", _table('<table class="list_t01">', _cells("1", _A("/v.do?id={n}&pageIndex=2", "x", _TITLE), "", "{d}", "{e}")), "https://www.khs.go.kr/v.do?id={n}", "{d}", "later"),
    ("khs_gallery", '<ul class="photo_board"><li><a href="/g.do?nttId={n}"><div><img alt="T{n}"></div><div><strong>s</strong></div><div><span>{d}</span></div></a></li></ul>', "https://www.khs.go.kr/g.do?nttId={n}", "{d}", "day"),
    ("khs_law", _table('<table class="b_list">', _cells("1", _A("/l.do?id={n}", "x", _TITLE), "", "", "{d} ~ {e}")), "https://www.khs.go.kr/l.do?id={n}", "{d} ~ {e}", "period"),
    ("excavation_status", _EXC("1", _CALL("dataSelected", "x", _TITLE), "", "", "{d}"), "https://www.e-minwon.go.kr/ge/ee/getEcexmPrmsnAply.do?ecexmRcno={n}", "{d}", "day"),
    ("excavation_report", _EXC("1", "", _CALL("dataSelected", "x", _TITLE), "", "", "", "{d}"), "https://www.e-minwon.go.kr/ge/ee/getEcexmRptp.do?ecexmRcno={n}", "{d}", "day"),
    ("excavation_site", _EXC("1", _CALL("dataSelected", "x", _TITLE), "", "", "{d}"), "https://www.e-minwon.go.kr/ge/ee/getLinkGrndsRls.do?grndsRlsSeqc={n}", "{d}", "period"),
    ("nrich_notice", _table('<table class="table-list">', _cells("1", _A("v.do?bbs_idx={n}", "x", _TITLE), "", "{d}")), "https://www.nrich.go.kr/kor/v.do?bbs_idx={n}", "{d}", "day"),
    ("nrich_event", "<ul class=\"event-list\"><li><a onclick=\"fnViewPage('{n}')\"><strong><span>on</span>T{n}</strong><span class=\"date\">행사기간 : {d} ~ {e}</span></a></li></ul>", "https://www.nrich.go.kr/kor/majorView.do?menuIdx=286&bbs_idx={n}", "{d} ~ {e}", "range"),
    ("nrich_journal", _table('<table class="table-list">', _cells("1", _A("/j.do?bbs_idx={n}", "x", _TITLE), "{d}")), "https://www.nrich.go.kr/j.do?bbs_idx={n}", "{d}", "day"),
    ("nrich_portal", _table('<table class="tbl02">', _cells("1", _A("p.do?bbs_idx={n}", "x", _TITLE), "{d}")), "https://portal.nrich.go.kr/kor/p.do?bbs_idx={n}", "{d}", "day"),
    ("gogung", _table('<table class="board-list">', _cells("1", _A("v.do?boardId={n}"), "", "{d}")), "https://www.gogung.go.kr/gogung/bbs/BMSR00022/v.do?boardId={n}", "{d}", "day"),
    ("heritage_agency", _table('<table class="board_list">', _cells("1", _A("/v.do?bbIdx={n}", "x", _TITLE), "", "", "{d}")), "https://www.kh.or.kr/v.do?bbIdx={n}", "{d}", "day"),
    ("kaah", _table('<table class="board-table-list">', _cells("1", _A("https://www.kaah.kr/news/{n}"), "", "{d}")), "https://www.kaah.kr/news/{n}", "{d}", "day"),
    ("kaah_place", '<div class="page-con-box"><div class="data-list"><div class="year">{y}</div><div class="date">{m}</div><div class="con"><div><a href="https://www.kaah.kr/place/{n}">T{n}</a></div></div></div></div>', "https://www.kaah.kr/place/{n}", "{d}", "day"),
    ("kras", _table("<table>", _cells("1", _A("/?m=bbs&uid={n}"), "", "", "{d}")), "https://www.kras.or.kr/?m=bbs&uid={n}", "{d}", "day"),
    ("jbgogo", _table('<table class="table_list">', _cells("1", f'<div>{_A("/b/{n}")}</div>', "", "{d}")), "https://www.jbgogo.or.kr/b/{n}", "{d}", "day"),
    ("hsas", _table('<table id="bbs_list">', _cells("1", _A("./?ref=b&eb_idx={n}"), "", "{s}")), "http://www.hsas.or.kr/flow/?ref=b&eb_idx={n}", "{d}", "day"),
    ("yngogo", _table('<table class="basic-table01">', _cells("1", "<a onclick=\"fnView('{n}', 'admin', '')\">T{n}</a>", "", "{d}")), "http://www.yngogo.or.kr/subList/m1?pmode=detail&nttSeq={n}&bbsSeq=b2&sitecntntsSeq=c3", "{d}", "day"),
    ("museum", _UL("1", "", "", _A("?arcId={n}"), "", "{d}"), "https://www.museum.go.kr/pre?arcId={n}", "{d}", "day"),
    ("museum_press", _UL("1", _A("?arcId={n}"), "", "{d}"), "https://www.museum.go.kr/MUSEUM/contents/M0701040000.do?arcId={n}", "{d}", "day"),
    ("museum_recruit", _UL("1", "", _A("?arcId={n}"), "{d}~ {e}"), "https://www.museum.go.kr/MUSEUM/contents/M0701030000.do?arcId={n}", "{d} ~ {e}", "period"),
    ("jeonju_museum", _table('<table class="tstyle_list">', _cells("1", _A("/v.do?list_no={n}"), "", "{d}")), "https://jeonju.museum.go.kr/v.do?list_no={n}", "{d}", "day"),
    ("jeonju_museum_recruit", _table('<table class="tstyle_list">', _cells("1", _A("/v.do?list_no={n}"), "{d} ~ {e}")), "https://jeonju.museum.go.kr/v.do?list_no={n}", "{d} ~ {e}", "period"),
    ("buyeo_museum", _table('<table class="tableType1">', "<td>1</td><td onclick=\"goView('{n}')\"><a><span>new</span>T{n}</a></td><td></td><td></td><td>{d}</td>"), "https://buyeo.museum.go.kr/bbs/view.do?pstSn={n}&key=9", "{d}", "day"),
    ("jinju_museum", _table("<table>", _cells("1", _A("?no={n}"), "", "", "{d}")), "https://jinju.museum.go.kr/kor/html/sub06/0601.html?no={n}", "{d}", "day"),
    ("gyeongju_museum", _table("<table>", _cells("1", _A("?no={n}"), "", "", "{d}")), "https://gyeongju.museum.go.kr/pre?no={n}", "{d}", "day"),
    ("gyeongju_museum_notice", _table("<table>", _cells("1", "", "", _A("?no={n}"), "", "{d}")), "https://gyeongju.museum.go.kr/kor/html/sub07/0703.html?no={n}", "{d}", "day"),
    ("cheongju_museum", _table('<table class="bbs_default_list">', _cells("1", _A("./v.do?nttNo={n}"), "", "", "{d}")), "https://cheongju.museum.go.kr/www/v.do?nttNo={n}", "{d}", "day"),
    ("gimhae_museum", _table('<table class="board_list">', _cells("1", _A("?no={n}"), "", "", "", "{d}")), "https://gimhae.museum.go.kr/pre?no={n}", "{d}", "day"),
    ("jeju_museum", f'<div class="board_list">{_table("<table>", _cells("1", _A("./v.do?no={n}"), "", "{d}"))}</div>', "https://jeju.museum.go.kr/_prog/_board/v.do?no={n}", "{d}", "day"),
    ("iksan_museum", f'<div class="bd_list_wrap">{_table("<table>", _cells("1", _A("?no={n}"), "", "", "", "{d}"))}</div>', "https://iksan.museum.go.kr/kor/html/sub05/0501.html?no={n}", "{d}", "day"),
]

_VIEW = lambda before: '<table class="table-view"><tbody>' + "<tr><td>x</td></tr>" * before + "<tr><td>{c}</td></tr>"
_ATTACHED = lambda content, attached: f"<section>{content}</section>{{f:{attached}}}"

#: Layout, page, whether it has attachments (yes, no, if it has one; not for the flag that is inverted), and whether images count.
#: ``{f:x}`` stands for x in pages with an attachment and for nothing in others.
DETAILS = [
    ("khs", _ATTACHED('<div class="b_content">{c}</div>', '<dl class="b_file"><dd><ul><li>f</li></ul></dd></dl>'), "if", True),
    ("excavation_status", '<div><table class="td_left"><tr><td>{c}</td></tr></table></div>', "no", False),
    ("excavation_report", '<div><table class="td_left"><tr><td>{c}</td></tr><tr><td>gone</td></tr></table></div>', "yes", False),
    ("excavation_site", '<section><div class="board_view">{c}<dl><dt>gone</dt></dl></div></section>', "yes", False),
    ("nrich_notice", _VIEW(3) + "{f:<tr><td>file</td></tr>}</tbody></table>", "if", True),
    ("nrich_event", _VIEW(4) + "</tbody></table>", "no", True),
    ("nrich_journal", '<table class="table-list"><tbody><tr><td>{n}</td><td><a>T{n}</a></td><td>kim</td></tr><tr><td>2</td><td><a>no author</a></td><td></td></tr></tbody></table>', "journal", False),
    ("nrich_portal", '<div class="detail_Area2">{c}</div>', "no", True),
    ("gogung", _ATTACHED('<div class="content-wrap">{c}</div>', '<div class="file-list">f</div>'), "if", True),
    ("heritage_agency", _ATTACHED('<div class="view_con">{c}</div>', '<div class="tbl_file"><p>f</p></div>'), "if", True),
    ("kaah", _ATTACHED('<div class="content">{c}</div>', '<div class="board-view-file"><div class="file-list">f</div></div>'), "if", True),
    ("kaah_place", _ATTACHED('<div class="board-view-top">{c}</div>', '<div class="board-view-file"><div class="file-list">f</div></div>'), "if", True),
    ("kras", _ATTACHED('<div id="vContent">{c}<div class="snsbox">share</div></div>', '<div class="attach"><ul><li>f</li></ul></div>'), "if", True),
    ("jbgogo", _ATTACHED('<div class="upload_contents">{c}<div class="snsbox">share</div></div>', '<div class="item_box"><a class="btn_file">f</a></div>'), "if", True),
    ("hsas", '<div id="view_content">{c}</div>', "no", True),
    ("yngogo", _ATTACHED('<div class="conM_txt">{c}</div>', '<div id="atchFile_div">f</div>'), "if", True),
    ("museum", _ATTACHED('<div class="viewStyle1">{c}</div>', '<div class="flie-down-area"><ul><li>f</li></ul></div>'), "if", True),
    ("jeonju_museum", _ATTACHED('<div class="contents">{c}</div>', '<div class="file"><ul class="list"><li>f</li></ul></div>'), "if", True),
    ("buyeo_museum", _ATTACHED('<div class="cont">{c}</div>', '<div class="attachmentWrap"><ul class="noList"><li>f</li></ul></div>'), "if", True),
    ("jinju_museum", _ATTACHED('<div class="bbs--view--content">{c}</div>', '<div class="bbs--view--file">f</div>'), "if", True),
    ("gyeongju_museum", _ATTACHED('<div class="bd_detail_cont">{c}</div>', '<div class="bd_detail_file"><ul class="file"><li>f</li></ul></div>'), "if", True),
    ("cheongju_museum", '<table><tbody><tr><td class="content">{c}</td></tr>{f:<tr class="FILE"><td><p>f</p></td></tr>}</tbody></table>', "if", True),
    ("gimhae_museum", _ATTACHED('<div class="bbs--view--content">{c}</div>', '<div class="bbs--view--file">f</div>'), "if", True),
    ("jeju_museum", _ATTACHED('<div class="board_viewDetail">{c}</div>', '<ul><li class="file"><div><a>f</a></div></li></ul>'), "if", True),
    ("iksan_museum", _ATTACHED('<div class="bd_detail_cont">{c}</div>', '<ul class="file"><li>f</li></ul>'), "if", True),
]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """The rows as SQL, without the pages."""
    shown = lambda x: str(x).upper() if isinstance(x, bool) else _quoted(x)
    return f"(VALUES {', '.join('(' + ', '.join(shown(x) for i, x in enumerate(r) if i != 1) + ')' for r in rows)}) AS l({columns})"


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows in even shares, four for each core: a scan's shares go by bytes of the file, but a number's work is its pages of all layouts."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def _each(rows: DataFrame, layouts: list[tuple]) -> DataFrame:
    """Every row once for each layout, with the layout's name and page."""
    return rows.select("*", F.explode(F.array(*[F.struct(F.lit(x[0]).alias("layout"), F.lit(x[1]).alias("page")) for x in layouts])).alias("l")).select("*", "l.*").drop("l")


def _filled(page: Column, values_of: dict[str, Column]) -> Column:
    for name, value in values_of.items():
        page = F.replace(page, F.lit(f"{{{name}}}"), value)
    return page


def list_pages(rows: DataFrame, number: str, first: Column, last: Column) -> DataFrame:
    """``(page_id, layout, html, list_spec, params)``: each row's page of every list layout."""
    shown = lambda c, form: F.date_format(c, form)
    own = {"n": F.col(number).cast("string"), "d": shown(first, "yyyy.MM.dd"), "e": shown(last, "yyyy.MM.dd"), "y": shown(first, "yyyy"), "m": shown(first, "MM.dd"), "s": shown(first, "yy.MM.dd")}
    made = _each(_dealt(rows).select(number, *[v.alias(f"v_{k}") for k, v in own.items()]), LISTS)
    html = _filled(F.col("page"), {k: F.col(f"v_{k}") for k in own})
    params = F.create_map(*[F.lit(x) for kv in PARAMS.items() for x in kv])
    return made.select(F.concat_ws("/", "layout", number).alias("page_id"), html.alias("html"), F.col("layout").alias("list_spec"), params.alias("params"))


def detail_pages(rows: DataFrame, number: str, content: Column, attached: Column) -> DataFrame:
    """``(number, layout, html, detail_spec)``: each row's page of every detail layout."""
    made = _each(_dealt(rows).select(number, content.alias("v_c"), attached.alias("v_f")), DETAILS)
    html = F.when(F.col("v_f"), F.regexp_replace("page", r"\{f:([^}]*)\}", "$1")).otherwise(F.regexp_replace("page", r"\{f:[^}]*\}", ""))
    html = _filled(html, {"c": F.col("v_c"), "n": F.col(number).cast("string")})
    return made.select(number, "layout", html.alias("html"), F.col("layout").alias("detail_spec"))
