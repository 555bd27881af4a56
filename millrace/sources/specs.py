"""Extractor specifications as data: which board layouts exist, not how pages are walked.

Column numbers count from 0. Title modes: ``attr`` the title attribute if present, else the text; ``text`` the text;
``bare`` the text without badges, else the attribute; ``image`` the image's alt, else the strong text, untrimmed;
``strong`` the strong text without its spans.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ListSpec:
    """A list page: one page, many rows.

    ``ident``: (rule, argument), rule one of param, segment, call, first. ``url``: (rule, origin, argument, argument),
    rule one of resolve, prefix, replace, absolute, template; templates may name ``{id}`` and parameters.
    ``dates``: registered, duration, future (a later date in ``end_col``), tilde (a range sign), range (two days).
    """

    name: str
    rows: str
    title_col: int
    date_col: int
    ident: tuple[str, str]
    url: tuple[str, ...]
    mode: str = "text"
    dates: str = "registered"
    cells: str = "td"
    anchor: str = "a"
    end_col: int = -1
    date_part: str = ""
    date_prefix: str = ""
    drop_text: str = ""
    widen_tilde: bool = False
    skip_class: str = ""
    call_on_cell: bool = False
    need_href: bool = True
    need_id: bool = False
    clean: bool = True


@dataclass(frozen=True)
class DetailSpec:
    """A detail page: one page, one row.

    ``content``: selector; ``up``: steps to its parent; ``nth``: which row of it, whose cell is taken;
    ``drop``: what is removed first; ``drop_last``: of these the last is. ``files``: selector, or yes, no, or
    ``more:n`` for more than n matches of the content's rows.
    """

    name: str
    content: str
    files: str
    images: bool = True
    up: bool = False
    nth: int = -1
    drop: str = ""
    drop_last: str = ""
    journal: bool = False
    inverted: bool = False


KHS, EXC, NRICH = "https://www.khs.go.kr", "https://www.e-minwon.go.kr", "https://www.nrich.go.kr"
MUSEUM, KH, YN = "https://www.museum.go.kr", "https://www.kh.or.kr", "http://www.yngogo.or.kr"
GYEONGJU, JEONJU = "https://gyeongju.museum.go.kr", "https://jeonju.museum.go.kr"
EXC_ROWS = "table.td_left tbody tr.list_tr"
YN_DETAIL = YN + "/subList/{menu}?pmode=detail&nttSeq={id}&bbsSeq={bbs}&sitecntntsSeq={contents}"

#: Selectors, columns, id and URL forms of the boards.
LISTS = [
    ListSpec("khs", "table.list_t01 tbody tr", 1, 3, ("param", "id"), ("resolve", KHS), "attr", "future", end_col=4),
    ListSpec("khs_gallery", "ul.photo_board li a", 1, 2, ("param", "nttId"), ("resolve", KHS), "image", cells="div", anchor="", date_part="span"),
    ListSpec("khs_law", "table.b_list tbody tr", 1, 4, ("param", "id"), ("resolve", KHS), "attr", "tilde"),
    ListSpec("excavation_status", EXC_ROWS, 1, 4, ("call", "dataSelected"), ("template", EXC, "/ge/ee/getEcexmPrmsnAply.do?ecexmRcno={id}"), "attr", clean=False),
    ListSpec("excavation_report", EXC_ROWS, 2, 6, ("call", "dataSelected"), ("template", EXC, "/ge/ee/getEcexmRptp.do?ecexmRcno={id}"), "attr", clean=False),
    ListSpec("excavation_site", EXC_ROWS, 1, 4, ("call", "dataSelected"), ("template", EXC, "/ge/ee/getLinkGrndsRls.do?grndsRlsSeqc={id}"), "attr", "duration", clean=False),
    ListSpec("nrich_notice", "table.table-list tbody tr", 1, 3, ("param", "bbs_idx"), ("prefix", NRICH, "/kor/"), "attr"),
    ListSpec("nrich_event", "ul.event-list li a", 0, 0, ("call", "fnViewPage"), ("template", NRICH, "/kor/majorView.do?menuIdx=286&bbs_idx={id}"), "strong", "range", cells="", anchor="", date_part="span.date", drop_text="행사기간 : ", need_href=False, need_id=True),
    ListSpec("nrich_journal", "table.table-list tbody tr", 1, 2, ("param", "bbs_idx"), ("resolve", NRICH), "attr"),
    ListSpec("nrich_portal", "table.tbl02 tbody tr", 1, 2, ("param", "bbs_idx"), ("prefix", "https://portal.nrich.go.kr", "/kor/"), "attr"),
    ListSpec("gogung", "table.board-list tbody tr", 1, 3, ("param", "boardId"), ("prefix", "https://www.gogung.go.kr", "/gogung/bbs/BMSR00022/")),
    ListSpec("heritage_agency", "table.board_list tbody tr", 1, 4, ("param", "bbIdx"), ("resolve", KH), "attr", skip_class="top"),
    ListSpec("kaah", "table.board-table-list tbody tr", 1, 3, ("segment", ""), ("absolute", "")),
    ListSpec("kaah_place", "div.page-con-box div.data-list", 0, 0, ("segment", ""), ("absolute", ""), cells="", anchor="div.con div a", date_part="div.year|div.date"),
    ListSpec("kras", "table tbody tr", 1, 4, ("param", "uid"), ("resolve", "https://www.kras.or.kr")),
    ListSpec("jbgogo", "table.table_list tbody tr", 1, 3, ("segment", ""), ("resolve", "https://www.jbgogo.or.kr"), anchor="div a"),
    ListSpec("hsas", "table#bbs_list tbody tr", 1, 3, ("param", "eb_idx"), ("replace", "http://www.hsas.or.kr", "./?ref", "/flow/?ref"), date_prefix="20"),
    ListSpec("yngogo", ".basic-table01 tr", 1, 3, ("first", "fnView"), ("template", "", YN_DETAIL), need_href=False),
    ListSpec("museum", "div.board-list-tbody ul", 3, 5, ("param", "arcId"), ("prefix", MUSEUM, "{prefix}"), cells="li"),
    ListSpec("museum_press", "div.board-list-tbody ul", 1, 3, ("param", "arcId"), ("prefix", MUSEUM, "/MUSEUM/contents/M0701040000.do"), cells="li"),
    ListSpec("museum_recruit", "div.board-list-tbody ul", 2, 3, ("param", "arcId"), ("prefix", MUSEUM, "/MUSEUM/contents/M0701030000.do"), dates="duration", cells="li", widen_tilde=True),
    ListSpec("jeonju_museum", "table.tstyle_list tbody tr", 1, 3, ("param", "list_no"), ("resolve", JEONJU)),
    ListSpec("jeonju_museum_recruit", "table.tstyle_list tbody tr", 1, 2, ("param", "list_no"), ("resolve", JEONJU), dates="duration"),
    ListSpec("buyeo_museum", "table.tableType1 tbody tr", 1, 4, ("call", "goView"), ("template", "https://buyeo.museum.go.kr", "/bbs/view.do?pstSn={id}&key={list}"), "bare", call_on_cell=True, need_href=False),
    ListSpec("jinju_museum", "table tbody tr", 1, 4, ("param", "no"), ("prefix", "https://jinju.museum.go.kr", "/kor/html/sub06/0601.html")),
    ListSpec("gyeongju_museum", "table tbody tr", 1, 4, ("param", "no"), ("prefix", GYEONGJU, "{prefix}")),
    ListSpec("gyeongju_museum_notice", "table tbody tr", 3, 5, ("param", "no"), ("prefix", GYEONGJU, "/kor/html/sub07/0703.html")),
    ListSpec("cheongju_museum", "table.bbs_default_list tbody tr", 1, 4, ("param", "nttNo"), ("replace", "https://cheongju.museum.go.kr", "./", "/www/")),
    ListSpec("gimhae_museum", "table.board_list tbody tr", 1, 5, ("param", "no"), ("prefix", "https://gimhae.museum.go.kr", "{prefix}")),
    ListSpec("jeju_museum", "div.board_list table tbody tr", 1, 3, ("param", "no"), ("replace", "https://jeju.museum.go.kr", "./", "/_prog/_board/")),
    ListSpec("iksan_museum", "div.bd_list_wrap table tbody tr", 1, 5, ("param", "no"), ("prefix", "https://iksan.museum.go.kr", "/kor/html/sub05/0501.html")),
]

#: Where a page's content and attachments are.
DETAILS = [
    DetailSpec("khs", "div.b_content", "dl.b_file dd ul li"),
    DetailSpec("excavation_status", "table.td_left", "no", images=False, up=True),
    DetailSpec("excavation_report", "table.td_left", "yes", images=False, up=True, drop_last="table tbody tr"),
    DetailSpec("excavation_site", "div.board_view", "yes", images=False, up=True, drop_last="div dl"),
    DetailSpec("nrich_notice", "table.table-view tbody tr", "more:4", nth=3),
    DetailSpec("nrich_event", "table.table-view tbody tr", "no", nth=4),
    DetailSpec("nrich_journal", "table.table-list tbody tr", "yes", images=False, journal=True),
    DetailSpec("nrich_portal", "div.detail_Area2", "no"),
    DetailSpec("gogung", "div.content-wrap", "div.file-list"),
    DetailSpec("heritage_agency", "div.view_con", "div.tbl_file p"),
    DetailSpec("kaah", "div.content", "div.board-view-file div.file-list"),
    DetailSpec("kaah_place", "div.board-view-top", "div.board-view-file div.file-list"),
    DetailSpec("kras", "#vContent", "div.attach ul li", drop="div.snsbox"),
    DetailSpec("jbgogo", "div.upload_contents", "div.item_box a.btn_file", drop="div.snsbox"),
    DetailSpec("hsas", "div#view_content", "no"),
    DetailSpec("yngogo", ".conM_txt", "#atchFile_div"),
    DetailSpec("museum", "div.viewStyle1", "div.flie-down-area ul li"),
    DetailSpec("jeonju_museum", "div.contents", "div.file ul.list"),
    DetailSpec("buyeo_museum", "div.cont", "div.attachmentWrap ul.noList", inverted=True),
    DetailSpec("jinju_museum", "div.bbs--view--content", "div.bbs--view--file"),
    DetailSpec("gyeongju_museum", "div.bd_detail_cont", "div.bd_detail_file ul.file"),
    DetailSpec("cheongju_museum", "td.content", "tr.FILE td p"),
    DetailSpec("gimhae_museum", "div.bbs--view--content", "div.bbs--view--file"),
    DetailSpec("jeju_museum", "div.board_viewDetail", "li.file div a"),
    DetailSpec("iksan_museum", "div.bd_detail_cont", "ul.file li"),
    DetailSpec("generic", "article", "a.attachment"),
]
#: Any page's navigation links, in order.
NAVIGATION = ListSpec("navigation", "nav ul li", 0, 0, ("segment", ""), ("absolute", ""), cells="")
LIST_SPECS, DETAIL_SPECS = {s.name: s for s in [*LISTS, NAVIGATION]}, {s.name: s for s in DETAILS}
