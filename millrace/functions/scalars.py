"""Scalar functions over columns; all run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts in web pages trim it: Unicode spaces, line ends and the byte order mark.
SPACE = r"[\s\p{Z}\x{FEFF}]+"

#: Query parameters that don't identify a page.
PAGING = ["pageIndex", "pageUnit", "strWhere", "searchWrd", "sdate", "edate"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that stands once in the plan, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def js_trim(c: Column) -> Column:
    """Trims Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}", ""), f"{SPACE}$", "")


def or_else(c: Column, other: Column) -> Column:
    """``other`` where ``c`` is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


def json_fields(c: Column, ddl: str) -> Column:
    """A JSON text's fields as a struct; null fields where it lacks them or is no JSON."""
    return F.from_json(c, ddl, {"mode": "PERMISSIVE"})


def get_date(c: Column) -> Column:
    """Dots become dashes; of several lines the first two become a range, the second one trimmed."""
    def dated(x: Column) -> Column:
        lines = F.split(x, "\n")
        both = F.concat(F.get(lines, F.lit(0)), F.lit(" ~ "), js_trim(F.get(lines, F.lit(1))))
        return F.when(F.contains(x, F.lit("\n")), both).otherwise(x)

    return F.replace(let(c, dated), F.lit("."), F.lit("-"))


def parse_date(c: Column) -> Column:
    """A strict date, null for anything else."""
    strict = lambda x: F.when(x.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(x, F.lit("yyyy-M-d")).cast("date"))
    return let(js_trim(c), strict)


def start_date(c: Column) -> Column:
    return parse_date(F.get(F.split(get_date(c), "~"), F.lit(0)))


def end_date(c: Column) -> Column:
    """The second date of a range, or the only date."""
    return parse_date(let(F.split(get_date(c), "~"), lambda p: F.coalesce(F.get(p, F.lit(1)), F.get(p, F.lit(0)))))


def is_after(c: Column, as_of: Column) -> Column:
    """Whether a date text lies after ``as_of``; false where it is no date."""
    return F.coalesce(parse_date(get_date(c)) > as_of, F.lit(False))


def query_param(url: Column, name: str | Column) -> Column:
    """The first value of a query parameter, decoded; null if absent."""
    name = F.lit(name) if isinstance(name, str) else name
    pairs = F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&")
    own = F.filter(pairs, lambda p: _decoded(F.substring_index(p, "=", 1)) == name)
    return let(F.get(own, F.lit(0)), lambda p: F.when(p.isNotNull(), _decoded(_value(p))))


def last_segment(url: Column) -> Column:
    """What follows the last slash of the path; empty after a trailing slash."""
    return F.element_at(F.split(F.regexp_extract(url, r"^(?:[^:/?#]+://[^/?#]*)?([^?#]*)", 1), "/"), -1)


def call_argument(c: Column, function: str) -> Column:
    """The greedy argument of a call in an ``onclick``; empty without one."""
    return F.regexp_extract(c, rf"{function}\('(.*)'\)", 1)


def call_first(c: Column, function: str) -> Column:
    """The first quoted argument of a call; empty without one."""
    return F.regexp_extract(c, rf"{function}\('([^']*)'", 1)


def post_id(c: Column) -> Column:
    """A post's number as scripts carry it; empty without one."""
    return F.regexp_extract(c, r"""nttSeq[=:]['"]?(\d+)""", 1)


def _decoded(c: Column) -> Column:
    return let(c, lambda x: F.coalesce(F.try_url_decode(x), x))


def _value(pair: Column) -> Column:
    """What follows the first equals sign; empty without one."""
    return F.when(F.contains(pair, F.lit("=")), F.substring(pair, F.instr(pair, F.lit("=")) + 1, F.length(pair))).otherwise("")


def _segments(path: Column) -> Column:
    """A path without dot segments; ``..`` takes back what stands before it."""

    def step(done: Column, p: Column) -> Column:
        return F.when(p == ".", done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))

    def joined(parts: Column) -> Column:
        end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(parts, F.array().cast("array<string>"), step), end), "/"))

    return let(path, lambda p: F.when(F.contains(p, F.lit("/.")), let(F.split(F.substring(p, 2, 1 << 20), "/"), joined)).otherwise(p))


def _escaped(c: Column) -> Column:
    """Percent-encodes what a path cannot hold as it is."""
    odd = lambda x: x.rlike(r"[^\x21-\x7E]|[\"<>`{}^]")
    each = lambda p: F.transform(F.split(p, ""), lambda x: F.when(odd(x), F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))).otherwise(x))
    return let(c, lambda p: F.when(odd(p), F.array_join(each(p), "")).otherwise(p))


def clean_url(url: Column) -> Column:
    """A URL without session ids and paging parameters, its query encoded anew; others come back as they are.

    What follows a semicolon goes up to the next ``?`` or ``#``, in the query too.
    """

    def cleaned(s: Column) -> Column:
        scheme = F.lower(F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
        host = F.lower(F.regexp_extract(s, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
        path = F.regexp_extract(s, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
        path = let(path, lambda p: F.when(p == "", "/").otherwise(F.replace(p, F.lit("\\"), F.lit("/"))))
        pairs = F.filter(F.split(F.regexp_extract(s, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
        split = F.transform(pairs, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(_value(p)).alias("v")))
        kept = F.filter(split, lambda p: ~p["k"].isin(PAGING))
        query = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
        start = F.regexp_replace(F.concat(scheme, F.lit("://"), host), "^(http://.*):80$|^(https://.*):443$", "$1$2")
        fragment = F.regexp_extract(s, r"(#.*)$", 1)
        return F.concat(start, _escaped(_segments(path)), let(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")), fragment)

    web = r"^[Hh][Tt][Tt][Pp][Ss]?://[^/?#\s]+"
    return let(url, lambda u: let(js_trim(F.regexp_replace(u, ";[^?#]*", "")), lambda s: F.when(s.rlike(web), cleaned(s)).otherwise(u)))


def resolve(href: Column, origin: Column) -> Column:
    """``href`` against an origin without path, as browsers resolve it; null where there is neither base nor scheme."""
    def located(h: Column) -> Column:
        plain = F.concat(F.lit("/"), F.regexp_replace(h, r"^(\./)+", ""))
        path = F.when(h.startswith("/"), h).when(h.startswith("?") | h.startswith("#"), F.concat(F.lit("/"), h)).otherwise(plain)
        return F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.substring_index(origin, "//", 1), h)).otherwise(F.concat(origin, path))

    return let(js_trim(href), located)


def kst_date(ts: Column) -> Column:
    """A UTC instant's date in Seoul, ``yyyy-MM-dd``."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), ts.cast("timestamp_ntz")), "yyyy-MM-dd")


def kst_display(ts: Column) -> Column:
    """A UTC instant's date in Seoul as it is shown, months and days without zeros."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), ts.cast("timestamp_ntz")), "yyyy년 M월 d일")


def escape_html(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def truncate_url(c: Column, most: int = 60) -> Column:
    """At most ``most`` characters, the last three of them dots where it was longer; a dash for nothing."""
    return F.when(F.coalesce(c, F.lit("")) == "", "-").when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 3)), F.lit("..."))).otherwise(c)
