"""Cleaning of any address: every scheme, user info, numeric and internationalised hosts.

Most addresses of a crawl are plain: web pages of ASCII hosts without escapes. They are cleaned by
:func:`millrace.functions.scalars.clean_url` in the JVM. The others, and they alone, are sent to Python in Arrow batches and parsed
by the public URL standard; what it calls a failure comes back as it was.

Defined results: null stays null and an empty text empty; an address without scheme is a failure, as there is no base. Hosts are
mapped by NFKC and case folding, sharp s, final sigma and joiners apart, and written in Punycode.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from ipaddress import IPv6Address
from urllib.parse import quote_plus, unquote, unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.scalars import PAGING, clean_url

#: Fixed values of the URL standard: default ports of the special schemes, and what is escaped beside controls and non-ASCII characters.
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
FRAGMENT = " \"<>`"
PATH = " \"#<>?^`{}"
USER = PATH + "/:;=@[\\]|"
FORBIDDEN_HOST = "\0\t\n\r #/:<>?@[\\]^|"
#: Fixed values of the host mapping: kept as they are; left out; full stops of other scripts.
KEPT, IGNORED, STOPS = "ßς\u200c\u200d", "\u00ad\u034f\u200b\u2060\ufeff" + "".join(map(chr, range(0xFE00, 0xFE10))), "\u3002\uff0e\uff61"

#: Addresses that the JVM cleans to the same result.
PLAIN = r"^(?!.*xn--)https?://(?:[a-z0-9-]+\.)*[a-z][a-z0-9-]*(?::[1-9][0-9]{0,3})?(?:[/?#][!#$&-;=?-\[\]_a-z|~]*)?$"


class NoAddressError(ValueError):
    """The standard's failure."""


def _need(holds: object) -> None:
    if not holds:
        raise NoAddressError


def escaped(text: str, also: str) -> str:
    keep = lambda c: "\x1f" < c < "\x7f" and c not in also
    return "".join(c if keep(c) else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _ipv4_number(part: str) -> int:
    base, digits = (16, part[2:]) if part[:2] in ("0x", "0X") else (8, part[1:]) if len(part) > 1 and part[0] == "0" else (10, part)
    _need(part and re.fullmatch({16: "[0-9A-Fa-f]*", 8: "[0-7]*", 10: "[0-9]+"}[base], digits))
    return int(digits or "0", base)


def _ipv4(host: str) -> str | None:
    """The dotted form of a host whose last label is a number; None if it isn't."""
    parts = host.split(".")
    if len(parts) > 1 and not parts[-1]:
        parts.pop()
    if not re.fullmatch("[0-9]+|0[xX][0-9A-Fa-f]*", parts[-1]):
        return None
    _need(len(parts) <= 4)
    *first, last = map(_ipv4_number, parts)
    _need(all(n < 256 for n in first) and last < 256 ** (4 - len(first)))
    whole = last + sum(n << 8 * (3 - i) for i, n in enumerate(first))
    return ".".join(str(whole >> s & 255) for s in (24, 16, 8, 0))


def _ipv6(text: str) -> str:
    _need("%" not in text)
    try:
        whole = int(IPv6Address(text))
    except ValueError:
        raise NoAddressError from None
    groups = [f"{whole >> s & 0xFFFF:x}" for s in range(112, -16, -16)]
    for n in range(8, 1, -1):
        for i in range(9 - n):
            if groups[i : i + n] == ["0"] * n:
                return ":".join(groups[:i]) + "::" + ":".join(groups[i + n :])
    return ":".join(groups)


def _label(label: str) -> str:
    """A mapped label in ASCII."""
    if label.startswith("xn--"):
        try:
            shown = label[4:].encode("ascii").decode("punycode")
            _need(not shown.isascii() and shown == _mapped(shown) and shown.encode("punycode").decode("ascii") == label[4:])
        except UnicodeError:
            raise NoAddressError from None
        return label
    if label.isascii():
        return label
    kinds = [unicodedata.category(c) for c in label]
    _need(kinds[0][0] != "M" and all(c in KEPT or k[0] not in "CZ" for c, k in zip(label, kinds, strict=True)))
    return "xn--" + label.encode("punycode").decode("ascii")


def _mapped(host: str) -> str:
    fold = lambda s: "".join(c if c in KEPT else "ß" if c == "ẞ" else c.casefold() for c in s)
    shown = "".join("." if c in STOPS else c for c in host if c not in IGNORED)
    return unicodedata.normalize("NFC", fold(unicodedata.normalize("NFKC", fold(shown))))


def _domain(host: str) -> str:
    shown = unquote_to_bytes(host).decode("utf-8", "replace")
    host = ".".join(map(_label, (shown.lower() if shown.isascii() else _mapped(shown)).split(".")))
    _need(host and not any(c in FORBIDDEN_HOST or c <= "\x1f" or c in "%\x7f" for c in host))
    return _ipv4(host) or host


def _host(text: str, special: bool) -> str:
    if text.startswith("["):
        _need(text.endswith("]"))
        return f"[{_ipv6(text[1:-1])}]"
    if special:
        return _domain(text)
    _need(not any(c in FORBIDDEN_HOST for c in text))
    return escaped(text, "")


def _authority(text: str, scheme: str) -> str:
    """User info, host and port as they are written."""
    user, at, where = text.rpartition("@")
    host, port = re.fullmatch(r"(\[[^\]]*\]?[^:]*|[^:]*)(:.*)?", where, re.S).groups()
    special = scheme in PORTS
    _need(host or not (special or at or port))
    name, _, secret = user.partition(":")
    out = escaped(name, USER) + (":" + escaped(secret, USER) if secret else "")
    out = (out + "@" if out else "") + (_host(host, special) if host else "")
    digits = (port or ":")[1:]
    _need(re.fullmatch("[0-9]*", digits) and int(digits or "0") <= 65535)
    return out + (f":{int(digits)}" if digits and int(digits) != PORTS.get(scheme) else "")


def _drive(segment: str, marks: str = ":|") -> bool:
    return len(segment) == 2 and segment[0].isascii() and segment[0].isalpha() and segment[1] in marks


def _path(text: str, scheme: str) -> str:
    """A path that begins with a slash, without dot segments."""
    done: list[str] = []
    segments = re.split(r"[/\\]" if scheme in PORTS else "/", text)[1:]
    for i, segment in enumerate(segments):
        dots = re.sub("%2e", ".", segment, flags=re.I)
        if dots == ".." and done and not (scheme == "file" and len(done) == 1 and _drive(done[0], ":")):
            done.pop()
        if dots in (".", ".."):
            done += [""] * (i == len(segments) - 1)
        elif scheme == "file" and not done and _drive(segment):
            done.append(segment[0] + ":")
        else:
            done.append(escaped(segment, PATH))
    return "/" + "/".join(done)


def _located(rest: str, scheme: str) -> str:
    """What stands between the scheme and the query."""
    if scheme == "file":
        rest = rest.replace("\\", "/")
        host, path = re.fullmatch("//([^/]*)(.*)", rest, re.S).groups() if rest.startswith("//") else ("", rest)
        if _drive(host):
            host, path = "", f"/{host}{path}"
        host = _host(host, True) if host else ""
        return f"//{'' if host == 'localhost' else host}" + _path(path if path.startswith("/") else f"/{path}", scheme)
    if scheme in PORTS:
        authority, path = re.fullmatch(r"[/\\]*([^/\\]*)(.*)", rest, re.S).groups()
        return f"//{_authority(authority, scheme)}" + _path(path or "/", scheme)
    if rest.startswith("//"):
        authority, path = re.fullmatch("//([^/]*)(.*)", rest, re.S).groups()
        return f"//{_authority(authority, scheme)}" + (_path(path, scheme) if path else "")
    if rest.startswith("/"):
        path = _path(rest, scheme)
        return "/." * path.startswith("//") + path
    return escaped(rest[:-1] + "%20" if rest.endswith(" ") else rest, "")


def _query(text: str) -> str:
    pairs = [[unquote(x.replace("+", " "), errors="replace") for x in p.partition("=")[::2]] for p in text.split("&") if p]
    coded = lambda x: quote_plus(x, safe="*").replace("~", "%7E")
    return "&".join(f"{coded(k)}={coded(v)}" for k, v in pairs if k not in PAGING)


def cleaned(address: str) -> str:
    """One address without session ids and paging parameters, written as the standard does; itself if it is none."""
    text = re.sub("[\t\n\r]", "", re.sub(";[^?#]*", "", address).strip("".join(map(chr, range(33)))))
    parts = re.fullmatch(r"([A-Za-z][A-Za-z0-9+.-]*):([^?#]*)(?:\?([^#]*))?(?:#(.*))?", text, re.S)
    if not parts:
        return address
    scheme, rest, query, fragment = parts.groups()
    scheme = scheme.lower()
    try:
        where = _located(rest, scheme)
    except NoAddressError:
        return address
    asked = _query(query or "")
    return f"{scheme}:{where}" + (f"?{asked}" if asked else "") + (f"#{escaped(fragment, FRAGMENT)}" if fragment is not None else "")


@F.arrow_udf(T.StringType())
def _cleaned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for addresses in batches:
        if addresses.null_count == len(addresses):  # as a rule: all were plain
            yield pa.nulls(len(addresses), pa.string())
        else:
            yield pa.array([None if a is None else cleaned(a) for a in addresses.to_pylist()], pa.string())


def clean_address(address: Column) -> Column:
    """Any address without session ids and paging parameters; one that can't be parsed comes back as it is."""
    plain = address.rlike(PLAIN)
    return F.when(plain, clean_url(address)).otherwise(_cleaned(F.when(~plain, address)))
