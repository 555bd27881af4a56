"""Addresses of every kind against results of the public URL standard, and the JVM's path against the general one."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import addresses, scalars

#: Address and result; None: a failure, which comes back as it is.
CASES = [
    ("http://h.kr", "http://h.kr/"),
    ("HTTP://User:pa ss@Example.COM:80/a/../b?x=1&pageIndex=2#f g", "http://User:pa%20ss@example.com/b?x=1#f%20g"),
    ("https://u:@h.kr:443/", "https://u@h.kr/"),
    ("https://a@b@h.kr/", "https://a%40b@h.kr/"),
    ("http://h.kr:/x", "http://h.kr/x"),
    ("http://h.kr:0080/x", "http://h.kr/x"),
    ("http://h.kr:65536/", None),
    ("http://h.kr:8a/", None),
    ("http:h.kr\\a\\b", "http://h.kr/a/b"),
    ("http:///h.kr/a", "http://h.kr/a"),
    ("http://", None),
    ("http://u@/x", None),
    ("http://0x7f.1/", "http://127.0.0.1/"),
    ("http://017700000001/", "http://127.0.0.1/"),
    ("http://1.2.3.4./", "http://1.2.3.4/"),
    ("http://4294967295/", "http://255.255.255.255/"),
    ("http://4294967296/", None),
    ("http://1.2.3.256/", None),
    ("http://1.2.3.4.5/", None),
    ("http://a.09/", None),
    ("http://[2001:DB8:0:0:1:0:0:1]:8080/", "http://[2001:db8::1:0:0:1]:8080/"),
    ("http://[::ffff:1.2.3.4]/", "http://[::ffff:102:304]/"),
    ("http://[::]/", "http://[::]/"),
    ("http://[1:2:3:4:5:6:7::]/", "http://[1:2:3:4:5:6:7:0]/"),
    ("http://[::1/", None),
    ("http://[fe80::1%25eth0]/", None),
    ("http://[::1]x/", None),
    ("http://bücher.example/", "http://xn--bcher-kva.example/"),
    ("http://BÜCHER.example/", "http://xn--bcher-kva.example/"),
    ("http://b%C3%BCcher.example/", "http://xn--bcher-kva.example/"),
    ("http://faß.de/", "http://xn--fa-hia.de/"),
    ("http://한국。kr/", "http://xn--3e0b707e.kr/"),
    ("http://ｈ.ｋｒ/", "http://h.kr/"),
    ("http://xn--bcher-kva.example/", "http://xn--bcher-kva.example/"),
    ("http://xn--a/", None),
    ("http://a b/", None),
    ("http://a%b/", None),
    ("http://a<b/", None),
    ("http://h.kr/%2e/a/%2E%2e/b/.", "http://h.kr/b/"),
    ("http://h.kr/../..", "http://h.kr/"),
    ("http://h.kr/가?q=가", "http://h.kr/%EA%B0%80?q=%EA%B0%80"),
    ("http://h.kr/?a=%FF&b=%zz&c=1+2&~=*", "http://h.kr/?a=%EF%BF%BD&b=%25zz&c=1+2&%7E=*"),
    ("http://h.kr/p;jsessionid=1?a=1;b=2&c#x;y", "http://h.kr/p?a=1#x"),
    ("http://h.kr/?sdate=1#", "http://h.kr/#"),
    (" \thttp://h.kr/a\nb ", "http://h.kr/ab"),
    ("ftp://h:21/x", "ftp://h/x"),
    ("ws://h:80", "ws://h/"),
    ("file:///C|/a/../../b", "file:///C:/b"),
    ("file://localhost/x", "file:///x"),
    ("file://C:/x", "file:///C:/x"),
    ("file:x", "file:///x"),
    ("mailto:a@b.kr?pageIndex=1&subject=x y", "mailto:a@b.kr?subject=x+y"),
    ("javascript:go('1')", "javascript:go('1')"),
    ("foo://", "foo://"),
    ("foo://Host:80", "foo://Host:80"),
    ("foo://u@/x", None),
    ("foo:/a/..//b", "foo:/.//b"),
    ("foo://h\\x/", None),
    ("/only/a/path?pageIndex=1", None),
    ("no address", None),
    ("", None),
]


@pytest.mark.parametrize(("address", "wanted"), CASES)
def test_addresses_by_the_standard(address, wanted):
    assert addresses.cleaned(address) == (address if wanted is None else wanted)


def test_both_paths_in_columns(spark):
    rows = [(i, a) for i, (a, _) in enumerate(CASES)] + [(-1, None)]
    got = dict(spark.createDataFrame(rows, "i int, a string").select("i", addresses.clean_address(F.col("a")).alias("c")).collect())
    assert got == {i: a if w is None else w for i, (a, w) in enumerate(CASES)} | {-1: None}


def test_jvm_and_general_path_agree_on_plain_addresses(spark):
    part = st.text("abAB01-._~!$&'()*+,;=:@/?#[]|", max_size=12)
    drawn = st.builds(lambda s, h, p, a, b: f"{s}://{h}{p}{a}{b}", st.sampled_from(["http", "https"]), st.sampled_from(["h", "a.b-c.kr", "1.x"]), st.sampled_from(["", ":80", ":443", ":8080"]), st.sampled_from(["", "/", "?", "#", "/../a/./", "/?pageIndex=1&"]), part)
    texts: set[str] = set()
    settings(max_examples=400, database=None, deadline=None)(given(drawn)(lambda a: texts.add(a)))()
    seen = spark.createDataFrame([(t,) for t in sorted(texts)], "a string").where(F.col("a").rlike(addresses.PLAIN))
    rows = seen.select("a", scalars.clean_url(F.col("a")).alias("c")).collect()
    assert len(rows) > 100
    assert [(r["a"], r["c"]) for r in rows] == [(r["a"], addresses.cleaned(r["a"])) for r in rows]


def test_clashing_names_and_empty_tables(spark):
    rows = spark.createDataFrame([("http://0x7f.1/", "x")], "a string, c string")
    assert rows.select("*", addresses.clean_address(F.col("a")).alias("b")).first()["b"] == "http://127.0.0.1/"
    assert rows.limit(0).select(addresses.clean_address(F.col("a"))).count() == 0
