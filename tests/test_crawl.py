"""Fetching under limits a host, and the page source, against a server of this machine."""

import collections
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from millrace.sources import crawl, mirror
from millrace.sources.pages import Fetcher

SCHEMA = "target_id string, key string, url string, method string, body string"


class Server(ThreadingHTTPServer):
    """Counts who is served at a time; hosts are addresses of this machine, 127.0.0.x."""

    daemon_threads = True

    def __init__(self):
        super().__init__(("0.0.0.0", 0), Handler)
        self.now, self.most, self.starts, self.lock = collections.Counter(), collections.Counter(), collections.defaultdict(list), threading.Lock()
        threading.Thread(target=self.serve_forever, daemon=True).start()


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        s, name = self.server, self.headers["Host"].split(":")[0]
        with s.lock:
            s.now[name] += 1
            s.most[name] = max(s.most[name], s.now[name])
            s.starts[name].append(time.monotonic())
        time.sleep(0.02)
        said = (self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"-").decode()
        with s.lock:
            s.now[name] -= 1
        self.send_response(404 if "missing" in self.path else 200)
        self.end_headers()
        self.wfile.write(f"{self.command} {self.path} {said}".encode())

    do_POST = do_GET

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    s = Server()
    yield s
    s.shutdown()


def requests(server, hosts, each, hot=0):
    port = server.server_address[1]
    rows = [(f"b{h}", f"{h}/{i}", f"http://127.0.0.{h}:{port}/{i}", "POST" if i == 1 else "GET", "a=b" if i == 1 else None) for h in range(1, hosts + 1) for i in range(each + hot * (h == 1))]
    return rows


def test_no_host_is_asked_more_than_its_limit(spark, server):
    server.most.clear()
    rows = requests(server, 20, 6, hot=60)
    got = crawl.fetch_by_host(spark.createDataFrame(rows, SCHEMA), Fetcher(), crawl.Limits(at_once=2, in_task=16), tasks=3).collect()
    assert sorted(r["key"] for r in got) == sorted(r[1] for r in rows) and all(r["status"] == 200 for r in got)
    assert {r["key"]: r["html"] for r in got}["3/1"] == "POST /1 a=b"
    assert len(server.most) == 20 and max(server.most.values()) == 2


def test_token_bucket(spark, server):
    server.starts.clear()
    rows = requests(server, 2, 8)
    crawl.fetch_by_host(spark.createDataFrame(rows, SCHEMA), Fetcher(), crawl.Limits(at_once=8, rate=20, burst=2, in_task=16), tasks=1).collect()
    for starts in server.starts.values():
        # Two at once, then one in a twentieth of a second; some slack for the machine.
        assert len(starts) == 8 and max(starts) - min(starts) >= 0.28


def test_source_plans_by_host_and_prunes_by_board(spark, server):
    server.most.clear()
    port = server.server_address[1]
    rows = [*requests(server, 6, 3), ("gone", "g", f"http://127.0.0.7:{port}/missing", "GET", None)]
    pages = crawl.read_pages(spark, spark.createDataFrame(rows, SCHEMA), tasks=3)
    assert pages.columns == ["target_id", "key", "url", "html", "status", "error"]
    got = {(r["target_id"], r["key"]): r for r in pages.collect()}
    assert len(got) == 19 and pages.rdd.getNumPartitions() == 3
    assert (got["gone", "g"]["status"], got["gone", "g"]["error"], got["gone", "g"]["html"]) == (404, "HTTP 404", None)
    assert got["b2", "2/0"]["html"] == "GET /0 -"
    server.most.clear()
    assert pages.where("target_id = 'b2'").count() == 3 and set(server.most) == {"127.0.0.2"}
    server.most.clear()
    assert pages.where("target_id in ('b3', 'b4') and key like '%/1'").count() == 2 and set(server.most) == {"127.0.0.3", "127.0.0.4"}


def test_source_reads_the_catalogue(spark):
    pages = crawl.read_pages(spark, fetcher="millrace.sources.mirror:FETCHER")
    rows = pages.collect()
    assert len(rows) == 53 and {r["status"] for r in rows} <= {200, 404, None}
    assert all(r["error"] for r in rows if r["status"] != 200)
    reader = crawl.PageReader({})
    assert len(reader.requests) == 53 and sum(len(p.requests) for p in reader.partitions()) == 53
    with pytest.raises(ValueError, match="too many"):
        crawl.PageReader({"requests": "[" + ",".join(['{"url": "http://a/"}'] * (crawl.MOST + 1)) + "]"}).partitions()


def test_hosts(spark):
    urls = ["http://A.example:80/x", "https://u:p@b.example?q", "http://[::1]:8/x", "ftp://c", "no host", "", None]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(crawl.host(crawl.F.col("u"))).collect()
    assert [r[0] for r in got] == ["a.example", "b.example", "[::1]", "c", "", "", None]
    assert [crawl.host_of(u) for u in urls] == ["a.example", "b.example", "::1", "c", "", "", ""]


def test_failures_are_rows(spark):
    rows = [("t", None, "http://h/" + "x" * n, None, None) for n in range(14)]
    got = {len(r["url"]): r for r in crawl.fetch_by_host(spark.createDataFrame(rows, SCHEMA), mirror.fetcher()).collect()}
    assert len(got) == 14
    for n, r in got.items():
        want = (None, "OSError: no route") if n % 7 == 1 else (404, "HTTP 404") if n % 7 == 0 else (200, None)
        assert (r["status"], r["error"]) == want and r["key"] == r["url"]
