"""The web source against a local server."""

from __future__ import annotations

import http.server
import json
import threading
import time

import pytest

from quillmark.sources import web

PAGES = {"/a": b"<p>a</p>", "/b/c.html": b"", "/late": b"late", "/big": b"x" * 5000, "/private/x": b"secret"}


class Pages(http.server.BaseHTTPRequestHandler):
    robots: bytes | None = b"User-agent: *\nDisallow: /private/\n"
    seen: list[tuple[float, str]] = []  # noqa: RUF012

    def do_GET(self):
        type(self).seen.append((time.monotonic(), self.path))
        body = self.robots if self.path == "/robots.txt" else PAGES.get(self.path)
        if self.path == "/moved":
            self.send_response(302)
            self.send_header("Location", "/a")
        elif self.path == "/broken":
            self.send_response(500)
        else:
            self.send_response(404 if body is None else 200)
        if self.path == "/late":
            time.sleep(1.5)
        self.end_headers()
        self.wfile.write(body or b"")

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    Pages.seen, Pages.robots = [], b"User-agent: *\nDisallow: /private/\n"
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"127.0.0.1:{s.server_port}"
    s.shutdown()


def load(spark, urls, **options):
    web.register(spark)
    return spark.read.format("web").option("urls", json.dumps(urls)).options(**{"rate_limit_rps": "50"} | options).load()


def test_pages_statuses_and_robots(spark, server):
    paths = ["/a", "/b/c.html", "/none", "/broken", "/moved", "/private/x", "/a"]
    got = {r.position: r for r in load(spark, [f"http://{server}{p}" for p in paths]).collect()}
    assert [got[i].status for i in range(7)] == [200, 200, 404, 500, 200, None, 200]
    assert [got[i].error for i in range(7)] == [None, None, "HTTP 404", "HTTP 500", None, "forbidden by robots.txt", None]
    assert bytes(got[0].content) == b"<p>a</p>" == bytes(got[4].content) and bytes(got[1].content) == b"" and got[2].content is None
    assert (got[0].filename, got[1].filename, got[0].host) == (f"{server}_a.html", f"{server}_b_c.html", server)
    assert "/private/x" not in [p for _, p in Pages.seen] and [p for _, p in Pages.seen].count("/robots.txt") == 1


def test_robots_may_be_ignored_or_missing(spark, server):
    url = [f"http://{server}/private/x"]
    assert load(spark, url, obey_robots="false").first().status == 200
    Pages.robots = None
    assert load(spark, url).first().status == 200


def test_timeouts_sizes_and_dead_hosts(spark, server):
    x = load(spark, [f"http://{server}/late", f"http://{server}/big", "http://127.0.0.1:9/x"], timeout="0.5", max_bytes="1000", obey_robots="false")
    got = {r.position: (r.status, r.content, r.error) for r in x.collect()}
    assert got[0] == (None, None, "timeout") and got[1] == (200, None, "too large") and got[2][:2] == (None, None) and got[2][2]


def test_a_host_has_its_rate(spark, server):
    load(spark, [f"http://{server}/a"] * 5, rate_limit_rps="5").collect()
    at = [t for t, _ in Pages.seen]
    assert len(at) == 6 and min(b - a for a, b in zip(at, at[1:], strict=False)) > 0.15
    here, there = f"http://{server}/a", f"http://{server.replace('127.0.0.1', 'localhost')}/a"
    assert load(spark, [here, there, here]).rdd.getNumPartitions() == 2


def test_limit_and_wrong_settings(spark, server):
    assert load(spark, [f"http://{server}/a"] * 5, max_pages="2").count() == 2
    for urls, options in (([], {}), (["nonsense"], {}), (["ftp://x/y"], {}), (["http://x/y"], {"rate_limit_rps": "0"}), (["http://x/y"], {"max_pages": "0"})):
        with pytest.raises(Exception, match="urls|positive"):
            load(spark, urls, **options).collect()
    assert web.answers({"urls": f"http://{server}/a"}) == (True, "ok") and web.answers({"urls": f"http://{server}/none"}) == (False, "HTTP 404")


def test_sync_counts_what_was_written(spark, server, tmp_path):
    urls = json.dumps([f"http://{server}{p}" for p in ("/a", "/none", "/big")])
    for _ in range(2):
        assert web.sync(spark, str(tmp_path / "w"), urls=urls, rate_limit_rps="50") == {"files": 2, "bytes": 5008, "errors": 1}


def test_a_stream_goes_on_from_its_offset(spark, server, tmp_path):
    web.register(spark)
    every = [f"http://{server}/a", f"http://{server}/none", f"http://{server}/b/c.html", f"http://{server}/big"]

    def run(urls):
        s = spark.readStream.format("web").option("urls", json.dumps(urls)).option("rate_limit_rps", "50").load()
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return sorted(r.position for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run(every[:2]) == [0, 1]
    before = len(Pages.seen)
    assert run(every) == [0, 1, 2, 3]
    assert sorted(p for _, p in Pages.seen[before:]) == ["/b/c.html", "/big", "/robots.txt"]
