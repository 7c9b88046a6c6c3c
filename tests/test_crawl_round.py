import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from spindrift.plans.crawl_round import Crawl
from spindrift.plans.store import IndexStore
from spindrift.sources import crawl_files as C
from spindrift.sources import fetch

WORDS = "ferry harbour bread oven lamp stone river garden village bridge market teacher window letter train museum".split()


def page(k, links, n=170):
    text = " ".join(f"{WORDS[(i * (k + 3) + i // 7) % len(WORDS)]}{'abcdefgh'[(i + k) % 8]}" for i in range(n))
    return f"<html lang='en'><body><h1>Page {k}</h1><p>{text}</p>" + "".join(f"<a href='{u}'>go</a>" for u in links) + "</body></html>"


SITE = {
    "https://a.example/": page(1, ["/two", "/copy", "https://b.example/"]),
    "https://a.example/two": page(2, ["/", "/three"]),
    "https://a.example/copy": page(1, ["/hidden"]),
    "https://a.example/three": page(3, []),
    "https://b.example/": page(4, ["https://a.example/two"]),
}


@pytest.fixture
def crawl(spark, tmp_path):
    site = spark.createDataFrame(list(SITE.items()), "url string, html string")
    c = Crawl(IndexStore(spark, str(tmp_path)), lambda urls: urls.join(site, "url"), workers=50)
    c.seed(["https://a.example/"])
    return c


def test_rounds(crawl):
    first = crawl.run()
    assert (first.served, first.indexed, first.frontier) == (1, 1, 3)
    second = crawl.run()
    assert second.served == 3
    indexed = lambda: {r["url"] for r in crawl.store.read("documents_idx").collect()}
    assert indexed() == {"https://a.example/", "https://a.example/two", "https://b.example/"}  # the copy is left out
    third = crawl.run()
    assert "https://a.example/three" in indexed()
    assert not any("hidden" in r["link"] for r in crawl.store.read("frontier").collect())  # nor are its links
    for _ in range(3):
        last = crawl.run()
    assert (last.indexed, last.frontier) == (0, 0)
    assert third.indexed == 1
    assert crawl.store.read("documents_idx").count() == 4


def test_robots_blocklist_sitemap_and_spill(spark, tmp_path):
    site = dict(SITE) | {"https://a.example/": page(1, ["/two", "/private/x", "https://ads.b.example/", "/three"]), "https://a.example/private/x": page(7, []), "https://ads.b.example/": page(8, []), "https://a.example/map": page(9, [])}
    pages, asked = spark.createDataFrame(list(site.items()), "url string, html string"), []

    def fetch_(urls):
        asked.extend((r["url"], r["start_s"], r["delay"]) for r in urls.collect())
        return urls.join(pages, "url")

    def maps(rows):
        return rows.filter("host = 'a.example'").select("page_url", F.lit("<urlset><url><loc>/map</loc></url><url><loc>https://z.example/</loc></url></urlset>").alias("xml"))

    rules = C.robots_rules(spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /private\nCrawl-delay: 5")], "host string, content string"))
    block = spark.createDataFrame([("b.example",)], "domain string")
    c = Crawl(IndexStore(spark, str(tmp_path)), fetch_, workers=50, rules=rules, blocklist=block, sitemaps=maps, capacity=2)
    c.seed(["https://a.example/"])
    first = c.run()
    assert (first.served, first.indexed, first.frontier, first.spilled) == (1, 1, 2, 2)  # two, ads, three and map; private is refused
    for _ in range(3):
        last = c.run()
    assert last.frontier == 0 and last.served == 0
    urls = [u for u, *_ in asked]
    assert len(urls) == len(set(urls))
    assert {u for u in urls if "private" in u or "b.example" in u or "z.example" in u} == set()
    assert {"https://a.example/two", "https://a.example/three", "https://a.example/map"} <= set(urls)  # the spilled ones came back
    assert {d for _, _, d in asked} == {5} and len({s for u, s, _ in asked if u in ("https://a.example/two", "https://a.example/three", "https://a.example/map")}) > 1


def test_a_round_that_died_is_run_again(crawl, monkeypatch):
    crawl.run()
    replace = IndexStore.replace

    def dies(self, *_):
        raise OSError("lost")

    monkeypatch.setattr(IndexStore, "replace", dies)
    with pytest.raises(OSError):
        crawl.run()
    monkeypatch.setattr(IndexStore, "replace", replace)
    assert crawl.run().served == 3
    assert {r["url"] for r in crawl.store.documents().collect()} == {"https://a.example/", "https://a.example/two", "https://b.example/"}


class Handler(BaseHTTPRequestHandler):
    tries = 0
    at: list = []

    def do_GET(self):
        Handler.at.append((self.path, time.monotonic()))
        Handler.tries += self.path == "/busy"
        code = 429 if self.path == "/busy" and Handler.tries < 2 else 404 if self.path == "/gone" else 200
        self.send_response(code)
        self.send_header("Content-Type", "text/plain" if self.path in ("/text", "/robots.txt") else "text/html; charset=utf-8")
        self.end_headers()
        self.wfile.write(b"User-agent: *\nDisallow: /x" if self.path == "/robots.txt" else b"<p>hello</p>")

    def log_message(self, *_):
        pass


def test_fetch(spark):
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    df = spark.createDataFrame([(f"{at}/ok",), (f"{at}/busy",), (f"{at}/gone",), (f"{at}/text",), ("http://127.0.0.1:1/",), (None,)], "url string")
    got = {(r["url"] or "").removeprefix(at): (r["status"], r["body"]) for r in fetch.fetched(df, timeout=5, wait=0.1).collect()}
    assert got["/ok"] == (200, b"<p>hello</p>")
    assert got["/busy"][0] == 200
    assert got["/gone"] == (404, None)
    assert got["/text"] == (200, None)
    assert got["http://127.0.0.1:1/"] == (0, None) and got[""] == (0, None)
    hosts = spark.createDataFrame([(at.removeprefix("http://"),)], "host string")
    assert [r["content"] for r in fetch.robots_files(hosts, "http").collect()] == ["User-agent: *\nDisallow: /x"]
    slow = spark.createDataFrame([(f"{at}/slow{k}", "h", k, 0.4) for k in range(3)], "url string, host string, start_s long, delay double").repartition(3)
    assert fetch.fetched(slow, timeout=5).count() == 3
    asked = [t for p, t in Handler.at if p.startswith("/slow")]
    assert len(asked) == 3 and min(b - a for a, b in zip(asked, asked[1:])) >= 0.39
    assert [p for p, _ in Handler.at if p.startswith("/slow")] == ["/slow0", "/slow1", "/slow2"]
    server.shutdown()
