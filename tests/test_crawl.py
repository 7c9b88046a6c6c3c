import math

import pytest
from pyspark.sql import functions as F

from spindrift import fixtures
from spindrift.functions import quality as Q
from spindrift.operators import crawl
from spindrift.sources import crawl_files as C
from spindrift.sources import html as H


def links(spark, rows):
    return spark.createDataFrame(rows, "link_id long, link string, host string, priority double, depth int")


def test_visited_gate(spark):
    df = links(spark, [(1, "https://a.example/x", "a", 1.0, 3), (2, "http://www.a.example/x/", "a", 1.0, 3), (3, "https://a.example/x#t", "a", 1.0, 1), (4, None, None, 1.0, 0), (5, "https://b.example", "b", 1.0, 2)])
    assert {r["link_id"]: (r["action"], r["penalty"]) for r in crawl.visited_gate(df).collect()} == {1: ("visit", 0), 2: ("stop", 0), 3: ("expand", 2), 5: ("visit", 0)}


def test_priorities(spark):
    row = spark.range(1).select(
        crawl.page_priority(F.lit(3), F.lit(0.5), F.lit(2), F.lit(4)).alias("page"),
        crawl.child_priority(F.lit(2.0), F.lit(True), F.lit(1), F.lit(1.0), F.lit(4.0)).alias("child"),
    ).first()
    assert row["page"] == pytest.approx((1 + math.log(4)) * 0.25)
    assert row["child"] == pytest.approx(2 * 2 * 3 / 2 / 2 * 4**0.6)


def test_frontier_split_with_ties_and_nulls(spark):
    df = links(spark, [(1, "u", "a", 5.0, 1), (2, "u", "a", 7.0, 1), (3, "u", "a", 7.0, 1), (4, "u", "a", None, 1)])
    queue, rest = crawl.split_frontier(df, 2)
    assert sorted(r["link_id"] for r in queue.collect()) == [2, 3]
    assert sorted(r["link_id"] for r in rest.collect()) == [1, 4]
    assert [r["link_id"] for r in crawl.serve(df, 1).collect()] == [2]
    empty, _ = crawl.split_frontier(df.limit(0), 2)
    assert empty.count() == 0


def test_schedule(spark):
    df = links(spark, [(1, "u", "a", 5.0, 1), (2, "u", "a", 7.0, 1), (3, "u", "b", 1.0, 1), (4, "u", None, 1.0, 1)])
    delays = spark.createDataFrame([("b", 9), ("a", 4)], "host string, delay int")
    assert {r["link_id"]: r["start_s"] for r in crawl.schedule(df).collect()} == {2: 0, 1: 3, 3: 0}
    assert {r["link_id"]: r["start_s"] for r in crawl.schedule(df, delays).collect()} == {2: 0, 1: 4, 3: 0}


def test_blocklist(spark):
    block = C.blocklist_domains(fixtures.blocklist(spark))
    assert {r["domain"] for r in block.collect()} == {"ads.example", "brapriyarguide.example"}
    df = links(spark, [(1, "u", "x.ads.example", 1.0, 1), (2, "u", "ads.example", 1.0, 1), (3, "u", "loads.example", 1.0, 1), (4, "u", None, 1.0, 1)])
    assert sorted(r["link_id"] for r in crawl.not_blocked(df, block).collect()) == [3, 4]


def test_robots(spark):
    rules = {(r["host"], r["agent"]): (r["allow"], r["disallow"], r["delay"]) for r in C.robots_rules(fixtures.robots(spark)).collect()}
    assert rules == {("a.example", "*"): (["/tmp/open"], ["/private", "/tmp"], 5), ("a.example", "bot"): ([], ["/search"], 0), ("b.example", "bot"): (["/"], [], 0)}
    df = spark.createDataFrame([(1, "a.example", "/search?q"), (2, "a.example", "/x"), (3, "d.example", "/search")], "id int, host string, path string")
    assert sorted(r["id"] for r in C.allowed_links(df, C.robots_rules(fixtures.robots(spark)), "bot").collect()) == [2, 3]


def test_rules_for_all_agents_hold_where_ours_is_not_named(spark):
    rules = C.robots_rules(spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /private\nCrawl-delay: 5"), ("b.example", "User-agent: *\nDisallow: /\nUser-agent: spindriftbot\nDisallow: /tmp")], "host string, content string"))
    df = spark.createDataFrame([(1, "a.example", "/private/x"), (2, "a.example", "/x"), (3, "b.example", "/x"), (4, "b.example", "/tmp/y")], "id int, host string, path string")
    assert sorted(r["id"] for r in C.allowed_links(df, rules, "SpindriftBot").collect()) == [2, 3]
    assert {r["host"]: r["delay"] for r in C.rules_for(rules, "SpindriftBot").collect()} == {"a.example": 5, "b.example": 0}


def test_sitemap(spark):
    got = sorted(r["link"] for r in C.sitemap_links(fixtures.sitemaps(spark)).collect())
    assert got == ["https://a.example/x?a=1&b=2", "https://a.example/y", "https://c.example/s.xml"]


def test_html():
    p = H.parse(fixtures.HTML[0][1])
    assert [t for t, k in p.passages if k == "h"] == ["Harbour", "notes"]
    assert ("leak", "b") in p.passages  # a closing div ends the nav, as the rules have it
    assert ("Buy now", "b") not in p.passages
    assert p.links[0] == ("/menu", True)
    assert H.parse(fixtures.HTML[1][1]).refused
    assert H.parse(None).passages == []


def test_charset(spark):
    rows = [("a", "text/html; charset=windows-1251", bytearray("Привет".encode("cp1251"))), ("b", None, bytearray(b'<meta charset="latin-1">\xe9')), ("c", "text/html", None), ("d", "x; charset=nonsense", bytearray(b"ok"))]
    got = {r["url"]: r["html"] for r in H.decoded(spark.createDataFrame(rows, "url string, content_type string, body binary")).collect()}
    assert got == {"a": "Привет", "b": '<meta charset="latin-1">é', "c": None, "d": "ok"}


def test_quality_without_links_is_zero(spark):
    v = [F.lit(x) for x in (10, 100, 0, 120, 80, 30, 10, 12)]
    row = spark.range(1).select(Q.score(Q.features(*v)).alias("s")).first()
    assert row["s"] == 0.0
    assert spark.range(1).select(Q.skipped(F.lit(0.0), F.lit(120)).alias("k")).first()["k"] is True
