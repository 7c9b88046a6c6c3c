"""Small literal inputs of operators for which the data folder has no table (HTML, robots files, sitemaps, blocklists)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HTML = [
    ("https://a.example/x/one.html", '<html lang="en"><head><title>Tide tables</title><style>p{}</style></head><body><nav><a href="/menu">Menu</a><div>x</div>leak</nav><h1>Harbour <b>notes</b></h1><p>Read <a href="two.html#top">the next</a> page &amp; more.</p><div class="promo">Buy now</div><a href="https://b.example/doc.pdf">pdf</a><a href="?format=html">self</a><br><script>var a;</script></body></html>'),
    ("https://a.example/de", '<html lang="de"><body><p>Guten Tag</p></body></html>'),
    ("https://c.example/", "<html><body><h2>No label</h2><p>Plain text.</p><a href='//a.example/x/'>over</a><a href='javascript:go()'>js</a><a href='#here'>here</a><a href='http://c.example/plain'>http</a></body></html>"),
    ("https://c.example/empty", ""),
    ("https://d.example/q", '<html lang="EN-US"><body><p>one<!-- c -->two</p><a href="/a.pdf?x=1">a</a><a href="/q?format=xhtml">b</a><a href="/q?format=">c</a><a href="/p?file=a.pdf">d</a><a href="/q?format=pdf&amp;format=html">e</a></body></html>'),
]
ROBOTS = [
    ("a.example", "# rules\nUser-agent: *\nDisallow: /private\nDisallow: /tmp\nAllow: /tmp/open\nCrawl-delay: 5\n\nUser-agent: bot\nDisallow: /search\nCrawl-delay: soon"),
    ("b.example", "Disallow: /before\nUser-agent: bot\nAllow: /"),
    ("c.example", ""),
]
SITEMAPS = [
    ("https://a.example/", '﻿<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a.example/x?a=1&amp;b=2 </loc></url><url><loc>/y</loc></url><url><loc>https://z.example/</loc></url></urlset>'),
    ("https://b.example/", "<urlset><url><loc>https://b.example/broken"),
    ("https://c.example/p", '<s:sitemapindex xmlns:s="x"><s:sitemap><s:loc>https://c.example/s.xml</s:loc></s:sitemap></s:sitemapindex>'),
]
BLOCKLIST = ["! comment", "@@||good.example^", "||ads.example^", "||brapriyarguide.example^", "||example-ads.example", "plain.example"]


def html_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HTML, "url string, html string")


def robots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROBOTS, "host string, content string")


def robots_for_all(spark: SparkSession, links: DataFrame) -> DataFrame:
    """A robots.txt for every host of the links, as ``host, content``: agents in general may not read help pages, the agent ``bot``
    neither help nor view pages."""
    return links.select("host").distinct().select("host", F.lit("User-agent: *\nDisallow: /help\n\nUser-agent: Bot\nDisallow: /help\nDisallow: /view").alias("content"))


def sitemaps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SITEMAPS, "page_url string, xml string")


def blocklist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in BLOCKLIST], "value string")
