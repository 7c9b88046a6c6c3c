"""robots.txt, sitemaps and blocklists (OP-03 to OP-09) as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.urls import absolute_url, root_url, same_origin, url_host


def robots_rules(robots: DataFrame) -> DataFrame:
    """OP-04: ``host, agent, allow, disallow, delay`` from ``host, content``.

    A directive needs white space after its colon; lines before the first agent, comments and others are left out; a rule
    belongs to the last agent named. A delay that is no number is 0. Done within each file's array of lines.
    """
    line = F.filter(F.transform(F.split("content", "\n"), lambda s: F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), " ")), lambda p: (F.size(p) >= 2) & ~F.startswith(F.get(p, 0), F.lit("#")))
    start = F.struct(F.lit(None).cast("string").alias("agent"), F.expr("cast(array() as array<struct<agent:string,what:string,value:string>>)").alias("rows"))

    def step(acc: Column, p: Column) -> Column:
        what, value = F.lower(F.get(p, 0)), F.get(p, 1)
        named = what == "user-agent:"
        agent = F.when(named, value).otherwise(acc["agent"])
        return F.struct(agent.alias("agent"), F.when(agent.isNull(), acc["rows"]).otherwise(F.array_append(acc["rows"], F.struct(agent.alias("agent"), what.alias("what"), value.alias("value")))).alias("rows"))

    rows = robots.select("host", F.posexplode(F.aggregate(line, start, step, lambda a: a["rows"])).alias("i", "r")).select("host", "i", "r.*")
    values = lambda w: F.transform(F.sort_array(F.collect_list(F.when(F.col("what") == w, F.struct("i", "value")))), lambda s: s["value"])
    delay = F.max_by(F.coalesce(F.expr("try_cast(value as int)"), F.lit(0)), F.when(F.col("what") == "crawl-delay:", F.col("i")))
    return rows.groupBy("host", "agent").agg(values("allow:").alias("allow"), values("disallow:").alias("disallow"), F.coalesce(delay, F.lit(0)).alias("delay"))


def is_allowed(path: Column, disallow: Column) -> Column:
    """OP-05: whether no disallowed prefix fits; an allowed prefix changes nothing, as the default is to allow."""
    return ~F.coalesce(F.exists(disallow, lambda p: F.startswith(path, p)), F.lit(False))


def rules_for(rules: DataFrame, agent: str) -> DataFrame:
    """``host, disallow, delay`` that hold for an agent: its own group's if the host names it (in any case), else those for ``*``."""
    own = F.lower("agent") == agent.lower()
    best = F.max_by(F.struct("disallow", *(["delay"] if "delay" in rules.columns else [F.lit(0).alias("delay")])), own.cast("int"))
    return rules.filter(own | (F.col("agent") == "*")).groupBy("host").agg(best.alias("r")).select("host", "r.*")


def allowed_links(links: DataFrame, rules: DataFrame, agent: str, path: str = "path") -> DataFrame:
    """OP-08: links left by the rules of their host for the agent; hosts without rules allow all."""
    own = rules_for(rules, agent).select("host", "disallow")
    return links.join(own, "host", "left").filter(is_allowed(F.col(path), F.col("disallow"))).drop("disallow")


def sitemap_locs(sitemaps: DataFrame) -> DataFrame:
    """OP-06: ``page_url, loc`` from ``page_url, xml``; a byte order mark and name spaces are ignored, a broken file gives none."""
    xml = F.regexp_replace(F.col("xml"), "^﻿", "")
    locs = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?loc(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:\w+:)?loc>"), F.lit(1))
    closed = xml.rlike(r"(?s)</(?:\w+:)?(?:urlset|sitemapindex)>\s*$")
    plain = F.transform(locs, lambda s: F.replace(F.replace(F.replace(F.trim(s), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&")))
    return sitemaps.select("page_url", F.explode(F.when(closed, plain).otherwise(F.array().cast("array<string>"))).alias("loc"))


def sitemap_links(sitemaps: DataFrame) -> DataFrame:
    """OP-07: ``page_url, link``: absolute links of the page's own site."""
    rows = sitemap_locs(sitemaps).select("page_url", absolute_url(F.col("loc"), F.col("page_url")).alias("link")).filter("link is not null")
    return rows.filter(same_origin(url_host(F.col("link")), url_host(F.col("page_url"))))


def sitemap_url(url: Column) -> Column:
    return F.concat(root_url(url), F.lit("sitemap.xml"))


def blocklist_domains(lines: DataFrame) -> DataFrame:
    """OP-09: ``domain`` of the lines ``||domain^`` (column ``value``, as a text source gives them)."""
    value = F.trim("value")
    return lines.filter(value.rlike(r"^\|\|.*\^$")).select(F.regexp_extract(value, r"^\|\|(.*)\^$", 1).alias("domain")).distinct()


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    return blocklist_domains(spark.read.text(path))
