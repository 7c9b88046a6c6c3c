"""Crawl dataflow (OP-14, 15, 60 to 72) as batch rounds over link and frontier tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.urls import url_host, with_normal_url

RATE_SECONDS = 3


def page_priority(links: Column, similarity: Column, unique_tokens: Column, tokens: Column) -> Column:
    """OP-62: 1 plus ln(links + 1) if there are links, less what is similar, times the share of distinct terms."""
    base = F.lit(1.0) + F.when(links > 0, F.log(links + 1.0)).otherwise(0.0)
    return base * (1 - similarity) * F.when(tokens > 0, unique_tokens / tokens)


def child_priority(base: Column, same_domain: Column, depth: Column, penalty: Column, parent: Column) -> Column:
    """OP-63; ``depth`` is the child's."""
    return base * F.when(same_domain, 2.0).otherwise(1.0) * 3 / (depth + 1.0) / (penalty + 1.0) * F.pow(parent, F.lit(0.6))


def visited(links: DataFrame, url: str = "link") -> DataFrame:
    """OP-72: ``norm_url, depth, arrivals``: the least depth of each address."""
    rows = with_normal_url(links.filter(F.col(url).isNotNull()).select(url, "depth"), url)
    return rows.groupBy("norm_url").agg(F.min("depth").alias("depth"), F.count("*").alias("arrivals"))


def visited_gate(links: DataFrame, order: str = "link_id") -> DataFrame:
    """OP-61: ``link_id, action, penalty`` in order of arrival: ``visit`` a new address; ``stop`` at the depth known or more;
    at less depth ``expand`` the cached links again, with the gain as penalty. The running least depth streams in one sort."""
    w = Window.partitionBy("norm_url").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = with_normal_url(links.filter(F.col("link").isNotNull()).select(order, "link", "depth"), "link").withColumn("known", F.min("depth").over(w))
    action = F.when(F.col("known").isNull(), "visit").when(F.col("depth") >= F.col("known"), "stop").otherwise("expand")
    return rows.select(order, action.alias("action"), F.when(F.col("depth") < F.col("known"), F.col("known") - F.col("depth")).otherwise(0).alias("penalty"))


def host_suffixes(host: Column) -> Column:
    """All dot-suffixes of a host, itself first."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def not_blocked(links: DataFrame, blocklist: DataFrame, host: str = "host") -> DataFrame:
    """OP-14, 15: links none of whose host's suffixes is on the list (``domain``); exact. Distinct hosts are tested, so the list
    meets each host once; links without host stay."""
    hosts = links.select(F.col(host).alias("h")).filter("h is not null").distinct()
    bad = hosts.select("h", F.explode(host_suffixes(F.col("h"))).alias("domain")).join(blocklist.select("domain").distinct(), "domain", "left_semi").select("h").distinct()
    return links.join(bad, links[host] == bad["h"], "left_anti")


def serve(frontier: DataFrame, workers: int) -> DataFrame:
    """OP-65: the tasks of the highest priorities, as many as there are workers; a top-k without a full sort."""
    return frontier.orderBy(F.desc("priority"), F.asc("link_id")).limit(workers)


def split_frontier(frontier: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """OP-66, 67: (queue of the best ``capacity`` tasks, spilled rest, last in first).

    The border is the priority and id of the last task that fits: found by a top-k, joined as one row.
    """
    key = F.struct((-F.coalesce("priority", F.lit(float("-inf")))).alias("p"), F.col("link_id").alias("i"))
    keyed = frontier.withColumn("key", key)
    border = keyed.orderBy("key").limit(capacity).agg(F.max("key").alias("border"))
    both = keyed.crossJoin(F.broadcast(border))  # one row
    fits = F.coalesce(F.col("key") <= F.col("border"), F.lit(False))
    return both.filter(fits).drop("key", "border"), both.filter(~fits).drop("key", "border")


def schedule(frontier: DataFrame, delays: DataFrame | None = None) -> DataFrame:
    """OP-69: ``link_id, host, start_s``: the second at which a host's next request may go out, one for each delay."""
    w = Window.partitionBy("host").orderBy(F.desc("priority"), F.asc("link_id"))
    rows = frontier.filter("host is not null")
    delay = F.lit(RATE_SECONDS)
    if delays is not None:
        rows = rows.join(delays.select("host", "delay"), "host", "left")
        delay = F.when(F.col("delay") > 0, F.col("delay")).otherwise(RATE_SECONDS)
    return rows.select("link_id", "host", ((F.row_number().over(w) - 1) * delay).cast("long").alias("start_s"))


def expand(pages: DataFrame, links: DataFrame, only_same_domain: bool = False) -> DataFrame:
    """OP-60, 63, 64, 71: one round: the links of served pages as tasks of the next, with depth and priority.

    ``pages`` has ``doc_id, priority, depth, page_priority, penalty``; ``links`` the cached links of every page.
    """
    out = links.join(pages.select(F.col("doc_id").alias("src_doc_id"), F.col("priority").alias("parent"), F.col("depth").alias("parent_depth"), "page_priority", "penalty"), "src_doc_id")
    if only_same_domain:
        out = out.filter("same_domain")
    depth = F.col("parent_depth") + 1
    return out.select("link_id", "link", url_host(F.col("link")).alias("host"), "same_domain", depth.alias("depth"), child_priority(F.col("page_priority"), F.col("same_domain"), depth, F.col("penalty"), F.col("parent")).alias("priority"))
