"""One round of a crawl as a batch (OP-60): pop, serve, gate, fetch, parse, index, expand, spill.

The tables ``visited``, ``links``, ``signatures``, ``spill``, ``popped`` and ``frontier`` stand beside the index in its folder. A
round reads the frontier, takes its best tasks that the hosts' delays let it ask in time, leaves out blocked hosts and what was
visited at the same depth or less, indexes new pages that pass the quality and near-duplicate gates, adds the links of the sitemaps
of new hosts, and writes the frontier of the next round, bounded by ``capacity``: the rest is spilled, last in first out. Pages
seen again at less depth have their cached links expanded anew.

A round writes all tables but the frontier under its number, which stands in a row of the frontier; the frontier is replaced last.
So a round that died is run again by the same number and replaces what it left.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import quality as Q
from spindrift.functions.urls import normalize_url, url_host
from spindrift.operators import crawl
from spindrift.operators import index as I
from spindrift.operators import neardup as N
from spindrift.plans.store import IndexStore
from spindrift.sources import html as H
from spindrift.sources.crawl_files import allowed_links, is_allowed, rules_for, sitemap_links, sitemap_url
from spindrift.sources.tables import checkpoint_folder

AGENT = "SpindriftBot"
TASK = ("link", "host", "priority", "depth", "link_id")
FRONTIER = "link string, host string, priority double, depth int, link_id long"
LINKS = "src_doc_id string, link string, same_domain boolean"
VISITED = "norm_url string, depth int"
SIGNATURES = "doc_id string, sig array<int>"
SPILL = f"{FRONTIER}, spill_id long, round int"
#: the link of the frontier's row that has the number of the next round as its depth
MARK = ""
#: seconds after which a host's requests are left to the next round
ROUND_S = 300
PATH = r"^[A-Za-z]+://[^/?#]*([^?#]*)"


@dataclass
class Round:
    """What a round did."""

    served: int
    indexed: int
    frontier: int
    spilled: int = 0


class Crawl:
    """Rounds over a store. ``fetch`` makes ``url, html`` of ``url, host, start_s, delay``; ``rules`` are robots rules as a table,
    of which those for our agent hold, else those for ``*``; ``blocklist`` has the blocked ``domain``; ``sitemaps`` makes
    ``page_url, xml`` of ``page_url, url, host, start_s, delay``; ``capacity`` bounds the frontier."""

    def __init__(
        self,
        store: IndexStore,
        fetch: Callable[[DataFrame], DataFrame],
        workers: int = 50,
        rules: DataFrame | None = None,
        only_same_domain: bool = False,
        blocklist: DataFrame | None = None,
        sitemaps: Callable[[DataFrame], DataFrame] | None = None,
        capacity: int | None = None,
    ):
        self.store, self.fetch, self.workers, self.only_same_domain, self.blocklist, self.sitemaps = store, fetch, workers, only_same_domain, blocklist, sitemaps
        self.rules = None if rules is None else rules_for(rules, AGENT).withColumn("agent", F.lit(AGENT))
        self.capacity = capacity or workers * 50
        self.spark = store.spark
        checkpoint_folder(self.spark)

    def table(self, name: str, schema: str) -> DataFrame:
        return self.store.read(name) if self.store.exists(name) else self.spark.createDataFrame([], schema)

    def seed(self, urls: list[str]) -> None:
        rows = self.spark.createDataFrame([(u,) for u in urls], "link string").select("link", url_host(F.col("link")).alias("host"), F.lit(1.0).alias("priority"), F.lit(0).alias("depth"), F.xxhash64("link").alias("link_id"))
        self.store.replace("frontier", self.table("frontier", FRONTIER).select(*TASK).unionByName(rows))

    def gates(self, batch: str, pages: DataFrame, rows: DataFrame, links: DataFrame, sigs: DataFrame) -> DataFrame:
        """``doc_id, similarity, page_priority, kept`` of parsed pages (OP-33, OP-37, OP-62)."""
        near = N.similar_to(sigs, self.store.others("signatures", batch, SIGNATURES))
        n = links.groupBy(F.col("src_doc_id").alias("doc_id")).agg(F.count("*").alias("links"))
        c = F.col
        every = pages.select("doc_id", "url", "dom_depth", "tag_count").join(I.doc_stats(I.term_rows(rows)), "doc_id", "left").join(n, "doc_id", "left").join(near, "doc_id", "left").fillna(0, ["token_count", "unique_tokens", "links"]).fillna(0.0, ["similarity"])
        host = r"^[A-Za-z]+://([^/?#]*)"
        x = Q.features(c("dom_depth"), c("tag_count"), c("links"), c("token_count"), c("unique_tokens"), F.octet_length("url"), F.octet_length(F.regexp_extract("url", PATH, 1)), F.octet_length(F.regexp_extract("url", host, 1)))
        priority = crawl.page_priority(c("links"), c("similarity"), c("unique_tokens"), c("token_count"))
        good = ~Q.skipped(Q.score(x), c("token_count"))
        return every.select("doc_id", "url", F.coalesce(priority, F.lit(0.0)).alias("page_priority"), (c("similarity") == 0).alias("new"), ((c("similarity") == 0) & good & (c("token_count") > 0)).alias("kept"))

    def spilled(self, batch: str) -> DataFrame:
        """The spilled tasks that no other round popped."""
        return self.store.others("spill", batch, SPILL).join(self.store.others("popped", batch, "spill_id long"), "spill_id", "left_anti")

    def permitted(self, tasks: DataFrame) -> DataFrame:
        """OP-05, 14, 15: tasks that neither the blocklist nor the robots rules of their host refuse."""
        if self.blocklist is not None:
            tasks = crawl.not_blocked(tasks, self.blocklist)
        if self.rules is not None:
            own = self.rules.select("host", "disallow")
            tasks = tasks.join(own, "host", "left").filter(is_allowed(F.regexp_extract("link", PATH, 1), F.col("disallow"))).drop("disallow")
        return tasks

    def served(self, tasks: DataFrame) -> DataFrame:
        """OP-65, 69: the best tasks, as many as there are workers, with the second at which each may go out; those of a host with
        more than it may be asked within ROUND_S stay for the next round."""
        delays = None if self.rules is None else self.rules.select("host", "delay")
        best = crawl.serve(tasks, self.workers)
        timed = best.join(crawl.schedule(best, delays).select("link_id", "start_s"), "link_id", "left").fillna(0, ["start_s"]).filter(F.col("start_s") < ROUND_S)
        if delays is None:
            return timed.withColumn("delay", F.lit(crawl.RATE_SECONDS))
        return timed.join(delays.withColumnRenamed("delay", "d"), "host", "left").withColumn("delay", F.when(F.col("d") > 0, F.col("d")).otherwise(crawl.RATE_SECONDS)).drop("d")

    def sitemap_tasks(self, batch: str, new: DataFrame) -> DataFrame:
        """OP-06, 07: links of the sitemaps of hosts asked for the first time, as links of the first of their pages."""
        if self.sitemaps is None:
            return self.spark.createDataFrame([], LINKS)
        known = self.store.others("visited", batch, VISITED).select(F.regexp_extract("norm_url", "^[^/?]*", 0).alias("host")).distinct()
        first = new.groupBy("host").agg(F.min(F.struct("link", "doc_id", "delay")).alias("p")).join(known, "host", "left_anti")
        pages = first.select(F.col("p.link").alias("page_url"), F.col("p.doc_id").alias("src_doc_id"), sitemap_url(F.col("p.link")).alias("url"), "host", F.lit(0).alias("start_s"), F.col("p.delay").alias("delay"))
        return sitemap_links(self.sitemaps(pages.drop("src_doc_id"))).join(pages.select("page_url", "src_doc_id"), "page_url").select("src_doc_id", "link", F.lit(True).alias("same_domain"))

    def run(self) -> Round:
        store = self.store
        every = self.table("frontier", FRONTIER).select(*TASK)
        tasks, number = every.filter(F.col("link") != MARK), every.agg(F.coalesce(F.max(F.when(F.col("link") == MARK, F.col("depth"))), F.lit(0)).alias("n")).first()["n"]
        batch, short = f"round-{number}", self.workers - tasks.limit(self.workers).count()
        if short > 0 and store.exists("spill"):  # a frontier that is short of tasks takes back what was spilled last
            popped = self.spilled(batch).orderBy(F.desc("round"), F.desc("priority"), "link_id").limit(short).checkpoint()
            store.write("popped", batch, popped.select("spill_id"))
            tasks = tasks.unionByName(popped.select(*TASK))
        served = self.served(tasks).withColumn("norm_url", normalize_url(F.col("link"))).checkpoint()
        best = served.groupBy("norm_url").agg(F.min_by(F.struct("link", "host", "priority", "depth", "start_s", "delay"), F.struct("depth", "link_id")).alias("t")).select("norm_url", "t.*").withColumn("doc_id", F.sha2("norm_url", 256))
        best = self.permitted(best)
        seen = store.others("visited", batch, VISITED).groupBy("norm_url").agg(F.min("depth").alias("known"))
        gated = best.join(seen, "norm_url", "left").filter(F.col("known").isNull() | (F.col("depth") < F.col("known"))).checkpoint()
        new = gated.filter("known is null")
        got = self.fetch(new.select(F.col("link").alias("url"), "host", "start_s", "delay")).select("url", "html")
        parsed = H.parse_pages(got).join(new.select(F.col("link").alias("url"), "doc_id"), "url").checkpoint()
        links = H.page_links(parsed).join(parsed.select("url", "doc_id"), "url").select(F.col("doc_id").alias("src_doc_id"), "link", "same_domain")
        links = links.unionByName(self.sitemap_tasks(batch, new)).distinct()
        if self.rules is not None:
            links = allowed_links(links.withColumn("host", url_host(F.col("link"))).withColumn("path", F.regexp_extract("link", PATH, 1)), self.rules, AGENT).select("src_doc_id", "link", "same_domain")
        links = links.checkpoint()
        rows = I.passages_once(H.page_passages(parsed).join(parsed.select("url", "doc_id"), "url").select("doc_id", "pos", "text", "ptype"))
        sigs = N.signatures(I.page_words(rows)).checkpoint()
        verdict = self.gates(batch, parsed, rows, links, sigs).checkpoint()
        kept = verdict.filter("kept")
        n = kept.count()
        if n:
            store.add(kept.select("doc_id", "url"), rows.join(kept.select("doc_id"), "doc_id", "left_semi"), batch)
        store.write("signatures", batch, sigs.join(verdict.filter("new").select("doc_id"), "doc_id", "left_semi"))
        # a near-duplicate gives no links, as in the original
        good = links.join(verdict.filter("new").select(F.col("doc_id").alias("src_doc_id")), "src_doc_id", "left_semi")
        store.write("links", batch, good)
        pages = gated.join(verdict.select("doc_id", "page_priority"), "doc_id", "left").select("doc_id", "priority", "depth", F.coalesce("page_priority", F.lit(1.0)).alias("page_priority"), F.coalesce(F.col("known") - F.col("depth"), F.lit(0)).cast("double").alias("penalty"))
        again = store.read("links").drop("batch").distinct().withColumn("link_id", F.xxhash64("link", "src_doc_id"))
        children = crawl.expand(pages, again, self.only_same_domain).select(*TASK)
        rest = tasks.join(served.select("link_id"), "link_id", "left_anti").select(*TASK)
        queue, over = crawl.split_frontier(rest.unionByName(children).checkpoint(), self.capacity)
        over = over.select(*TASK, F.xxhash64("link_id", F.lit(batch), F.monotonically_increasing_id()).alias("spill_id"), F.lit(number).alias("round")).checkpoint()
        spilled = over.count()
        if spilled or store.exists("spill"):
            store.write("spill", batch, over)
        store.write("visited", batch, best.select("norm_url", "depth"))
        mark = self.spark.createDataFrame([(MARK, None, None, number + 1, -1)], FRONTIER)
        store.replace("frontier", queue.select(*TASK).unionByName(mark))
        return Round(served.count(), n, store.read("frontier").count() - 1, spilled)
