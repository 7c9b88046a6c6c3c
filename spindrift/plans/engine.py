"""The public surface: crawl control and search, as Python functions in place of HTTP routes."""

from __future__ import annotations

import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import search as S
from spindrift.operators import spelling
from spindrift.plans.config import Config
from spindrift.plans.crawl_round import Crawl, Round
from spindrift.plans.store import IndexStore
from spindrift.sources import fetch
from spindrift.sources.crawl_files import read_blocklist


class EngineError(Exception):
    """A refused call, with the status a route would answer."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


class Engine:
    """Search over an :class:`IndexStore`, and the state of a crawl whose rounds the caller runs."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self.store = IndexStore(spark, config.index_path)
        self.running = False
        self.started: datetime | None = None
        self.frontier: list[str] = []

    def crawl_start(self) -> int:
        if self.running:
            raise EngineError(400, "already running")
        self.running, self.started, self.frontier = True, datetime.now(UTC), list(self.config.base_urls)
        return 201

    def crawl_add(self, urls: list[str]) -> int:
        if not 1 <= len(urls) <= 50:
            raise EngineError(400, "1 to 50 urls")
        if not self.running or len(self.frontier) + len(urls) > self.config.worker_count * 25:
            raise EngineError(417, "not running, or the queue is full")
        self.frontier += urls
        return 202

    def crawl_state(self) -> dict:
        docs = self.store.documents()
        n = 0 if docs is None else docs.count()
        up = str(datetime.now(UTC) - self.started) if self.started and self.running else ""
        return {"running": self.running, "started": self.started.isoformat() if self.started else "", "uptime": up, "documents": n}

    def crawl_stop(self) -> int:
        if not self.running:
            raise EngineError(409, "not running")
        self.running = False
        return 200

    def crawl_step(self, crawl: Crawl) -> Round:
        """Seeds what was added since the last step and runs one round of the crawl."""
        if not self.running:
            raise EngineError(409, "not running")
        if self.frontier:
            crawl.seed(self.frontier)
            self.frontier = []
        return crawl.run()

    def live_crawl(self, rules: DataFrame | None = None) -> Crawl:
        """A crawl by HTTP as the settings have it; the blocklist is read from ``filter_url``, a path that Spark can read."""
        c = self.config
        return Crawl(self.store, fetch.live_pages, c.worker_count, rules, c.only_same_domain, read_blocklist(self.spark, c.filter_url), fetch.live_sitemaps)

    def slots(self, query: str) -> tuple[list[str], DataFrame | None]:
        """OP-40, 50, 57: the terms of the query, corrected where the index lacks a word, and their postings.

        Corrections depend on those before, so words are worked on in turn; a query has few.
        """
        words, tokens = S.query_tokens(self.spark, query)
        out: list[tuple[str, DataFrame]] = []
        at = 0
        for kind, term in tokens:
            rows = self.store.postings_of([term])
            if kind == "WORD" and rows.limit(1).count() == 0:
                before = len(words)
                words = spelling.correct(words, at, self.store.trigrams(), self.store.bigrams(words[at - 1] if at else None, words[at + 1] if at + 1 < len(words) else None), self.config.max_typo)
                again = S.query_tokens(self.spark, words[at])[1]
                if not again:
                    at += 1
                    continue
                term = again[0][1]
                rows = self.store.postings_of([term])
                if len(words) > before:
                    at += 1
                    second = S.query_tokens(self.spark, words[at])[1]
                    if second:
                        rows = spelling.merge_slots(rows.select("doc_id", "tf", "positions"), self.store.postings_of([second[0][1]]).select("doc_id", "tf", "positions"))
            out.append((term, rows.select(F.lit(len(out)).alias("slot"), "doc_id", "tf", "positions")))
            at += kind == "WORD"
        if not out:
            return [], None
        every = out[0][1]
        for _, rows in out[1:]:
            every = every.unionByName(rows)
        return [t for t, _ in out], every

    def search(self, query: str, cap: str | int | None = None) -> tuple[DataFrame | None, dict]:
        """OP-48: (result in order of ``rank``, metrics); no result for an empty query.

        The ranking is run here, so that its time counts: ``handle_query``, ``fetch_and_process`` (postings to ranked candidates),
        ``sort`` (the two phases) and ``total`` in seconds, and ``total_results``, the rows of the result.
        """
        if not query:
            raise EngineError(400, "query is missing")
        t0 = time.monotonic()
        slots, rows = self.slots(query)
        t1 = time.monotonic()
        docs = self.store.documents()
        if rows is None or docs is None:
            return None, {"handle_query": t1 - t0, "fetch_and_process": 0.0, "sort": 0.0, "total": time.monotonic() - t0, "total_results": 0}
        ranked = S.rank(rows, slots, docs.select("doc_id", "url", "token_count"), self.store.corpus_stats()).cache()
        ranked.count()
        t2 = time.monotonic()
        result = S.top(ranked, S.cap(cap)).cache()
        n = result.count()
        ranked.unpersist()
        t3 = time.monotonic()
        return result, {"handle_query": t1 - t0, "fetch_and_process": t2 - t1, "sort": t3 - t2, "total": t3 - t0, "total_results": n}
