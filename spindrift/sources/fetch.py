"""Live fetching (OP-01, OP-03, OP-06) for crawls outside tests: one HTTP request of each row, in Arrow batches."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.sources.html import decoded

# Fixed values of the fetch rules; the agent is our own name.
AGENT = "SpindriftBot/1.0"
MAX_BYTES = 10 << 20
TRIES, WAIT_S, TIMEOUT_S, ROBOTS_TIMEOUT_S = 3, 15, 30, 3
# End of fixed values.


def get(url: str, accept: str = "text/html", timeout: float = TIMEOUT_S, wait: float = WAIT_S) -> tuple[int, str, bytes | None]:
    """(status, content type, body): the body only of a 2xx answer; after a 429 it waits and tries again, three times in all;
    0 for an address that does not answer."""
    for left in range(TRIES - 1, -1, -1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT, "Accept": accept}), timeout=timeout) as r:
                return r.status, r.headers.get("Content-Type", ""), r.read(MAX_BYTES)
        except urllib.error.HTTPError as e:
            if e.code != 429 or not left:
                return e.code, "", None
            time.sleep(wait)
        except (OSError, ValueError):
            return 0, "", None
    return 0, "", None


def fetched(urls: DataFrame, html_only: bool = True, timeout: float = TIMEOUT_S, wait: float = WAIT_S) -> DataFrame:
    """``url, status, content_type, body`` of each row of ``url``; with ``html_only`` other content has no body. A null url has
    status 0. A task fetches its rows in turn, so partitions bound the requests under way.

    With the columns ``host, start_s, delay`` of a schedule (OP-69) all requests of a host are one task's, in order of ``start_s``,
    and each waits until ``delay`` seconds after the one before, however late the task began.
    """
    polite = {"host", "start_s", "delay"} <= set(urls.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free: dict[str, float] = {}  # when each host may be asked again
        for b in batches:
            rows = []
            for i, u in enumerate(b.column(0)):
                if polite and u.is_valid:
                    host = b.column(1)[i].as_py()
                    time.sleep(max(0.0, free.get(host, 0.0) - time.monotonic()))
                    free[host] = time.monotonic() + b.column(2)[i].as_py()
                rows.append(get(u.as_py(), "text/html" if html_only else "*/*", timeout, wait) if u.is_valid else (0, "", None))
            bodies = [x if not html_only or "text/html" in kind else None for _, kind, x in rows]
            yield pa.record_batch([b.column(0), pa.array([s for s, _, _ in rows], pa.int32()), pa.array([k for _, k, _ in rows], pa.string()), pa.array(bodies, pa.binary())], names=["url", "status", "content_type", "body"])

    rows = urls.select("url")
    if polite:
        # the hosts of a round are as many as its workers at most, and their requests are few
        rows = urls.repartition("host").sortWithinPartitions("start_s", "url").select("url", "host", F.col("delay").cast("double").alias("delay"))
    return rows.mapInArrow(run, "url string, status int, content_type string, body binary")


def live_pages(urls: DataFrame) -> DataFrame:
    """``url, html`` of a round's schedule: what a :class:`spindrift.plans.crawl_round.Crawl` fetches with outside tests."""
    return decoded(fetched(urls).filter("body is not null").select("url", "content_type", "body"))


def live_sitemaps(pages: DataFrame) -> DataFrame:
    """OP-06: ``page_url, xml`` of ``page_url, url, host, start_s, delay``: the sitemaps that answer 200."""
    got = fetched(pages.select("url", "host", "start_s", "delay"), html_only=False).filter("status = 200")
    return got.join(pages.select("url", "page_url"), "url").select("page_url", F.decode("body", "UTF-8").alias("xml"))


def robots_files(hosts: DataFrame, scheme: str = "https") -> DataFrame:
    """OP-03: ``host, content`` of the robots.txt files that answer 200."""
    urls = hosts.select(F.concat(F.lit(f"{scheme}://"), F.col("host"), F.lit("/robots.txt")).alias("url"))
    rows = fetched(urls, html_only=False, timeout=ROBOTS_TIMEOUT_S).filter("status = 200")
    return rows.select(F.regexp_extract("url", r"^[a-z]+://([^/]*)", 1).alias("host"), F.decode("body", "UTF-8").alias("content"))
