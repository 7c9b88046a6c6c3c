"""HTML extraction (OP-02, OP-16): a table-valued function over pages, by the standard library's tokeniser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.urls import absolute_url, url_host

# Fixed values of the extraction rules.
GARBAGE = frozenset("script style iframe aside nav footer".split())
AD_MARKS = ("ad", "banner", "promo")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# End of fixed values.


class PageParser(HTMLParser):
    """One page: ``links`` of (href, in_garbage), ``passages`` of (text, type), and counts of tags and depth."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links: list[tuple[str, bool]] = []
        self.passages: list[tuple[str, str]] = []
        self.garbage, self.header, self.depth, self.dom_depth, self.tags = 0, 0, 0, 0, 0
        self.refused = False
        self.text: list[str] = []

    def flush(self) -> None:
        text = "".join(self.text).strip()
        self.text = []
        if text and not self.garbage and not self.refused:
            self.passages.append((text, "h" if self.header else "b"))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.flush()
        if self.refused:
            return
        self.tags += 1
        self.depth += 1
        self.dom_depth = max(self.dom_depth, self.depth)
        own = dict(attrs)
        if tag == "a" and own.get("href"):
            self.links.append((own["href"], self.garbage > 0))
        if self.garbage:
            return
        if tag == "html" and own.get("lang") is not None and "en" not in own["lang"].lower():
            self.refused = True  # a page of another language gives nothing
        elif tag in ("h1", "h2"):
            self.header = (self.header + ord(tag[1])) % 256
        elif tag in GARBAGE or (tag == "div" and any(m in (own.get(k) or "") for k in ("class", "id") for m in AD_MARKS)):
            self.garbage += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.flush()

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if self.refused:
            return
        if tag not in VOID:
            self.depth -= 1
        if tag in ("h1", "h2"):
            self.header = (self.header - ord(tag[1])) % 256
        if self.garbage and (tag in GARBAGE or tag == "div"):
            self.garbage -= 1  # any closing div ends a level, as the rules have it

    def handle_comment(self, data: str) -> None:
        self.flush()  # a comment or declaration parts two text nodes

    def handle_decl(self, decl: str) -> None:
        self.flush()

    def unknown_decl(self, data: str) -> None:
        self.flush()

    def handle_pi(self, data: str) -> None:
        self.flush()

    def handle_data(self, data: str) -> None:
        self.text.append(data)


def parse(html: str | None) -> PageParser:
    p = PageParser()
    p.feed(html or "")
    p.close()
    p.flush()
    return p


SCHEMA = "url string, passages array<struct<text:string,type:string>>, links array<struct<href:string,in_garbage:boolean>>, dom_depth int, tag_count int, indexable boolean"


def parse_pages(pages: DataFrame) -> DataFrame:
    """OP-16: one row of each page of ``url, html``: passages, links as written, counts. Null html gives empty arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse(h.as_py()) for h in b.column(1)]
            passages = pa.array([[{"text": t, "type": k} for t, k in p.passages] for p in got], pa.list_(pa.struct([("text", pa.string()), ("type", pa.string())])))
            links = pa.array([[{"href": h, "in_garbage": g} for h, g in p.links] for p in got], pa.list_(pa.struct([("href", pa.string()), ("in_garbage", pa.bool_())])))
            counts = [pa.array([getattr(p, k) for p in got], pa.int32()) for k in ("dom_depth", "tags")]
            yield pa.record_batch([b.column(0), passages, links, *counts, pa.array([not p.refused for p in got])], names=["url", "passages", "links", "dom_depth", "tag_count", "indexable"])

    return pages.select("url", "html").mapInArrow(run, SCHEMA)


def page_passages(parsed: DataFrame) -> DataFrame:
    return parsed.select("url", F.posexplode("passages").alias("pos", "p")).select("url", "pos", "p.text", F.col("p.type").alias("ptype"))


def page_links(parsed: DataFrame, garbage: bool = False) -> DataFrame:
    """OP-16d: ``url, link, same_domain`` of usable links: absolute, https, no path that ends with .pdf or .xml, and of the values
    of the parameter ``format``, if there is one, one that is html."""
    rows = parsed.select("url", F.explode("links").alias("a"))
    if not garbage:
        rows = rows.filter("not a.in_garbage")
    rows = rows.select("url", absolute_url(F.col("a.href"), F.col("url")).alias("link")).filter("link is not null")
    path, query = F.regexp_extract("link", r"^[a-z]+://[^/?#]*([^?#]*)", 1), F.regexp_extract("link", r"\?([^#]*)", 1)
    kinds = F.regexp_extract_all(query, F.lit("(?:^|&)format=([^&]*)"), F.lit(1))
    usable = ~F.lower(path).rlike(r"\.(pdf|xml)$") & ((F.size(kinds) == 0) | F.array_contains(kinds, "html"))
    return rows.filter(usable).withColumn("same_domain", F.contains(url_host(F.col("url")), url_host(F.col("link"))))


def page_features(parsed: DataFrame, links: DataFrame) -> DataFrame:
    """OP-16f, 16g: ``url, dom_depth, tag_count, url_count, url_len, path_len, host_len``; lengths in bytes."""
    n = links.groupBy("url").agg(F.count("*").cast("int").alias("n"))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return parsed.join(n, "url", "left").select("url", "dom_depth", "tag_count", F.coalesce("n", F.lit(0)).alias("url_count"), F.octet_length("url").alias("url_len"), F.octet_length(path).alias("path_len"), F.octet_length(host).alias("host_len"))


CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([A-Za-z0-9_\-]+)", re.I)


def decoded(pages: DataFrame) -> DataFrame:
    """OP-02: ``url, html`` from ``url, content_type, body`` (binary): the charset of the header, else of a meta tag, else UTF-8."""

    def text(kind: str | None, body: bytes | None) -> str | None:
        if body is None:
            return None
        m = CHARSET.search(kind or "") or CHARSET.search(body[:2048].decode("latin-1"))
        try:
            return body.decode(m.group(1) if m else "utf-8", "replace")
        except LookupError:
            return body.decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([text(k.as_py(), x.as_py()) for k, x in zip(b.column(1), b.column(2), strict=True)], pa.string())], names=["url", "html"])

    return pages.select("url", "content_type", "body").mapInArrow(run, "url string, html string")
