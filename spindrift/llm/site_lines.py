"""Problem 4: lines repeated across one site's documents.

Normalised lines are hashed, the distinct pages of each (site, hash) are counted, hashes above a share of the site's pages
are frequent, and a join back finds their occurrences and rebuilds the texts without them. Everything stays in the JVM.

A hot line of a hot site has one row per page before the count, since pages are made distinct in a partial aggregate first;
in the join back the rows are salted and the small side, one row per frequent line, is repeated once for each salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.urls import url_host
from spindrift.sources.tables import latest_documents

MIN_PAGES = 4
MIN_SHARE = 0.2
SALTS = 16
#: Unicode white space as of Python's str.isspace, no-break space included; a fixed value
SPACES = r"\s\x0B\x1C-\x1F\x85   -     　"


def normal_line(line: Column) -> Column:
    """Lower case, each run of digits one 0, white space left out."""
    return F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{Nd}+", "0"), f"[{SPACES}]+", "")


def sites(index: DataFrame) -> DataFrame:
    """``doc_id, site`` of pages that have a URL: the host in lower case without ``www.`` and port."""
    return latest_documents(index).select("doc_id", url_host(F.col("url")).alias("site")).filter(F.col("site").isNotNull())


def passages_once(passages: DataFrame) -> DataFrame:
    """Each (doc_id, pos) once; where repeated rows differ, the greatest text is kept. Null keys are dropped."""
    row = F.max(F.struct(F.col("text").cast("string").alias("text"), F.col("ptype").cast("string").alias("ptype"))).alias("r")
    keyed = passages.filter(F.col("doc_id").isNotNull() & F.col("pos").isNotNull())
    return keyed.groupBy(F.col("doc_id").cast("string").alias("doc_id"), F.col("pos").cast("int").alias("pos")).agg(row).select("doc_id", "pos", "r.text", "r.ptype")


def site_lines(passages: DataFrame, index: DataFrame) -> DataFrame:
    """``site, doc_id, pos, line_no, h``: every line that is not blank, of pages with a site; ``h`` hashes the normal line."""
    rows = passages.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & F.col("pos").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("pos").cast("int").alias("pos"), "text")
    lines = rows.select("doc_id", "pos", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).filter(F.col("line").rlike(f"[^{SPACES}]"))
    return lines.select("doc_id", "pos", "line_no", F.xxhash64(normal_line(F.col("line"))).alias("h")).join(sites(index), "doc_id").select("site", "doc_id", "pos", "line_no", "h")


def frequent_lines(lines: DataFrame, index: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``site, h, pages, site_pages`` of the lines in at least ``min_pages`` pages and ``min_share`` of the site's pages."""
    pages = lines.select("site", "h", "doc_id").distinct().groupBy("site", "h").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    total = sites(index).groupBy("site").agg(F.count("*").alias("site_pages"))
    return pages.join(total, "site").filter(F.col("pages") >= min_share * F.col("site_pages"))


def _occurrences(passages: DataFrame, index: DataFrame) -> DataFrame:
    lines = site_lines(passages, index)
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    often = frequent_lines(lines, index).select("site", "h", salt)
    return lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int")).join(often, ["site", "h", "salt"], "left_semi")


def found(passages: DataFrame, index: DataFrame) -> DataFrame:
    """``doc_id, pos, line_no`` of every occurrence of a frequent line.

    Lines are counted from 0 in their passage; blank ones do not count. Null and empty texts have no lines, repeated rows
    count once, pages without URL have no site and no cases, empty tables give no rows, extra columns are ignored.
    """
    return _occurrences(passages, index).select("doc_id", "pos", "line_no").distinct()


def cleaned(passages: DataFrame, index: DataFrame) -> DataFrame:
    """``doc_id, pos, text, removed``: every passage once, rebuilt without its frequent lines; ``removed`` counts them."""
    drop = _occurrences(passages, index).groupBy("doc_id", "pos").agg(F.collect_set("line_no").alias("drop"))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("drop", i)), "\n")
    return (
        passages_once(passages)
        .join(drop, ["doc_id", "pos"], "left")
        .select("doc_id", "pos", F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce(F.size("drop"), F.lit(0)).alias("removed"))
        .withColumn("removed", F.greatest("removed", F.lit(0)))
    )
