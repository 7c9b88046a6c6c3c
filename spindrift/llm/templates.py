"""Problem 2: page boilerplate mixed with main content.

Site template removal: the elements of each page (passages' lines, and the sentences, entries, labels and ends of lines: the
subtrees that a passage table still shows) are hashed, the pages of each host with an element are counted in Spark, and
elements that recur across many pages of a host, or of the whole crawl, are the template. What the template covers is dropped
from each page; titles listed under a template heading go with it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from spindrift.llm import page_text as T
from spindrift.llm.pages import analysed, gathered

#: an element is of the template from so many pages of its host, and this share of them
MIN_PAGES, MIN_SHARE = 4, 0.02
#: an element is of every host's template that is of this share of the hosts', two at least
HOST_SHARE = 0.02
#: whole lines, labels, ends and heads of lists are of the template from so many pages of the crawl, and this share of them
ALL_PAGES, ALL_SHARE = 6, 0.002
#: pages with a smaller share of clauses do not count: their words are not a template for recurring
VOTE = 0.25
#: share of a heading's pages on which a list of titles follows it
LIST_SHARE = 0.4
#: share of a passage's letters that the template covers
COVER = 0.5
#: lines that are decided in one group; the pages of a larger host are dealt to several
GROUP_LINES = 200_000


def _elements(*names: str) -> Column:
    """The distinct hashes of the columns; 0 is none."""
    return F.array_remove(F.array_distinct(F.concat(*names)), F.lit(0).cast("long"))


def templates(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``site, h`` of the elements that recur in a host, ``h`` of those that recur in several hosts or the whole crawl).

    A page gives an element once, so a count is a partial sum before its shuffle; the elements of a page of several chunks are
    made distinct first and it votes as a whole. A line heads a list if the titles that follow it differ from page to page.
    """
    votes = lambda chars, clauses: clauses >= VOTE * chars
    short = table.filter("not more and chunk = 0 and n > 0").filter(votes(F.col("chars"), F.col("clauses")))
    page = Window.partitionBy("doc_id")
    long = table.filter("more or chunk <> 0").withColumns({"site": F.max("site").over(page), "whole": votes(F.sum("chars").over(page), F.sum("clauses").over(page))}).filter("whole and n > 0")
    if long.isEmpty():
        long = None  # then its plans are left out

    def of_pages(*columns) -> DataFrame:
        """The columns once for each page."""
        rows = short.select(*columns)
        return rows if long is None else rows.unionByName(long.select("doc_id", *columns).distinct().drop("doc_id"))

    own = of_pages("site").groupBy("site").agg(F.count("*").alias("pages"))
    sites = own.agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("total"), F.greatest(F.lit(2.0), HOST_SHARE * F.count("site")).alias("least"))  # one row
    count = of_pages("site", F.explode(_elements("l_whole", "l_label", "l_tail", "l_lossy", "p_h")).alias("h")).filter("site is not null").groupBy("site", "h").agg(F.count("*").alias("n"))
    host = count.filter(F.col("n") >= MIN_PAGES).join(own, "site").filter(F.col("n") >= MIN_SHARE * F.col("pages")).select("site", "h")
    shared = host.groupBy("h").agg(F.count("*").alias("n")).crossJoin(F.broadcast(sites)).filter("n >= least")
    lists = of_pages(F.explode(F.array_distinct(F.arrays_zip("h_head", "h_follows"))).alias("x")).groupBy("x.h_head", "x.h_follows").agg(F.count("*").alias("n"))
    lists = lists.groupBy(F.col("h_head").alias("h")).agg(F.sum("n").alias("n"), F.count_if(F.col("h_follows") != 0).alias("titles")).filter(F.col("titles") >= LIST_SHARE * F.col("n"))
    whole = of_pages(F.explode(_elements("l_whole", "l_label", "l_tail")).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    often = whole.unionByName(lists.select("h", "n")).filter(F.col("n") >= ALL_PAGES).crossJoin(F.broadcast(sites)).filter(F.col("n") >= ALL_SHARE * F.col("total"))
    return host, often.select("h").unionByName(shared.select("h"))


class Decision:
    """What the template leaves of the pages of a group. ``row`` and ``pos`` are those of each line; ``kept`` marks the lines
    of the main body; ``passage`` is where each passage begins among the lines, ``dropped`` whether none of it is left."""

    def __init__(self, pages: pa.Table, known: np.ndarray):
        col = lambda c: pages.column(c).combine_chunks()
        self.pages = pages
        self.values = lambda c: col(c).flatten().to_numpy(zero_copy_only=False)
        sizes = np.asarray(col("l_pos").value_lengths())
        self.row, self.pos, flags = np.repeat(np.arange(len(sizes)), sizes), self.values("l_pos"), self.values("l_flags")
        n = len(self.pos)
        of_template = lambda h: known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
        bit = lambda b: (flags & b) > 0
        self.title = bit(T.IS_PAGE_TITLE)
        whole, parts = self.values("l_whole"), self.values("l_parts")
        line, letters, hit = np.repeat(np.arange(n), parts), self.values("p_n"), of_template(self.values("p_h"))
        covered, every = np.bincount(line, letters * hit, n), np.bincount(line, letters, n)
        template = of_template(whole) | of_template(self.values("l_label")) | (bit(T.IS_LOST) & of_template(self.values("l_lossy")))
        template |= of_template(self.values("l_tail")) & ~bit(T.TAIL_IS_CUT)
        template |= (parts > 2) & ~bit(T.HAS_END) & (2 * np.bincount(line, hit, n) >= parts)
        template |= covered >= COVER * np.maximum(1, every)
        # titles that follow a template's head of a list, up to the first line that is neither
        heads, entry = template & of_template(whole ^ T.HEADING), (bit(T.IS_TITLE) | (bit(T.IS_LOST) & ~bit(T.HAS_END))) & ~bit(T.IN_HEADING)
        dropped, state, before = template.copy(), False, -1
        for i in np.flatnonzero(np.isin(self.row, np.unique(self.row[heads]))):
            state = state and self.row[i] == before
            before = self.row[i]
            if template[i]:
                state = state or heads[i]
            elif state and entry[i]:
                dropped[i] = True
            else:
                state = False
        self.kept = ~dropped
        self.passage = np.flatnonzero(np.r_[True, (self.row[1:] != self.row[:-1]) | (self.pos[1:] != self.pos[:-1])]) if n else np.zeros(0, int)
        self.dropped = np.logical_and.reduceat(dropped, self.passage) if n else np.zeros(0, bool)

    def sums(self, values: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Of each page the sum of its lines' values, of the lines that ``of`` marks."""
        return np.bincount(self.row[of], values[of], self.pages.num_rows)

    def listed(self, values: np.ndarray, of: np.ndarray, kind: pa.DataType) -> pa.Array:
        """Of each page the values of its passages, of the passages that ``of`` marks, as a list."""
        rows = self.row[self.passage][of]
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(rows, minlength=self.pages.num_rows))], pa.int32()), pa.array(values[of], kind))


def decided(table: DataFrame, columns: list[str], finish: Callable[[Decision], list[pa.Array]], ddl: str) -> DataFrame:
    """``finish`` of the pages of a host that are decided together, with their ``columns``; one row or none for each page.

    The pages of a host meet its template in one group; those of a host of many lines are dealt to several groups, each with a copy
    of the template. A host's template has at most 1 / MIN_SHARE times the mean number of a page's elements, and what is of every
    host's template at most a few thousand times that, whatever the size of the crawl: it alone goes to the driver, as 8 bytes each.
    """
    host, everywhere = templates(table)
    spark = table.sparkSession
    common = spark.sparkContext.broadcast(np.unique(np.array([r["h"] for r in everywhere.distinct().collect()], np.int64)))
    arrow = to_arrow_schema(_parse_datatype_string(ddl))
    own = F.coalesce("site", F.lit(0).cast("long"))
    sized = table.select(own.alias("site"), F.size("l_pos").alias("lines")).groupBy("site").agg(F.sum("lines").alias("lines")).filter(F.col("lines") > GROUP_LINES)
    salts = sized.select("site", F.ceil(F.col("lines") / GROUP_LINES).cast("int").alias("salts"))
    salts = F.broadcast(salts)  # a row for GROUP_LINES lines or more
    needed = dict.fromkeys(["l_pos", "l_flags", "l_whole", "l_label", "l_tail", "l_lossy", "l_parts", "p_h", "p_n", *columns])
    pages = table.filter("n > 0").withColumn("site", own).join(salts, "site", "left").select("site", F.pmod(F.xxhash64("doc_id", "chunk"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), *needed)
    known = host.join(salts, "site", "left").select("site", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), "h")

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        template = np.union1d(right.column("h").to_numpy(), common.value) if right.num_rows else common.value
        return pa.Table.from_arrays(finish(Decision(left, template)), schema=arrow)

    return pages.groupBy("site", "salt").cogroup(known.groupBy("site", "salt")).applyInArrow(group, ddl)


TEXTS = ("l_text array<string>", lambda _, lines: [pa.array(lines, pa.list_(pa.string()))])


def main_bodies(passages: DataFrame, index: DataFrame) -> DataFrame:
    """``doc_id, pos, text, boilerplate``: each passage with text, and its lines that belong to the main body.

    Null and empty passages have no row. Repeated rows count once, empty tables give no rows, extra columns are ignored.
    """
    ddl = "doc_id string, pos array<int>, text array<string>, boilerplate array<boolean>"

    def finish(d: Decision) -> list[pa.Array]:
        text = d.values("l_text")
        ends = [*d.passage[1:].tolist(), len(text)]
        left = np.array(["\n".join(text[a:b][d.kept[a:b]]) for a, b in zip(d.passage.tolist(), ends, strict=True)], object)
        every = np.ones(len(left), bool)
        return [d.pages.column("doc_id").combine_chunks(), d.listed(d.pos[d.passage], every, pa.int32()), d.listed(left, every, pa.string()), d.listed(d.dropped, every, pa.bool_())]

    rows = decided(analysed(gathered(passages, index), TEXTS), ["doc_id", "l_text"], finish, ddl)
    return rows.select("doc_id", F.explode(F.arrays_zip("pos", "text", "boilerplate")).alias("x")).select("doc_id", "x.pos", "x.text", "x.boilerplate")
