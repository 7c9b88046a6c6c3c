"""Problem 1: keyword-stuffed and link-list pages.

The suffix automaton of a page's words tells what its repeated maximal substrings cover. The characters of the page's own
sentences (four words or more up to a stop) that repeats do not cover are its clause structure: lists and links have no
sentences, and strings that imitate them are covered. A page of which the greater part lacks clause structure is spam. Site
lines do not count as a page's own. Links and tags of the crawl features move the bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm.pages import analysed, gathered
from spindrift.llm.templates import Decision, decided

#: characters of clauses must be under this share of the page's own characters
MAX_CLAUSES = 0.5
#: band about it where links and tags weigh
DOUBT = 0.06

DDL = "doc_id string, chunk long, links int, tags int, own long, clauses double, covered long, words long, dropped array<int>"


def _finish(d: Decision) -> list[pa.Array]:
    of = d.kept & ~d.title  # a title is no clause in any page
    own, good, hit, words = (d.sums(d.values(c), of) for c in ("l_own", "l_good", "l_hit", "l_words"))
    given = [d.pages.column(c).combine_chunks() for c in ("doc_id", "chunk", "links", "tags")]
    long = lambda x: pa.array(x.astype(np.int64))
    return [*given, long(own), pa.array(good.astype(np.float64)), long(hit), long(words), d.listed(d.pos[d.passage], d.dropped, pa.int32())]


def judged(passages: DataFrame, index: DataFrame, features: DataFrame) -> DataFrame:
    """``doc_id, chunk, links, tags, own, clauses, covered, words, dropped, spam``: one row for each chunk of a page; the figures
    are those of the whole page, ``dropped`` has the positions that the chunk's template covers.

    Pages without own text are not spam. Null link counts, and a 0, count as unknown, then the tags weigh; of repeated
    feature rows the greatest counts hold. Repeated passages count once; empty tables give no rows; extra columns are
    ignored.
    """
    rows = decided(analysed(gathered(passages, index, features)), ["doc_id", "chunk", "links", "tags", "l_own", "l_good", "l_hit", "l_words"], _finish, DDL)
    page = Window.partitionBy("doc_id")
    whole = rows.withColumns({c: F.sum(c).over(page) for c in ("own", "clauses", "covered", "words")} | {c: F.max(c).over(page) for c in ("links", "tags")})
    share = F.col("clauses") / F.col("own")
    # links to a word and tags to a word, where known: dense markup moves the bound up, sparse down
    dense = F.when(F.col("links") > 0, F.col("links") / F.greatest("words", F.lit(1)) > 1).otherwise(F.coalesce(F.col("tags") / F.greatest("words", F.lit(1)) > 2, F.lit(False)))
    bound = F.lit(MAX_CLAUSES) + F.when(dense, DOUBT / 2).otherwise(-DOUBT / 2)
    return whole.withColumn("spam", F.coalesce(F.when(F.col("own") > 0, share) < bound, F.lit(False)))


def found(passages: DataFrame, index: DataFrame, features: DataFrame) -> DataFrame:
    """Problem 1: the pages that are spam."""
    return judged(passages, index, features).filter("spam").select("doc_id").distinct()


def boilerplate(passages: DataFrame, index: DataFrame, features: DataFrame) -> DataFrame:
    """Problem 2: ``doc_id, pos`` of passages none of whose text belongs to the main body, spam pages left out."""
    return judged(passages, index, features).filter("not spam").select("doc_id", F.explode("dropped").alias("pos"))
