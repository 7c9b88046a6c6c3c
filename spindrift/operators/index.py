"""Index build (OP-30 to OP-39b): postings with positions, document and corpus statistics, bigrams, vocabulary, trigrams.

Inputs are passages ``doc_id, pos, text, ptype``; a corpus of whole texts has one passage of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions import text as X

MAX_POSITIONS = 500


def as_passages(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.lit(0).alias("pos"), "text", F.lit("b").alias("ptype"))


def passages_once(passages: DataFrame) -> DataFrame:
    """Each (doc_id, pos) once, with the greatest text; nulls in the key are dropped, a null type is body."""
    row = F.max(F.struct("text", "ptype")).alias("r")
    keyed = passages.filter(F.col("doc_id").isNotNull() & F.col("pos").isNotNull()).groupBy("doc_id", "pos").agg(row)
    return keyed.select("doc_id", "pos", "r.text", F.coalesce("r.ptype", F.lit("b")).alias("ptype"))


def passage_tokens(passages: DataFrame) -> DataFrame:
    """``doc_id, pos, ptype, tokens``; null and empty texts have no tokens."""
    return passages.select("doc_id", "pos", "ptype", F.coalesce(X.tokens(F.col("text")), F.expr("cast(array() as array<struct<type:string,value:string>>)")).alias("tokens"))


def token_rows(passages: DataFrame) -> DataFrame:
    """OP-20 to 23 as rows: ``doc_id, pos, i, type, value``."""
    return passage_tokens(passages).select("doc_id", "pos", F.posexplode("tokens").alias("i", "t")).select("doc_id", "pos", "i", "t.type", "t.value")


def term_rows(passages: DataFrame) -> DataFrame:
    """``doc_id, term, i, ptype``: ordinals run across the passages of a document, over kept terms only.

    The running sum is over passages, not over terms, so the window sorts few rows.
    """
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    arrays = passage_tokens(passages).select("doc_id", "pos", "ptype", X.terms(F.col("tokens")).alias("terms"))
    placed = arrays.withColumn("start", F.coalesce(F.sum(F.size("terms")).over(before), F.lit(0)))
    return placed.select("doc_id", "ptype", "start", F.posexplode("terms").alias("k", "term")).select("doc_id", "term", (F.col("start") + F.col("k")).cast("int").alias("i"), "ptype")


def postings(rows: DataFrame) -> DataFrame:
    """OP-30, 39a: ``term, doc_id, tf, positions`` with at most 500 positions, the first ones."""
    at = F.slice(F.sort_array(F.collect_list(F.struct("i", "ptype"))), 1, MAX_POSITIONS)
    return rows.groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"), at.alias("positions"))


def doc_stats(rows: DataFrame) -> DataFrame:
    """OP-31: ``doc_id, token_count, unique_tokens`` of documents with a term; terms are counted per document first."""
    per_term = rows.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return per_term.groupBy("doc_id").agg(F.sum("n").cast("int").alias("token_count"), F.count("*").cast("int").alias("unique_tokens"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """OP-39b: number of documents and average length, one row; the average of no documents is null."""
    return stats.agg(F.count("*").alias("documents"), F.avg("token_count").alias("avg_len"))


def doc_freq(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def passage_words(passages: DataFrame) -> DataFrame:
    return passage_tokens(passages).select("doc_id", "pos", X.words(F.col("tokens")).alias("words"))


def page_words(passages: DataFrame) -> DataFrame:
    """``doc_id, words``: the words of each page in order of its passages."""
    parts = F.sort_array(F.collect_list(F.struct("pos", "words")))
    return passage_words(passages).groupBy("doc_id").agg(F.flatten(F.transform(parts, lambda s: s["words"])).alias("words"))


def bigrams(passages: DataFrame) -> DataFrame:
    """OP-38: ``w1, w2, freq`` of adjacent words, also across passages.

    Pairs within a passage come from its array; the pair across a border from the last word of the passages before.
    """
    rows = passage_words(passages).filter(F.size("words") > 0)
    before = F.lag(F.element_at("words", -1)).over(Window.partitionBy("doc_id").orderBy("pos"))
    chain = rows.select(F.concat(F.when(before.isNull(), F.array().cast("array<string>")).otherwise(F.array(before)), F.col("words")).alias("w"))
    starts = F.when(F.size("w") >= 2, F.sequence(F.lit(0), F.size("w") - 2)).otherwise(F.array().cast("array<int>"))
    pairs = chain.select(F.explode(F.transform(starts, lambda i: F.struct(F.get("w", i).alias("w1"), F.get("w", i + 1).alias("w2")))).alias("p"))
    return pairs.groupBy("p.w1", "p.w2").agg(F.count("*").alias("freq"))


def merge_bigrams(old: DataFrame, new: DataFrame) -> DataFrame:
    """Incremental counts: the sums of both."""
    return old.unionByName(new).groupBy("w1", "w2").agg(F.sum("freq").alias("freq"))


def vocabulary(passages: DataFrame) -> DataFrame:
    return passage_words(passages).select(F.explode("words").alias("word")).distinct()


def trigrams(vocabulary: DataFrame) -> DataFrame:
    """OP-39: ``tri, word``; words under three letters have none."""
    return vocabulary.select(F.explode(X.letter_trigrams(F.col("word"))).alias("tri"), "word")
