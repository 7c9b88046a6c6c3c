import math

import pytest
from pyspark.sql import functions as F

from spindrift.operators import index as I
from spindrift.operators import search as S


@pytest.mark.parametrize(
    "positions,expected",
    [
        ([[10, 20, 30], [15, 25], [35]], 15),
        ([[], [15, 25], [35]], 60),
        ([[]], (1 << 63) - 1),
        ([[10], []], 50),
        ([[10], [5]], 50),
        ([[5, 15], [10, 20], [25, 35]], 10),
        ([[100], [30, 140, 200]], 40),
    ],
)
def test_proximity(spark, positions, expected):
    df = spark.createDataFrame([(positions,)], "p array<array<int>>")
    assert df.select(S.proximity(F.col("p"), len(positions)).alias("x")).first()["x"] == expected


@pytest.mark.parametrize("url,terms,letters", [("google.com", ["google.com"], 10), ("google.com", ["/////////"], 0), ("searchqueryexample", ["search", "example"], 13)])
def test_url_match(spark, url, terms, letters):
    assert spark.createDataFrame([(url,)], "u string").select(S.url_match(F.col("u"), terms).alias("x")).first()["x"] == pytest.approx(math.log1p(letters))


def test_short_documents_score_below_zero(spark):
    row = spark.range(1).select(S.bm25(F.lit(1.0), F.lit(0.01), F.lit(50.0), F.lit(100.0)).alias("x")).first()
    assert row["x"] < 0


@pytest.mark.parametrize("given,expected", [(None, 100), ("x", 100), ("3", 10), ("250", 250), (7, 10)])
def test_cap(given, expected):
    assert S.cap(given) == expected


def test_two_phase_order(spark):
    rows = [("a", "u", 3.0, 1.0, 5, 0.0, False), ("b", "u", 2.0, 1.0, 5, 2.0, False), ("c", "u", 2.0, 1.0, 4, 2.0, True), ("d", "u", 1.0, 9.0, 1, 9.0, True)]
    df = spark.createDataFrame(rows, "doc_id string, url string, bm25 double, tf_idf double, proximity long, url_match double, has_header boolean")
    assert [r["doc_id"] for r in S.top(df, 3).orderBy("rank").collect()] == ["c", "b", "a"]


def test_ordinals_run_across_passages(spark):
    rows = [("d", 1, "beta", "b"), ("d", 0, "alpha of alpha", "h"), ("d", 1, "beta", "b"), ("d", 2, None, "b"), (None, 0, "x", "b")]
    once = I.passages_once(spark.createDataFrame(rows, "doc_id string, pos int, text string, ptype string"))
    got = {(r["term"], r["i"], r["ptype"]) for r in I.term_rows(once).collect()}
    assert got == {("alpha", 0, "h"), ("alpha", 1, "h"), ("beta", 2, "b")}
    assert {(r["w1"], r["w2"], r["freq"]) for r in I.bigrams(once).collect()} == {("alpha", "alpha", 1), ("alpha", "beta", 1)}


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "doc_id string, pos int, text string, ptype string")
    rows = I.term_rows(none)
    assert I.postings(rows).count() == 0
    assert tuple(I.corpus_stats(I.doc_stats(rows)).first()) == (0, None)


def test_positions_are_cut_and_counts_are_not(spark):
    rows = spark.createDataFrame([("d", 0, "tide " * 700, "b")], "doc_id string, pos int, text string, ptype string")
    r = I.postings(I.term_rows(rows)).first()
    assert (r["tf"], len(r["positions"]), r["positions"][-1]["i"]) == (700, 500, 499)
