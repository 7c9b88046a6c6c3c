import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as X


def tokens(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(X.tokens(F.col("t")).alias("x")).first()["x"]
    return None if row is None else [(t["type"], t["value"]) for t in row]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Hello, world!", [("WORD", "hello"), ("SYMBOL", ","), ("WORD", "world"), ("SYMBOL", "!")]),
        ("192.168.1.1, https://web.stanford.edu/class/cs224n/", [("IP_V4_ADDR", "192.168.1.1"), ("SYMBOL", ","), ("URL_ADDR", "https://web.stanford.edu/class/cs224n/")]),
        ("abchttp://x.yz", [("WORD", "abc"), ("URL_ADDR", "http://x.yz")]),
        ("für 3.14 ...)", [("WORD", "f"), ("WORD", "r"), ("NUMBER", "3"), ("SYMBOL", "."), ("NUMBER", "14"), ("SYMBOL", "...)")]),
        ("some.one@mail.example.org", [("EMAIL_ADDR", "some.one@mail.example.org")]),
        ("", []),
        (None, None),
        ("\x01a\x01", [("WORD", "a")]),
    ],
)
def test_tokens(spark, text, expected):
    assert tokens(spark, text) == expected


STEMS = {
    "connected": "connect", "connecting": "connect", "connection": "connect", "connections": "connect",
    "deception": "decept", "activate": "activ", "meeting": "meet", "at": "at", "ponies": "poni", "possesses": "possess",
}


def test_stems(spark):
    rows = spark.createDataFrame([(w,) for w in STEMS], "w string").select("w", X.stem(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in rows} == STEMS


def test_words_and_terms_leave_out_stop_words(spark):
    row = spark.createDataFrame([("The cats and 2 dogs were meeting.",)], "t string").select(X.tokens(F.col("t")).alias("t")).select(X.words(F.col("t")).alias("w"), X.terms(F.col("t")).alias("x")).first()
    assert row["w"] == ["cats", "dogs", "meeting"]
    assert row["x"] == ["cat", "2", "dog", "meet", "."]


def test_long_terms_are_left_out(spark):
    row = spark.createDataFrame([("a" * 70 + " b",)], "t string").select(X.terms(X.tokens(F.col("t"))).alias("x")).first()
    assert row["x"] == ["b"]


def test_shingles(spark):
    w = "this is a simple example for ngram testing".split()
    row = spark.createDataFrame([(w, w[:3])], "a array<string>, b array<string>").select(X.shingles(F.col("a")).alias("a"), X.shingles(F.col("b")).alias("b")).first()
    assert row["a"] == ["this is a simple", "is a simple example", "a simple example for", "simple example for ngram", "example for ngram testing"]
    assert row["b"] == []
