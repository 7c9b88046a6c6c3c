import pytest
from pyspark.sql import functions as F

from spindrift.operators import spelling as P


def scored(spark, word, candidates):
    return spark.createDataFrame([(word, c, l, r) for c, (l, r) in candidates.items()], "word string, candidate string, l double, r double")


def test_best_replacement(spark):
    df = scored(spark, "qury", {"query": (0.99, 0.4), "qures": (0.25, 0.25), "quit": (0.9, 0.0)})
    assert P.best(df).first()["candidate"] == "query"


@pytest.mark.parametrize(
    "word,candidates,expected",
    [
        ("querytext", {"query": (0.99, 0.4), "qures": (0.1, 0.2), "quit": (0.9, 0.0), "text": (0.55, 0.6)}, ("query", "text")),
        ("somerequest", {"some": (0.99, 0.4), "something": (0.9, 0.0), "request": (0.55, 0.6)}, ("some", "request")),
    ],
)
def test_split(spark, word, candidates, expected):
    df = scored(spark, word, candidates)
    assert P.best(df).count() == 0
    r = P.splits(df).first()
    assert (r["first"], r["second"]) == expected


def test_distance_bound(spark):
    df = spark.createDataFrame([("testWord", "WordWithBigDistance"), ("первое", "первый")], "a string, b string")
    assert [r["d"] for r in df.select(F.levenshtein("a", "b", 3).alias("d")).collect()] == [-1, 2]


def test_ties_take_the_first_in_order_of_letters(spark):
    assert P.best(scored(spark, "cat", {"car": (0.0, 0.0), "bat": (0.0, 0.0)})).first()["candidate"] == "bat"


def test_merged_slots(spark):
    a = spark.createDataFrame([("d", 2, [1, 5]), ("e", 1, [3])], "doc_id string, tf int, positions array<int>")
    b = spark.createDataFrame([("d", 1, [2])], "doc_id string, tf int, positions array<int>")
    assert {r["doc_id"]: (r["tf"], r["positions"]) for r in P.merge_slots(a, b).collect()} == {"d": (3, [1, 5, 2]), "e": (1, [3])}
