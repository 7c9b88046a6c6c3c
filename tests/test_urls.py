import pytest
from pyspark.sql import functions as F

from spindrift.functions import urls as U


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url,expected",
    [
        ("https://www.example.com/", "example.com"),
        ("https://example.com//", "example.com"),
        ("https://example.com/?id=1", "example.com?id=1"),
        ("HTTP://WWW.Example.COM:8080/a//b/%7Ex+y?b=2&a=1&b=1#f", "example.com/a/b/~x+y?a=1&b=2&b=1"),
        ("https://e.example/a%zz", "e.example/a%zz"),
        ("https://e.example/A?Q=x%20y&n", "e.example/A?Q=x+y&n="),
        ("//e.example/x/", "e.example/x"),
        ("no url ", "no url"),
        (None, None),
    ],
)
def test_normalize(spark, url, expected):
    assert one(spark, U.normalize_url(F.col("u")), u=url) == expected
    df = spark.createDataFrame([(url, 1)], "u string, norm_url int")
    assert U.with_normal_url(df, "u").select("norm_url").first()[0] == expected


def test_root_and_origin(spark):
    assert one(spark, U.root_url(F.col("u")), u="https://www.example.com/") == "https://www.example.com/"
    assert one(spark, U.root_url(F.col("u")), u="https://hub.docker.com/repositories/x") == "https://hub.docker.com/"
    for link, base, same in (("google.com", "www.google.com/search", True), ("google.com", "support.google.com", True), ("google.com", "domains.google", False)):
        assert one(spark, U.same_origin(F.col("a"), F.col("b")), a=link, b=base) is same


@pytest.mark.parametrize(
    "href,expected",
    [
        ("https://b.example/x#t", "https://b.example/x"),
        ("//b.example/x", "https://b.example/x"),
        ("/r?q=1", "https://a.example/r?q=1"),
        ("c.html", "https://a.example/x/c.html"),
        ("../d", "https://a.example/d"),
        ("./e/../f/", "https://a.example/x/f/"),
        ("?p=2", "https://a.example/x/y?p=2"),
        ("http://b.example/", None),
        ("#top", None),
        ("JavaScript:go()", None),
        (" ", None),
        (None, None),
    ],
)
def test_absolute(spark, href, expected):
    assert one(spark, U.absolute_url(F.col("h"), F.col("b")), h=href, b="https://a.example/x/y?z=1") == expected
