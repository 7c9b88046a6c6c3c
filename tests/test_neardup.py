import numpy as np

from pyspark.sql import functions as F

from spindrift.operators import neardup as N


def test_similarity(spark):
    a = list(range(128))
    b, c = [-1, *a[1:]], [*a[:125], -1, -1, -1]
    row = spark.createDataFrame([(a, a, b, c)], "a array<int>, s array<int>, b array<int>, c array<int>").select(*[N.similarity(F.col("a"), F.col(x)).alias(x) for x in "sbc"]).first()
    assert tuple(row) == (1.0, 127 / 128, 125 / 128)


def test_keep_first_is_sequential(spark):
    # 1 ~ 2 and 2 ~ 3, but not 1 ~ 3: 2 is rejected, so 3 is kept
    base = np.arange(128)
    two, three = base.copy(), base.copy()
    two[100:120] += 1000
    three[80:120] += 1000
    three[100:120] = two[100:120]
    rows = [(1, base.tolist()), (2, two.tolist()), (3, three.tolist()), (4, base.tolist()), (5, [7] * 128)]
    df = spark.createDataFrame(rows, "doc_id long, sig array<int>")
    assert {r["doc_id"]: (r["kept"], r["rep"]) for r in N.keep_first(df).collect()} == {1: (True, 1), 2: (False, 2), 3: (True, 3), 4: (False, 1), 5: (True, 5)}


def test_minhash_estimates_overlap(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, words), (2, words[:190] + [f"x{i}" for i in range(10)]), (3, ["a", "b"]), (4, None)]
    s = {r["doc_id"]: r["sig"] for r in N.signatures(spark.createDataFrame(rows, "doc_id int, words array<string>")).collect()}
    assert set(s) == {1, 2}
    assert 0.8 < np.mean(np.array(s[1]) == np.array(s[2])) < 1


def test_words_after_5000_count(spark):
    head = [f"w{i}" for i in range(5000)]
    rows = [(1, head), (2, head + [f"x{i}" for i in range(5000)])]
    s = {r["doc_id"]: r["sig"] for r in N.signatures(spark.createDataFrame(rows, "doc_id int, words array<string>")).collect()}
    assert 0.3 < np.mean(np.array(s[1]) == np.array(s[2])) < 0.7  # half of the shingles are shared


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, sig array<int>")
    assert N.pairs(none).count() == 0
    assert N.keep_first(none).count() == 0
