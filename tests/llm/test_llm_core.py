"""Problems 4, 5 and 7 against brute force, with nulls, repeated rows, ties, empty tables and clashing columns."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spindrift.llm import cuckoo, distinctive, site_lines

IDX = "doc_id string, url string, token_count int, html_lang string, fetched_at timestamp, text string"
PASSAGES = "doc_id string, pos int, text string, ptype string, site string, h int, n string"


def index(spark, rows):
    return spark.createDataFrame([(d, u, c, None, None, "x") for d, u, c in rows], IDX)


# problem 7


def test_cuckoo_has_no_false_negatives_and_grows():
    h = np.random.default_rng(1).integers(0, 1 << 63, 50_000).astype(np.uint64)
    f = cuckoo.CuckooFilter(1000)
    f.insert(h)
    assert f.contains(h).all()
    assert len(f) == len(h)
    assert len(f.tables) > 1
    assert f.bytes < 8 * len(h)
    other = np.random.default_rng(2).integers(0, 1 << 63, 50_000).astype(np.uint64)
    assert f.contains(other).mean() < 0.005


def test_cuckoo_deletes():
    h = np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64)
    f = cuckoo.CuckooFilter(1000)
    f.insert(h)
    assert f.delete(h[:2500]).all()
    assert f.contains(h[2500:]).all()
    assert f.contains(h[:2500]).mean() < 0.01
    f.insert(h[:1])
    f.insert(h[:1])
    assert f.delete(h[:1]).all() and f.contains(h[:1]).all()


def test_overflow_keeps_equal_entries():
    f = cuckoo.CuckooFilter(16)
    f.insert(np.full(12, 77, np.uint64))  # more equal entries than the eight slots of two buckets
    assert len(f) == 12 and len(f.overflow) >= 4
    g = cuckoo.CuckooFilter.load(f.dump())
    for left in range(11, -1, -1):
        assert g.delete(np.array([77], np.uint64)).all() and len(g) == left
    assert not g.contains(np.array([77], np.uint64)).any() and len(f) == 12


def test_kept_filters(spark):
    keys = lambda a, b: spark.createDataFrame([(f"k{i}", i, "x") for i in range(a, b)], "key string, at long, part string")
    state = cuckoo.changed(None, "key", keys(0, 3000), parts=4)
    state = spark.createDataFrame(cuckoo.changed(state, "key", keys(2000, 4000), keys(0, 1000), parts=4).collect(), state.schema)
    assert sorted(r["part"] for r in state.collect()) == [0, 1, 2, 3]
    got = {r["seq"]: r["maybe"] for r in cuckoo.maybe_seen(state, keys(0, 6000), "key", "at", parts=4).collect()}
    assert len(got) == 6000 and all(got[i] for i in range(1000, 4000))
    assert sum(got[i] for i in [*range(1000), *range(4000, 6000)]) < 20
    null = spark.createDataFrame([(None, 1)], "key string, at long")
    assert cuckoo.maybe_seen(state, null, "key", "at", parts=4).count() == 0
    assert not any(r["maybe"] for r in cuckoo.maybe_seen(state.limit(0), keys(0, 5), "key", "at", parts=4).collect())


def test_seen_keys_equals_a_set(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.35 else rng.choice([None, *(f"k{j}" for j in range(400))]), "x") for i in range(6000)]
    df = spark.createDataFrame(rows, "at long, key string, seq string").repartition(7)
    known = spark.createDataFrame([("k1",), ("k2",), ("k1",), (None,)], "key string")
    got = {r["seq"]: r["state"] for r in cuckoo.seen_keys(df, "key", "at", known).collect()}
    seen, want = {"k1", "k2"}, {}
    for i, k, _ in rows:
        if k is not None:
            want[i] = k in seen
            seen.add(k)
    assert {i: s == cuckoo.SEEN for i, s in got.items()} == want


def test_seen_keys_of_nothing(spark):
    none = spark.createDataFrame([], "at long, key string")
    assert cuckoo.seen_keys(none, "key", "at").count() == 0
    assert cuckoo.seen_keys(none, "key", "at", spark.createDataFrame([("a",)], "key string")).count() == 0


def test_found_links(spark):
    links = spark.createDataFrame([(1, "https://a.example/x", 0), (2, "http://www.A.example/x/#t", 0), (3, None, 0), (4, "https://seed.example", 0), (5, "https://b.example/%61?b=1&a=2", 0), (6, "https://b.example/a?a=2&b=1", 0)], "link_id long, link string, state int")
    seeds = spark.createDataFrame([("http://seed.example/",)], "url string")
    assert sorted(r["link_id"] for r in cuckoo.found(links, seeds, seeds.limit(0)).collect()) == [2, 4, 6]
    r = cuckoo.audit(links, seeds, seeds.limit(0)).first()
    assert (r["answers"], r["seen"], r["new"] + r["false_positives"]) == (5, 3, 2)
    assert r["entries"] == 3 - r["false_positives"] and r["bytes"] > 0 and 0 < r["load"] < 1


# problem 4


def test_site_lines(spark):
    docs = [(f"d{i}", f"https://www.S.example:443/{i}", 1) for i in range(10)] + [("e1", "https://t.example/", 1), ("none", None, 1)]
    rows = [(f"d{i}", 0, f"Body {chr(97 + i)} only\n  Share  THIS page {i * 7} \n\n" + ("rare 1" if i < 3 else ""), "b", "s", 1, "n") for i in range(10)]
    rows += [("d1", 0, rows[1][2], "b", "s", 1, "n"), ("d2", 1, None, "b", "s", 1, "n"), ("d3", 1, "share this page 5\nshare this page 9", None, "s", 1, "n"), ("none", 0, "Share this page 1", "b", "s", 1, "n"), (None, 0, "Share this page 1", "b", "s", 1, "n"), ("e1", 0, "Share this page 1", "b", "s", 1, "n")]
    p, idx = spark.createDataFrame(rows, PASSAGES), index(spark, docs)
    got = {(r["doc_id"], r["pos"], r["line_no"]) for r in site_lines.found(p, idx).collect()}
    assert got == {(f"d{i}", 0, 1) for i in range(10)} | {("d3", 1, 0), ("d3", 1, 1)}
    clean = {(r["doc_id"], r["pos"]): (r["text"], r["removed"]) for r in site_lines.cleaned(p, idx).collect()}
    assert clean["d5", 0] == ("Body f only\n\n", 1)
    assert clean["d3", 1] == ("", 2)
    assert clean["d2", 1] == (None, 0)
    assert clean["none", 0] == ("Share this page 1", 0)
    assert len(clean) == 14


def test_site_lines_of_nothing(spark):
    p, idx = spark.createDataFrame([], PASSAGES), index(spark, [])
    assert site_lines.found(p, idx).count() == 0
    assert site_lines.cleaned(p, idx).count() == 0


# problem 5


def brute_degrees(rows):
    """{(doc, term): distinct neighbours}; ``rows`` of (doc, term, positions)."""
    at = defaultdict(lambda: defaultdict(set))
    for d, t, ps in rows:
        for i in ps:
            at[d][i].add(t)
    out = {}
    for d, t, ps in rows:
        near = set()
        for i in ps:
            for j in range(i - distinctive.WINDOW, i + distinctive.WINDOW + 1):
                near |= at[d][j]
        out[d, t] = len(near - {t})
    return out


@pytest.fixture
def posted():
    rng = random.Random(9)
    rows = {}
    for d in range(6):
        n = 9000 if d == 0 else 60  # one page spans several blocks
        for i in range(n):
            rows.setdefault((f"d{d}", f"t{min(rng.randrange(40), rng.randrange(40))}"), []).append(i)
    return [(d, t, sorted(ps)) for (d, t), ps in rows.items()]


def test_degrees_and_scores(spark, posted):
    df = spark.createDataFrame([(t, d, None if len(ps) % 3 == 0 else len(ps), [{"i": i, "ptype": "b"} for i in ps], 0) for d, t, ps in posted] * 2, "term string, doc_id string, tf int, positions array<struct<i:int,ptype:string>>, degree int")
    counts = {"d1": 50, "d2": 0, "d3": None}
    idx = index(spark, [(d, f"https://{d}.example", c) for d, c in counts.items()])
    got = {(r["doc_id"], r["term"]): r for r in distinctive.distinctiveness(df, idx).collect()}
    want = brute_degrees(posted)
    assert {k: r["degree"] for k, r in got.items()} == want
    n, freq = 6, Counter(t for _, t, _ in posted)
    total = Counter()
    for d, t, ps in posted:
        total[d] += len(ps)
    found = set()
    for d, t, ps in posted:
        c = counts.get(d) or total[d]
        rare = math.log(n / (freq[t] + 1)) / math.log(n)
        assert got[d, t]["tf_score"] == pytest.approx(len(ps) / c * rare)
        assert got[d, t]["graph_score"] == pytest.approx(want[d, t] / c * rare)
        if len(ps) / c * rare >= 0.02:
            found.add((d, t))
    assert {(r["doc_id"], r["term"]) for r in distinctive.found(df, idx).collect()} == found


def test_distinctiveness_edges(spark):
    schema = "term string, doc_id string, tf int, positions array<struct<i:int,ptype:string>>"
    idx = index(spark, [])
    assert distinctive.distinctiveness(spark.createDataFrame([], schema), idx).count() == 0
    one = distinctive.distinctiveness(spark.createDataFrame([("a", "d", 2, None), (None, "d", 1, None), ("a", None, 1, None)], schema), idx).collect()
    assert [(r["term"], r["degree"], r["tf_score"]) for r in one] == [("a", 0, None)]


def test_normal_line_matches_python(spark):
    from pyspark.sql import functions as F

    lines = ["  A b  12x 3 ", "Ｘ　٣٤", "", "\t", "ÀÉ 7-7"]
    got = [r["n"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, l string").orderBy("i").select(site_lines.normal_line(F.col("l")).alias("n")).collect()]
    assert got == [re.sub(r"\s+", "", re.sub(r"\d+", "0", x.lower())) for x in lines]
