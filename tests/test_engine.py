import json
from datetime import datetime

import pytest

from spindrift.plans.config import Config
from spindrift.plans.engine import Engine, EngineError
from spindrift.plans.store import IndexStore
from spindrift.streaming import ingest

PAGES = [
    ("https://a.example/harbour", [("Harbour lights", "h"), ("The old harbour keeps its lights and the ferry waits", "b")]),
    ("https://a.example/ferry", [("Ferry times", "h"), ("The ferry leaves the harbour every morning and returns by night", "b")]),
    ("https://b.example/bread", [("Bread", "h"), ("Slow bread needs patient bakers and warm ovens", "b")]),
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("index")
    config = Config(["https://a.example/"], "cache", "filter", str(folder / "store"))
    e = Engine(spark, config)
    at = datetime(2025, 1, 1)
    df = spark.createDataFrame([(u, at, [{"text": t, "type": k} for t, k in p]) for u, p in PAGES], ingest.PAGE_SCHEMA)
    df.write.parquet(str(folder / "pages"))
    for _ in range(2):  # a second run over the same files adds nothing
        q = ingest.start(spark, str(folder / "pages"), e.store, str(folder / "checkpoint"))
        q.awaitTermination()
    return e


def test_stream_indexes_each_page_once(engine):
    assert engine.crawl_state()["documents"] == 3
    ingest.index_batch(engine.store, engine.spark.createDataFrame([(PAGES[0][0], datetime(2025, 1, 1), [], "a.example/harbour")], ingest.PAGE_SCHEMA + ", norm_url string"), "again")
    assert engine.crawl_state()["documents"] == 3


def batch_of(spark, rows):
    df = spark.createDataFrame([(u, datetime(2025, 1, 1), [{"text": t, "type": "b"} for t in p], u.removeprefix("https://")) for u, p in rows], ingest.PAGE_SCHEMA + ", norm_url string")
    return df


def test_a_batch_that_died_is_run_again(spark, tmp_path, monkeypatch):
    store = IndexStore(spark, str(tmp_path))
    first, second = [("https://a.example/1", ["The ferry leaves the harbour at night and returns"])], [("https://a.example/2", ["Slow bread needs patient bakers and warm ovens"])]
    ingest.index_batch(store, batch_of(spark, first), "b-0")
    write = IndexStore.write

    def dies(self, name, *rest):
        if name == "corpus_stats":
            raise OSError("lost")
        write(self, name, *rest)

    monkeypatch.setattr(IndexStore, "write", dies)
    with pytest.raises(OSError):
        ingest.index_batch(store, batch_of(spark, second), "b-1")
    assert store.documents().count() == 1 and store.corpus_stats().first()["documents"] == 1
    monkeypatch.setattr(IndexStore, "write", write)
    for _ in range(2):
        ingest.index_batch(store, batch_of(spark, second), "b-1")
    assert store.documents().count() == 2 and store.corpus_stats().first()["documents"] == 2
    assert [(r["tf"], len(r["positions"])) for r in store.postings_of(["bread"]).collect()] == [(1, 1)]
    assert {r["freq"] for r in store.bigrams().collect()} == {1}
    assert store.read("vocabulary").groupBy("word").count().filter("count > 1").count() == 0


def test_near_duplicates_are_not_ingested(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path))
    text = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(200))
    ingest.index_batch(store, batch_of(spark, [("https://a.example/1", [text])]), "b-0")
    ingest.index_batch(store, batch_of(spark, [("https://a.example/copy", [text]), ("https://a.example/close", [text + " end"]), ("https://a.example/new", ["Slow bread needs patient bakers and warm ovens"])]), "b-1")
    assert {r["url"] for r in store.documents().collect()} == {"https://a.example/1", "https://a.example/new"}


def test_search(engine):
    result, times = engine.search("harbour ferry", "x")
    rows = result.orderBy("rank").collect()
    assert {r["url"] for r in rows} == {PAGES[0][0], PAGES[1][0]}
    assert all(r["has_header"] and r["url_match"] > 0 for r in rows)
    assert times["total"] >= times["handle_query"] + times["fetch_and_process"] + times["sort"] - 1e-6
    assert times["total_results"] == len(rows)
    assert engine.store.corpus_stats().first()["documents"] == 3


def test_misspelt_word_is_corrected(engine):
    assert engine.slots("harbuor")[0] == ["harbour"]
    assert engine.slots("ferryharbour")[0] == engine.slots("ferry")[0]


def test_empty_queries(engine):
    assert engine.search("the of")[0] is None
    with pytest.raises(EngineError) as e:
        engine.search("")
    assert e.value.status == 400


def test_crawl_control(spark, tmp_path):
    e = Engine(spark, Config(["https://a.example/"], "c", "f", str(tmp_path)))
    with pytest.raises(EngineError):
        e.crawl_stop()
    with pytest.raises(EngineError):
        e.crawl_add(["https://x.example/"])
    assert e.crawl_start() == 201
    with pytest.raises(EngineError):
        e.crawl_start()
    assert e.crawl_add(["https://x.example/"]) == 202
    with pytest.raises(EngineError):
        e.crawl_add([])
    assert e.crawl_state()["running"] and e.crawl_state()["documents"] == 0
    assert e.crawl_stop() == 200


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"base_urls": ["u"], "cache_path": "c", "filter_url": "f", "index_path": "i", "worker_count": 48, "other": 1}))
    c = Config.load(str(path))
    with pytest.raises(ValueError, match="worker_count"):
        c.validate()
    c.worker_count = 50
    assert c.validate() is c
    with pytest.raises(ValueError):
        Config().validate()
