"""Problem 5: how distinctive a term is per record.

Graph-of-words weighting: the positions of a page's terms give a co-occurrence graph, an edge joining terms that stand
within a window; a term's degree, its number of distinct neighbours, replaces its frequency and is multiplied by the rarity
of the term in the collection. The frequency score is kept beside it, as thresholds are stated on it.

A page's positions are cut into blocks of bounded length, each with the window's margin, so that no group grows with a page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.sources.tables import latest_documents

#: positions to either side within which terms are neighbours
WINDOW = 2
BLOCK = 4096
MIN_SCORE = 0.02


def blocks(postings: DataFrame) -> DataFrame:
    """``doc_id, block, items``: the postings of each page cut into blocks of positions, each with the window's margin.

    An item is ``term, tf, at, first, homes``: the positions within the block and its margin, whether the term is counted
    in this block, and in how many blocks it has positions. A null tf is the number of positions; terms without positions
    stand in block 0. Null terms and pages are dropped. The one shuffle of the postings; no group grows with a page.
    """
    at = F.coalesce(F.transform("positions", lambda p: p["i"].cast("int")), F.expr("cast(array() as array<int>)"))
    rows = postings.filter(F.col("term").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), "term", F.col("tf").cast("int").alias("tf"), F.filter(at, lambda i: i.isNotNull()).alias("at"))
    of = lambda shift: F.transform("at", lambda i: F.floor((i + shift) / BLOCK).cast("int"))
    rows = rows.withColumn("tf", F.coalesce("tf", F.size("at"))).withColumn("home", F.array_distinct(of(0)))
    single = (F.size("at") > 0) & (F.array_max("at") < BLOCK - WINDOW)
    every = F.when((F.size("at") == 0) | single, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(of(-WINDOW), F.col("home"), of(WINDOW))))
    cut = rows.select("doc_id", "term", "tf", "at", "home", F.explode(every).alias("block")).filter("block >= 0")
    low, high = F.col("block") * BLOCK - WINDOW, (F.col("block") + 1) * BLOCK + WINDOW
    own = F.when(F.size("at") <= 1, F.col("at")).otherwise(F.filter("at", lambda i: (i >= low) & (i < high)))
    first = F.col("block") == F.coalesce(F.array_min("home"), F.lit(0))
    item = F.struct("term", "tf", own.alias("at"), first.alias("first"), F.size("home").alias("homes"))
    return cut.select("doc_id", "block", item.alias("item")).groupBy("doc_id", "block").agg(F.collect_list("item").alias("items"))


def _neighbours(block: int, items: list[dict]) -> Iterator[tuple[dict, set[str] | None]]:
    """Each term of a block once, with its distinct neighbours, or None if it has no position of its own in the block."""
    once: dict[str, dict] = {}
    for x in items:
        y = once.get(x["term"])
        if y is None or (x["tf"], x["at"]) > (y["tf"], y["at"]):
            once[x["term"]] = x
    here: dict[int, list[str]] = {}
    for t, x in once.items():
        for i in x["at"]:
            here.setdefault(i, []).append(t)
    low, high = block * BLOCK, (block + 1) * BLOCK
    for t, x in once.items():
        near: set[str] = set()
        home = False
        for i in x["at"]:
            if low <= i < high:
                home = True
                for j in range(i - WINDOW, i + WINDOW + 1):
                    near.update(here.get(j, ()))
        near.discard(t)
        yield x, near if home else None


SCHEMA = "doc_id string, term string, tf int, degree int, near array<long>, first boolean"
TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.bool_()]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for b in batches:
        docs, block, items = (b.column(k) for k in range(3))
        for i in range(b.num_rows):
            doc = docs[i].as_py()
            rows = []
            for x, near in _neighbours(block[i].as_py(), items[i].as_py()):
                if near is not None or x["first"]:
                    hashes = [xxhash.xxh64_intdigest(t) - (1 << 63) for t in near] if x["homes"] > 1 and near is not None else None
                    rows.append((doc, x["term"], x["tf"], len(near or ()), hashes, x["first"]))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=names)


def _degrees(docs: pa.Array, block: np.ndarray, items: pa.ListArray) -> pa.RecordBatch:
    """The rows of blocks whose terms all stand in one block, by sorting numbers instead of building the graph in dictionaries:
    the pairs of terms at most WINDOW apart, each once, are the edges."""
    flat = items.flatten()
    row = np.repeat(np.arange(len(items)), np.asarray(items.value_lengths()))
    field = {flat.type[i].name: flat.field(i) for i in range(flat.type.num_fields)}
    coded = field["term"].dictionary_encode()
    term, n_terms = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    tf, first, lists = field["tf"].to_numpy(), field["first"].to_numpy(zero_copy_only=False), field["at"]
    sizes, at = np.asarray(lists.value_lengths()), lists.flatten().to_numpy().astype(np.int64)
    # a term once in each block; of repeated rows the greatest (tf, positions)
    own = np.lexsort((tf, term, row))
    again = np.r_[False, (row[own][1:] == row[own][:-1]) & (term[own][1:] == term[own][:-1])]
    live = np.ones(len(row), bool)
    best: dict[tuple[int, int], int] = {}
    for i in own[again | np.r_[again[1:], False]] if len(own) else ():
        k = (int(row[i]), int(term[i]))
        j = best.get(k)
        if j is not None:
            worse = j if (tf[i], lists[int(i)].as_py()) > (tf[j], lists[int(j)].as_py()) else int(i)
            live[worse] = False
        if j is None or live[i]:
            best[k] = int(i)
    item = np.repeat(np.arange(len(row)), sizes)
    kept = live[item]
    item, at = item[kept], at[kept]
    order = np.lexsort((at, row[item]))
    item, at = item[order], at[order]
    low = block[row[item]].astype(np.int64) * BLOCK
    home = (at >= low) & (at < low + BLOCK)
    span = BLOCK + 4 * WINDOW + 1
    place = row[item] * span + at - low + WINDOW
    edges = []
    for d in range(WINDOW + 1):
        lo, hi = np.searchsorted(place, place + d, "left"), np.searchsorted(place, place + d, "right")
        a = np.repeat(np.arange(len(place)), hi - lo)
        b = np.arange(len(a)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        for x, y in ((a, b), (b, a)) if d else ((a, b),):
            differ = home[x] & (term[item[x]] != term[item[y]])
            edges.append(item[x[differ]] * n_terms + term[item[y[differ]]])
    degree = np.bincount(np.unique(np.concatenate(edges)) // n_terms, minlength=len(row)) if len(place) else np.zeros(len(row), int)
    out = np.flatnonzero(live & (first | (np.bincount(item[home], minlength=len(row)) > 0)))
    return pa.record_batch([docs.take(pa.array(row[out])), coded.dictionary.take(pa.array(term[out])), pa.array(tf[out], pa.int32()), pa.array(degree[out], pa.int32())], names=["doc_id", "term", "tf", "degree"])


def _run_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            yield _degrees(part.column(0), part.column(1).to_numpy(), part.column(2))


def weighted(parts: DataFrame) -> DataFrame:
    """``doc_id, term, tf, degree``: of a term in one block the degree is final; only those in several are put together."""
    several = F.exists("items", lambda x: x["homes"] > 1)
    whole = parts.filter(~several).mapInArrow(_run_whole, "doc_id string, term string, tf int, degree int")
    cut = parts.filter(several).mapInArrow(_run, SCHEMA).groupBy("doc_id", "term").agg(F.max("tf").alias("tf"), F.max("degree").alias("d"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    return whole.unionByName(cut.select("doc_id", "term", "tf", F.greatest("d", F.size("near")).alias("degree")))


def _terms(items: str) -> Column:
    """{term: tf} of the terms counted in a block; of repeated rows the greatest tf."""
    kept = F.transform(F.filter(items, lambda x: x["first"]), lambda x: F.struct(x["term"].alias("k"), x["tf"].alias("v")))
    last = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["k"] != x["k"], F.lit(True)))
    return F.map_from_entries(F.get(F.transform(F.array(F.array_sort(kept)), last), 0))  # sorted once


def distinctiveness(postings: DataFrame, index: DataFrame, least: float | None = None) -> DataFrame:
    """``doc_id, term, tf, degree, df, tokens, rarity, tf_score, graph_score`` of every (page, term).

    ``tokens`` is the page's token_count (latest fetch) or, if null or below 1, the sum of its tf; ``rarity`` is
    ln(N / (df + 1)) / ln N with N the number of pages; a score is weight / tokens times rarity. With fewer than two pages
    rarity is null, and so are the scores. Terms without positions have degree 0. Of repeated rows of a (term, page) the
    greatest (tf, positions) holds. Empty tables give no rows; extra columns are ignored; ties need no order, as no row
    depends on another's rank. With ``least`` only rows whose tf / tokens reaches it go on to the join with the terms'
    rarity, which is under 1: no row whose frequency score reaches ``least`` is lost.
    """
    parts = blocks(postings)
    once = F.aggregate(F.map_values(_terms("items")), F.lit(0).cast("long"), lambda a, x: a + x)
    pages = parts.select("doc_id", once.alias("n")).groupBy("doc_id").agg(F.sum("n").alias("total"))
    n = pages.agg(F.count("*").cast("double").alias("n"))
    count = latest_documents(index).select(F.col("doc_id").cast("string").alias("doc_id"), "token_count")
    tokens = pages.join(count, "doc_id", "left").select("doc_id", F.when(F.col("token_count") >= 1, F.col("token_count")).otherwise(F.col("total")).cast("double").alias("tokens"))
    df = parts.select(F.explode(F.map_keys(_terms("items"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    rows = weighted(parts).join(tokens, "doc_id")
    if least is not None:
        rows = rows.filter(F.when(F.col("tokens") > 0, F.col("tf") / F.col("tokens")) >= least)
    rarity = F.log(F.col("n") / (F.col("df") + 1)) / F.when(F.col("n") >= 2, F.log("n"))
    share = lambda w: F.when(F.col("tokens") > 0, F.col(w) / F.col("tokens")) * F.col("rarity")
    return (
        rows.join(df, "term")
        .crossJoin(F.broadcast(n))  # one row
        .withColumn("rarity", rarity)
        .select("doc_id", "term", "tf", "degree", "df", "tokens", "rarity", share("tf").alias("tf_score"), share("degree").alias("graph_score"))
    )


def found(postings: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of the weighted graph whose frequency score reaches the threshold. The threshold is stated on the frequency alone: the
    degree takes no part in this decision, it ranks terms by ``graph_score``."""
    return distinctiveness(postings, index, MIN_SCORE).filter(F.col("tf_score") >= MIN_SCORE).select("doc_id", "term")
