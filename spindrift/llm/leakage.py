"""Problem 9: evaluation texts leaking into training text.

Rare word n-grams of the test items are the seeds that join documents to items; where three or more hit, a Smith-Waterman
alignment of the item with the document's words about the hits is scored. What scores enough has leaked, whole or in part, also with words
put in, left out or replaced. Which of these are cases by the stated rule, words in order and single ones replaced, an exact check
of the diagonals tells.

Seeds of four words find every case: without a run of four, m replaced words leave at most 3 (m + 1) others, so a stretch of
L words has L <= 4 m + 3, which with m <= L / 6 holds only up to 7 words, and a stretch has 15. Of its L - 3 runs of four each
replaced word takes at most 4, so at least L - 3 - 4 m >= 3 seeds of a stretch hit on one diagonal. Seeds that stand in many
items (phrases of the instructions) are common; a hit of one only counts if the words about it, on the same diagonal, hold a
qualifying stretch, so that common seeds lose no case and cost little.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
SEED = 4
MIN_WORDS = 15
#: one word in so many may be replaced
ONE_IN = 6
#: a seed that stands in more items than this is common
RARE = 3
#: seeds of a stretch that hit on one diagonal at least
DIAGONAL_SEEDS = 3
#: a test set of up to so many characters is sent to the executors, as some 40 MB of seeds; a larger one is joined by shuffle
BROADCAST_CHARS = 1_000_000
MATCH, MISMATCH, GAP = 1, -1, -2
#: a stretch of L >= 15 words with m <= L / 6 replaced scores L - 2 m >= 11; an alignment with gaps has leaked from the same score
MIN_SCORE = 11


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return WORD.findall((text or "").lower())


def stretch(match: np.ndarray) -> int:
    """Length of the longest stretch that begins and ends with equal words, in which at most one word in six differs and no
    two differing words are neighbours; 0 if it is under 15 words."""
    n, best = len(match), 0
    if n < MIN_WORDS:
        return 0
    cost = np.r_[0, np.cumsum(np.where(match, 1, 1 - ONE_IN))]
    twice = np.r_[0, np.flatnonzero(~match[1:] & ~match[:-1]) + 1, n]
    for a, b in zip(twice[:-1], twice[1:], strict=True):  # no stretch passes two neighbouring differences
        for i in range(a, b - MIN_WORDS + 1):
            if match[i]:
                ends = np.flatnonzero(match[i + MIN_WORDS - 1 : b] & (cost[i + MIN_WORDS : b + 1] >= cost[i]))
                if len(ends):
                    best = max(best, MIN_WORDS + int(ends[-1]))
    return best


def smith_waterman(a: np.ndarray, b: np.ndarray) -> int:
    """Best local alignment score of two arrays of word ids; a row at a time, gaps along the row by a running maximum."""
    ramp = np.arange(len(b) + 1) * -GAP
    row, best = np.zeros(len(b) + 1, np.int64), 0
    for x in a:
        new = np.zeros_like(row)
        new[1:] = np.maximum(0, np.maximum(row[:-1] + np.where(b == x, MATCH, MISMATCH), row[1:] + GAP))
        row = np.maximum.accumulate(new + ramp) - ramp
        best = max(best, int(row.max()))
    return best


class Items:
    """Test items with their seeds. Items under 15 words, null and empty ones have none."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids: dict[str, int] = {}
        self.words: dict[int, np.ndarray] = {}
        seeds: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for item, text in rows:
            w = words(text)
            if item is None or len(w) < MIN_WORDS or item in self.words:
                continue
            self.words[item] = np.array([self.ids.setdefault(x, len(self.ids)) for x in w])
            for i in range(len(w) - SEED + 1):
                seeds[tuple(w[i : i + SEED])].append((item, i))
        self.seeds = dict(seeds)
        self.common = {s for s, at in seeds.items() if len({i for i, _ in at}) > RARE}
        self.first = {s[0] for s in seeds}

    def hits(self, w: list[str]) -> dict[tuple[int, int], tuple[bool, int]]:
        """{(item, diagonal): (whether a rare seed hit it, how many seeds did)}."""
        out: dict[tuple[int, int], tuple[bool, int]] = {}
        for i in range(len(w) - SEED + 1):
            if w[i] in self.first and (at := self.seeds.get(seed := tuple(w[i : i + SEED]))):
                rare = seed not in self.common
                for item, p in at:
                    before = out.get((item, i - p), (False, 0))
                    out[item, i - p] = (rare or before[0], before[1] + 1)
        return out

    def leaked(self, text: str | None) -> dict[int, tuple[int, int]]:
        """{item: (alignment score, length of the longest stretch by the stated rule, 0 for none)} of the items that the text
        contains."""
        w = words(text)
        hits = self.hits(w)
        out: dict[int, tuple[int, int]] = {}
        if not hits:
            return out
        ids = np.array([self.ids.get(x, -1) for x in w])
        by_item: dict[int, list[tuple[int, bool, int]]] = defaultdict(list)
        for (item, offset), (rare, n) in hits.items():
            by_item[item].append((offset, rare, n))
        for item, own in by_item.items():
            q, length = self.words[item], 0
            for offset, _, n in own:
                if n >= DIAGONAL_SEEDS:
                    lo, hi = max(0, offset), min(len(ids), offset + len(q))
                    length = max(length, stretch(ids[lo:hi] == q[lo - offset : hi - offset]))
            if length or (sum(n for *_, n in own) >= DIAGONAL_SEEDS and any(rare for _, rare, _ in own)):
                score = self.score(q, ids, sorted(offset for offset, *_ in own))
                if score >= MIN_SCORE:
                    out[item] = (score, length)
        return out

    @staticmethod
    def score(q: np.ndarray, ids: np.ndarray, offsets: list[int]) -> int:
        """The best alignment of an item with the words about its hits; windows that overlap are one. A window that holds fewer of
        the item's words than MIN_SCORE cannot score it."""
        windows: list[list[int]] = []
        for offset in offsets:
            lo, hi = max(0, offset - MIN_WORDS), min(len(ids), offset + len(q) + MIN_WORDS)
            if windows and lo <= windows[-1][1]:
                windows[-1][1] = max(windows[-1][1], hi)
            else:
                windows.append([lo, hi])
        parts = [ids[lo:hi] for lo, hi in windows]
        return max((smith_waterman(q, part) for part in parts if np.isin(q, part).sum() >= MIN_SCORE), default=0)


SCHEMA = "doc_id long, item_id long, score int, n_words int"


def _rows(ids: list[int], found: list[dict[int, tuple[int, int]]]) -> pa.RecordBatch:
    flat = [(d, i, s, n) for d, f in zip(ids, found, strict=True) for i, (s, n) in f.items()]
    c = list(zip(*flat, strict=True)) or [[], [], [], []]
    return pa.record_batch([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32())], names=["doc_id", "item_id", "score", "n_words"])


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, score, n_words``: the items each document contains wholly or in part, by their alignment's score;
    ``n_words`` is the longest stretch that meets the stated rule, 0 where the copy was edited more.

    One row per pair. Null and empty texts on either side give no rows; repeated ``item_id`` keep the first in order of text;
    of repeated document rows each is searched and the result is distinct. A test set over ``BROADCAST_CHARS`` is joined by
    shuffled seeds instead, with the same result.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).filter(F.length("text") > 0)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter(F.length("text") > 0).groupBy("item_id").agg(F.min("text").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    if size > BROADCAST_CHARS:
        return by_shuffle(docs, items).distinct()
    held = docs.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in items.orderBy("item_id").collect()]))  # of BROADCAST_CHARS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows(b.column(0).to_pylist(), [held.value.leaked(t.as_py()) for t in b.column(1)])

    return docs.mapInArrow(run, SCHEMA).distinct()


def _seeds(df: DataFrame, key: str, at: str) -> DataFrame:
    """Seeds of each text as hashes with their places, made in the JVM."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    places = F.when(F.size("w") >= SEED, F.sequence(F.lit(1), F.size("w") - (SEED - 1))).otherwise(F.array().cast("array<int>"))
    grams = F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice(F.col("w"), i, SEED), " ")))
    return df.select(key, w.alias("w")).select(key, F.posexplode(grams).alias(at, "seed"))


def by_shuffle(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same rows for a test set of any size: seeds of items and documents meet in a shuffle, which is counted by diagonal
    before any text is joined. A pair goes on with a rare seed, or with DIAGONAL_SEEDS on one diagonal, which each case has; AQE
    splits a seed that many documents hold."""
    items = items.filter(F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))) >= MIN_WORDS)
    own = _seeds(items, "item_id", "p")
    rare = own.groupBy("seed").agg((F.count_distinct("item_id") <= RARE).alias("rare"))
    met = _seeds(docs, "doc_id", "i").join(own.join(rare, "seed"), "seed")
    diagonals = met.groupBy("doc_id", "item_id", (F.col("i") - F.col("p")).alias("d")).agg(F.count("*").alias("n"), F.max("rare").alias("rare"))
    pairs = diagonals.filter(F.col("rare") | (F.col("n") >= DIAGONAL_SEEDS)).groupBy("doc_id", "item_id").agg(F.max("rare").alias("rare"))
    both = pairs.join(items.withColumnRenamed("text", "item"), "item_id").join(docs, "doc_id").select("doc_id", "item_id", "item", "text", "rare")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, i, q, t, rare = (b.column(k).to_pylist() for k in range(5))
            found = [Items([(i[k], q[k])]).leaked(t[k]) for k in range(len(d))]
            # a pair without a rare seed counts by its stretch alone
            yield _rows(d, [f if rare[k] else {x: v for x, v in f.items() if v[1]} for k, f in enumerate(found)])

    return both.mapInArrow(run, SCHEMA)


def found(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The leaks that meet the stated rule, told by a stretch of MIN_WORDS."""
    return leaks(documents, benchmark).filter(F.col("n_words") >= MIN_WORDS).select("doc_id", "item_id").distinct()
