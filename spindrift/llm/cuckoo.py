"""Problem 7: has this key been seen before?

Fingerprints of the keys stand in cuckoo tables, one set of tables per partition of the key space: a key has two candidate
buckets of four slots, the second found from the first and the fingerprint alone, so that entries can be moved and deleted.
A table that saturates is followed by one of twice its size. A filter answers "new" rightly always, and "seen" wrongly at a
rate that the audit reports, with the tables' load; the exact check that follows settles the positives by sorting, not by keeping
keys in memory. Filters can also be kept as a table between runs, where keys are added, deleted and asked for (:func:`changed`,
:func:`maybe_seen`).
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.urls import with_normal_url
from spindrift.sources.tables import shuffle_partitions

SLOTS = 4
NEW, MAYBE, SEEN = 0, 1, 2
#: state of a row that tells of a partition's tables: entries, slots and bytes as ``h1``, ``h2`` and ``k``
TABLES = 3
#: rows of a block that is deduplicated before the shuffle; bounds the memory of a task
BLOCK = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class CuckooTable:
    """One table of ``buckets`` x 4 fingerprints of 16 bits; 0 marks a free slot. All operations work on arrays of hashes."""

    MAX_ROUNDS = 120

    def __init__(self, buckets: int):
        self.mask = np.uint64(buckets - 1)
        self.slots = np.zeros((buckets, SLOTS), np.uint16)
        self.used = 0

    @staticmethod
    def fingerprint(h: np.ndarray) -> np.ndarray:
        fp = (h >> np.uint64(48)).astype(np.uint16)
        return np.where(fp == 0, np.uint16(1), fp)

    def first(self, h: np.ndarray) -> np.ndarray:
        return (h & self.mask).astype(np.int64)

    def other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return bucket ^ (_mix(fp.astype(np.uint64)) & self.mask).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        fp, a = self.fingerprint(h), self.first(h)
        return (self.slots[a] == fp[:, None]).any(1) | (self.slots[self.other(a, fp)] == fp[:, None]).any(1)

    def _one_each(self, bucket: np.ndarray) -> np.ndarray:
        """Indices of one entry per bucket, so that a round never writes a slot twice."""
        return np.unique(bucket, return_index=True)[1]

    def insert(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inserts and returns (bucket, fingerprint) of the entries left over when the table is saturated."""
        fp, bucket = self.fingerprint(h), self.first(h)
        tries = np.zeros(len(h), np.int64)
        for step in range(self.MAX_ROUNDS):
            if not len(fp):
                break
            pick = self._one_each(bucket)
            b, f = bucket[pick], fp[pick]
            free = self.slots[b] == 0
            fits = free.any(1)
            self.slots[b[fits], free[fits].argmax(1)] = f[fits]
            self.used += int(fits.sum())
            full = pick[~fits]
            first_try = full[tries[full] == 0]
            bucket[first_try], tries[first_try] = self.other(bucket[first_try], fp[first_try]), 1
            kick = np.setdiff1d(full, first_try, assume_unique=True)
            if len(kick):
                at = (fp[kick].astype(np.int64) + step) % SLOTS
                out = self.slots[bucket[kick], at].copy()
                self.slots[bucket[kick], at] = fp[kick]
                fp[kick], bucket[kick] = out, self.other(bucket[kick], out)
            keep = np.ones(len(fp), bool)
            keep[pick[fits]] = False
            fp, bucket, tries = fp[keep], bucket[keep], tries[keep]
        return bucket, fp

    def delete(self, h: np.ndarray) -> np.ndarray:
        """Removes one copy of each hash; true where one was found."""
        fp, a = self.fingerprint(h), self.first(h)
        found, left = np.zeros(len(h), bool), np.arange(len(h))
        for side in (a, self.other(a, fp)):
            todo = left[~found[left]]
            while len(todo):
                pick = todo[self._one_each(side[todo])]
                hit = self.slots[side[pick]] == fp[pick][:, None]
                there = hit.any(1)
                self.slots[side[pick[there]], hit[there].argmax(1)] = 0
                found[pick[there]] = True
                todo = np.setdiff1d(todo, pick, assume_unique=True)
        self.used -= int(found.sum())
        return found


class CuckooFilter:
    """Cuckoo tables that grow: a saturated table stays and one of twice its size takes what follows. The few entries that found no
    slot before a table was closed are kept beside it, each as often as it was added."""

    LOAD = 0.92

    def __init__(self, capacity: int = 1 << 12):
        self.tables = [CuckooTable(self._buckets(capacity))]
        self.overflow = np.zeros((0, 3), np.int64)  # (table, bucket, fingerprint)

    @staticmethod
    def _buckets(capacity: int) -> int:
        return 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * CuckooFilter.LOAD)))))

    @property
    def bytes(self) -> int:
        return sum(t.slots.nbytes for t in self.tables) + self.overflow.nbytes

    @property
    def slots(self) -> int:
        return sum(t.slots.size for t in self.tables)

    def __len__(self) -> int:
        return sum(t.used for t in self.tables) + len(self.overflow)

    def _outside(self, h: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Which hashes an entry of the overflow may stand for."""
        t = self.tables[entry[0]]
        f, a = t.fingerprint(h), t.first(h)
        return (f == entry[2]) & ((a == entry[1]) | (t.other(a, f) == entry[1]))

    def contains(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        for t in self.tables:
            out |= t.contains(h)
        for entry in self.overflow:
            out |= self._outside(h, entry)
        return out

    def insert(self, h: np.ndarray) -> None:
        """Adds hashes, of which those already added are added once more (a deletion takes one away)."""
        while len(h):
            t = self.tables[-1]
            room = max(0, int(t.slots.size * self.LOAD) - t.used)
            part, h = h[:room], h[room:]
            bucket, fp = t.insert(part)
            self.overflow = np.concatenate([self.overflow, np.column_stack([np.full(len(fp), len(self.tables) - 1), bucket, fp.astype(np.int64)])])
            if len(h):
                self.tables.append(CuckooTable(2 * len(t.slots)))

    def delete(self, h: np.ndarray) -> np.ndarray:
        """Removes one copy of each hash; true where one was found. Only keys that were added may be deleted."""
        found = np.zeros(len(h), bool)
        for t in self.tables:
            rest = np.flatnonzero(~found)
            found[rest] = t.delete(h[rest])
        gone = []
        for k, entry in enumerate(self.overflow):
            rest = np.flatnonzero(~found)
            hit = rest[self._outside(h[rest], entry)]
            if len(hit):
                found[hit[0]] = True
                gone.append(k)
        self.overflow = np.delete(self.overflow, gone, axis=0)
        return found

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, overflow=self.overflow, **{f"t{k}": t.slots for k, t in enumerate(self.tables)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        held = np.load(io.BytesIO(data))
        out = cls.__new__(cls)
        out.overflow, out.tables = held["overflow"], []
        for k in range(len(held.files) - 1):
            t = CuckooTable(len(held[f"t{k}"]))
            t.slots = held[f"t{k}"].copy()
            t.used = int(np.count_nonzero(t.slots))
            out.tables.append(t)
        return out


SCHEMA = pa.schema([("k", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("seq", pa.int64()), ("state", pa.int8())])
DDL = "k long, h1 long, h2 long, seq long, state byte"


def _batch(k: np.ndarray, h1: np.ndarray, h2: np.ndarray, seq: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(k), pa.array(h1), pa.array(h2), pa.array(seq), pa.array(state.astype(np.int8))], schema=SCHEMA)


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _blocks(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], size: int) -> Iterator[list[np.ndarray]]:
    held: list[list[np.ndarray]] = []
    rows = 0
    for b in batches:
        held.append(_columns(b, *names))
        rows += b.num_rows
        if rows >= size:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, rows = [], 0
    if rows:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _local_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: in each block all but the first arrival of a key are known to be repeats. They are sent on spread
    over all partitions, so a hot key brings each partition at most one row of every block."""
    for h1, h2, seq, ok in _blocks(batches, ("h1", "h2", "seq", "ok"), BLOCK):
        h1, h2, seq = h1[ok], h2[ok], seq[ok]
        order = np.lexsort((seq, h2, h1))
        h1, h2, seq = h1[order], h2[order], seq[order]
        repeat = np.r_[False, (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])]
        keep = (seq >= 0) | ~repeat
        h1, h2, seq, repeat = h1[keep], h2[keep], seq[keep], repeat[keep]
        spread = _mix(seq.view(np.uint64)).view(np.int64)
        yield _batch(np.where(repeat, spread, h1), h1 * ~repeat, h2 * ~repeat, seq, np.where(repeat, SEEN, NEW))


def _filter_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrivals of one partition in their order against its cuckoo filter."""
    seen = CuckooFilter()
    for b in batches:
        k, h1, h2, seq, state = _columns(b, "k", "h1", "h2", "seq", "state")
        state = state.copy()
        todo = np.flatnonzero(state != SEEN)
        h = _mix(h1[todo].view(np.uint64) ^ (h2[todo].view(np.uint64) << np.uint64(1)))
        distinct, at = np.unique(h, return_index=True)
        old = seen.contains(distinct)
        answer = np.full(len(todo), MAYBE)
        answer[at[~old]] = NEW
        state[todo] = answer
        seen.insert(distinct[~old])
        yield _batch(k, h1, h2, seq, state)
    one = lambda x: np.array([x], np.int64)
    yield _batch(one(seen.bytes), one(len(seen)), one(seen.slots), one(-1), one(TABLES))


def _exact_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and arrival: a positive answer is right if the row before has the same key. Keeps one row."""
    last = (0, 0, False)
    for b in batches:
        k, h1, h2, seq, state = _columns(b, "k", "h1", "h2", "seq", "state")
        if not len(k):
            continue
        live = state < SEEN
        same = np.r_[(last[2] and live[0] and h1[0] == last[0] and h2[0] == last[1]), (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1]) & live[1:] & live[:-1]].astype(bool)
        last = (h1[-1], h2[-1], bool(live[-1]))
        verdict = np.where(~live, state, np.where((state == MAYBE) & same, SEEN, np.where(state == MAYBE, MAYBE, NEW)))
        yield _batch(k, h1, h2, seq, verdict)


def _keys(df: DataFrame, key: str, seq) -> DataFrame:
    """Two independent 64-bit hashes of each key: 128 bits identify a key. ``ok`` marks those that are not null; they are
    dropped later, as a filter on a computed key would be pushed down and work the key out a second time."""
    return df.select(F.xxhash64(F.col(key)).alias("h1"), F.xxhash64(F.lit("second"), F.col(key), F.length(key)).alias("h2"), seq.cast("long").alias("seq"), F.col(key).isNotNull().alias("ok"))


def _answers(arrivals: DataFrame, key: str, order: str, known: DataFrame | None = None) -> DataFrame:
    """The rows of :func:`seen_keys` as ``DDL`` has them, those of ``known`` (``seq`` -1) and one of each partition's tables."""
    rows = _keys(arrivals, key, F.col(order))
    if known is not None:
        rows = rows.unionByName(_keys(known, key, F.lit(-1)))
    n = shuffle_partitions(arrivals.sparkSession)
    return rows.mapInArrow(_local_first, DDL).repartition(n, "k").sortWithinPartitions("seq").mapInArrow(_filter_pass, DDL).sortWithinPartitions("h1", "h2", "seq").mapInArrow(_exact_pass, DDL)


def seen_keys(arrivals: DataFrame, key: str, order: str, known: DataFrame | None = None) -> DataFrame:
    """The answer for each arrival: ``order`` as ``seq``, and ``state``: 0 new, 1 answered "seen" wrongly by the filter and
    put right by the check (the key is new), 2 seen before. ``known`` (column ``key``) holds keys known before all arrivals.

    One shuffle of hashes, by key; the sort by arrival before the filter and the sort by key before the exact check stay
    within a partition and spill. Arrivals must have distinct, non-negative ``order``. Null keys are no keys and get no row;
    equal keys of equal order keep one as the first; an empty table gives no rows; other columns are ignored.
    """
    return _answers(arrivals, key, order, known).filter(F.col("seq") >= 0).select("seq", "state")


def _parted(keys: DataFrame, key: str, parts: int, *more) -> DataFrame:
    """``part, h`` of the keys that are not null, by the two hashes that identify a key."""
    h1, h2 = F.xxhash64(F.col(key)), F.xxhash64(F.lit("second"), F.col(key), F.length(key))
    return keys.filter(F.col(key).isNotNull()).select(F.pmod(h1, F.lit(parts)).cast("int").alias("part"), F.xxhash64(h1, h2).alias("h"), *more)


def changed(state: DataFrame | None, key: str, added: DataFrame | None = None, removed: DataFrame | None = None, parts: int = 64) -> DataFrame:
    """``part, tables``: the kept filters after a deletion and an addition of keys (each distinct key of ``added`` once; of
    ``removed`` only keys that were added before, each once). ``state`` None begins with empty filters; ``parts`` must stay the same.
    A group holds one filter and the changes of its part, as many hashes as the keys over ``parts``."""
    spark = (added if added is not None else removed).sparkSession
    none = spark.createDataFrame([], "part int, h long, added boolean")
    ops = [none] + [_parted(df, key, parts).distinct().withColumn("added", F.lit(new)) for df, new in ((added, True), (removed, False)) if df is not None]
    every = ops[0]
    for x in ops[1:]:
        every = every.unionByName(x)
    kept = state if state is not None else spark.createDataFrame([], "part int, tables binary")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        part = (left if left.num_rows else right).column("part")[0].as_py()
        seen = CuckooFilter.load(left.column("tables")[0].as_py()) if left.num_rows else CuckooFilter()
        h = right.column("h").to_numpy().view(np.uint64)
        new = right.column("added").to_numpy(zero_copy_only=False).astype(bool)
        seen.delete(h[~new])
        fresh = h[new]
        seen.insert(fresh[~seen.contains(fresh)])
        return pa.table({"part": pa.array([part], pa.int32()), "tables": pa.array([seen.dump()], pa.binary())})

    return kept.groupBy("part").cogroup(every.groupBy("part")).applyInArrow(run, "part int, tables binary")


def maybe_seen(state: DataFrame, arrivals: DataFrame, key: str, order: str, parts: int = 64) -> DataFrame:
    """``seq, maybe``: whether the kept filters may hold the key of each arrival; False is certain. Null keys get no row. Arrivals
    are asked in groups of a part and ``parts``, so that a hot key is spread; each group reads its part's filter."""
    asked = _parted(arrivals, key, parts, F.col(order).cast("long").alias("seq")).withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(8)).cast("int"))
    copies = state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        h = left.column("h").to_numpy().view(np.uint64)
        maybe = CuckooFilter.load(right.column("tables")[0].as_py()).contains(h) if right.num_rows and len(h) else np.zeros(len(h), bool)
        return pa.table({"seq": left.column("seq"), "maybe": pa.array(maybe)})

    return asked.groupBy("part", "salt").cogroup(copies.groupBy("part", "salt")).applyInArrow(run, "seq long, maybe boolean")


def _link_keys(links: DataFrame, seeds: DataFrame, index: DataFrame) -> tuple[DataFrame, str, str, DataFrame]:
    key = lambda df, c: with_normal_url(df, c, "key")
    known = key(seeds.select("url"), "url").select("key").unionByName(key(index.select("url"), "url").select("key"))
    return key(links.select("link_id", "link"), "link"), "key", "link_id", known


def seen_links(links: DataFrame, seeds: DataFrame, index: DataFrame) -> DataFrame:
    """:func:`seen_keys` for the links of a crawl, in order of ``link_id``, by normalised URL."""
    return seen_keys(*_link_keys(links, seeds, index))


def found(links: DataFrame, seeds: DataFrame, index: DataFrame) -> DataFrame:
    return seen_links(links, seeds, index).filter(F.col("state") == SEEN).select(F.col("seq").alias("link_id"))


def audit(links: DataFrame, seeds: DataFrame, index: DataFrame) -> DataFrame:
    """Rate of wrong answers of the filters: positives among new keys; and of the tables of all partitions the entries, the bytes and
    the load, the share of slots in use."""
    s, arrival = F.col("state"), F.col("seq") >= 0
    tables = lambda c: F.coalesce(F.sum(F.when(s == TABLES, F.col(c))), F.lit(0))
    return (
        _answers(*_link_keys(links, seeds, index))
        .agg(
            F.count_if(arrival).alias("answers"), F.count_if(arrival & (s == SEEN)).alias("seen"), F.count_if(arrival & (s == NEW)).alias("new"), F.count_if(arrival & (s == MAYBE)).alias("false_positives"),
            tables("h1").alias("entries"), tables("h2").alias("slots"), tables("k").alias("bytes"),
        )
        .withColumn("false_positive_rate", F.col("false_positives") / F.greatest(F.col("new") + F.col("false_positives"), F.lit(1)))
        .withColumn("load", F.col("entries") / F.greatest("slots", F.lit(1)))
    )
