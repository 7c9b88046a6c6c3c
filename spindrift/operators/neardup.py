"""Near-duplicate gate (OP-34 to OP-37): shingles, MinHash, banded LSH, similarity and keep-first."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions import text as X
from spindrift.sources.tables import checkpoint_folder

PERMUTATIONS, BANDS, ROWS = 128, 16, 8
PRIME = (1 << 31) - 1
MIN_SIMILARITY = 0.8


def salts() -> tuple[np.ndarray, np.ndarray]:
    """128 pairs (a, b) of a linear congruential sequence, under 2^31, so that a * h + b fits 64 bits for h under 2^28."""
    x, out = 1, []
    for _ in range(2 * PERMUTATIONS):
        x = (x * 48271) % PRIME
        out.append(x)
    return np.array(out[::2], np.uint64), np.array(out[1::2], np.uint64)


def shingle_hash(shingle):
    """28 bits of an MD5 sum: the same in every engine."""
    return F.conv(F.substring(F.md5(shingle), 1, 7), 16, 10).cast("long")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def minhash(hashes: pd.Series) -> pd.Series:
    a, b = salts()

    def one(h) -> np.ndarray:
        x = np.unique(np.asarray(h, np.uint64))
        out = np.full(PERMUTATIONS, PRIME, np.uint64)
        for part in range(0, len(x), 4096):
            out = np.minimum(out, ((a[:, None] * x[part : part + 4096] + b[:, None]) % np.uint64(PRIME)).min(1))
        return out.astype(np.int32)

    return hashes.map(one)


def signatures(words: DataFrame) -> DataFrame:
    """``doc_id, sig`` of documents with more than four words; ``words`` has ``doc_id, words``. All words count; the original
    operator stops at 5000."""
    return words.filter(F.size("words") > 4).select("doc_id", minhash(F.transform(X.shingles(F.col("words")), shingle_hash)).alias("sig"))


def classes(signatures: DataFrame) -> DataFrame:
    """``doc_id, rep``: documents of equal signatures (by 128 bits of hash) form a class, named by its first document. Copies
    go no further. The first is found by a partial aggregate, so a class of many copies meets in one row of each task."""
    own = signatures.select("doc_id", F.xxhash64("sig").alias("h"), F.xxhash64(F.lit("second"), F.col("sig")).alias("m"))
    return own.join(own.groupBy("h", "m").agg(F.min("doc_id").alias("rep")), ["h", "m"]).select("doc_id", "rep")


def bands(signatures: DataFrame) -> DataFrame:
    """``band, key, doc_id``: a key for each of 16 bands of 8 rows. Keys are hashes: an accident makes a candidate more, which
    the similarity drops."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(F.slice("sig", b * ROWS + 1, ROWS)).alias("key")))
    return signatures.select("doc_id", F.explode(keys).alias("k")).select("k.band", "k.key", "doc_id")


def similarity(a, b):
    """OP-37: share of equal positions."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / PERMUTATIONS


def pairs(signatures: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """``earlier, later, similarity`` over ``least`` between classes of equal signatures, each class by its first document.

    Buckets hold only different signatures that share a band; AQE splits a bucket that is skewed. Signatures are made once and
    kept by a checkpoint, as they are needed for the bands and on both sides of a pair.
    """
    checkpoint_folder(signatures.sparkSession)
    hashed = signatures.withColumns({"h": F.xxhash64("sig"), "m": F.xxhash64(F.lit("second"), F.col("sig"))})
    own = hashed.groupBy("h", "m").agg(F.min(F.struct("doc_id", "sig")).alias("first")).select("first.*").checkpoint()
    b = bands(own)
    met = b.join(b.withColumnRenamed("doc_id", "later"), ["band", "key"]).filter(F.col("doc_id") < F.col("later")).select(F.col("doc_id").alias("earlier"), "later").distinct()
    x = own.select(F.col("doc_id").alias("earlier"), F.col("sig").alias("sig_a"))
    y = own.select(F.col("doc_id").alias("later"), F.col("sig").alias("sig_b"))
    scored = met.join(x, "earlier").join(y, "later").select("earlier", "later", similarity(F.col("sig_a"), F.col("sig_b")).alias("similarity"))
    return scored.filter(F.col("similarity") > least)


def similar_to(new: DataFrame, known: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """``doc_id, similarity`` of the new signatures that are like a known one, or like a new one of a smaller ``doc_id``: only pairs
    with a new side are made, by their bands; copies by their hash, where one of a class stands for all."""
    every = known.select("doc_id", "sig", F.lit(0).alias("age")).unionByName(new.select("doc_id", "sig", F.lit(1).alias("age")))
    own = lambda df: df.select("doc_id", "sig", F.xxhash64("sig").alias("h"), F.xxhash64(F.lit("second"), F.col("sig")).alias("m"))
    firsts = own(every).join(every.select("doc_id", "age"), "doc_id").groupBy("h", "m").agg(F.min(F.struct("age", "doc_id", "sig")).alias("f"))
    copies = own(new).join(firsts, ["h", "m"]).filter((F.col("f.age") == 0) | (F.col("f.doc_id") < F.col("doc_id"))).select("doc_id", F.lit(1.0).alias("similarity"))
    first = firsts.select("f.*")
    sides = bands(first).join(first.select("doc_id", "age"), "doc_id")
    met = sides.filter("age = 1").join(sides.select("band", "key", F.col("doc_id").alias("other"), F.col("age").alias("other_age")), ["band", "key"])
    met = met.filter((F.col("other_age") == 0) | (F.col("other") < F.col("doc_id"))).select("doc_id", "other").distinct()
    scored = met.join(first.select("doc_id", "sig"), "doc_id").join(first.select(F.col("doc_id").alias("other"), F.col("sig").alias("sig_b")), "other")
    scored = scored.select("doc_id", similarity(F.col("sig"), F.col("sig_b")).alias("similarity")).filter(F.col("similarity") > least)
    return copies.unionByName(scored).groupBy("doc_id").agg(F.max("similarity").alias("similarity"))


def keep_first(signatures: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """``doc_id, kept, rep``: in order of ``doc_id`` a document is rejected if an accepted earlier one is too similar.

    Copies are rejected with their class's first document as ``rep``. Among the others a round decides all whose earlier
    neighbours are decided; rounds are checkpointed to the shared folder and end when no pair is open.
    """
    spark = signatures.sparkSession
    checkpoint_folder(spark)
    sigs = signatures.checkpoint()
    member = classes(sigs)
    edges = pairs(sigs, least).select("earlier", "later").checkpoint()
    state = edges.select(F.col("earlier").alias("id")).unionByName(edges.select(F.col("later").alias("id"))).distinct().withColumn("kept", F.lit(None).cast("boolean")).checkpoint()
    while state.filter("kept is null").limit(1).count():
        known = state.select(F.col("id").alias("earlier"), F.col("kept").alias("e"))
        seen = edges.join(known, "earlier").groupBy("later").agg(F.max(F.coalesce("e", F.lit(False))).alias("accepted"), F.max(F.col("e").isNull()).alias("open"))
        new = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("later").isNull(), True).when(F.col("accepted"), False).when(~F.col("open"), True)
        state = state.join(seen, F.col("id") == F.col("later"), "left").select("id", new.alias("kept")).checkpoint()
    verdict = member.join(state, F.col("rep") == F.col("id"), "left")
    return verdict.select("doc_id", ((F.col("doc_id") == F.col("rep")) & F.coalesce("kept", F.lit(True))).alias("kept"), "rep")
