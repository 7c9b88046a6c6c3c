"""Context-aware spelling correction (OP-50 to OP-57)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions import text as X

LEFT, RIGHT, FLOOR = 2.0, 3.0, 1e-5
MAX_TYPO = 3


def candidates(words: DataFrame, trigrams: DataFrame) -> DataFrame:
    """OP-51: ``word, candidate``: vocabulary words that share a trigram with the word; an equi-join on trigrams."""
    mine = words.select("word", F.explode(X.letter_trigrams(F.col("word"))).alias("tri"))
    return mine.join(trigrams.withColumnRenamed("word", "candidate"), "tri").select("word", "candidate").distinct()


def context(pairs: DataFrame, bigrams: DataFrame) -> DataFrame:
    """OP-52: adds ``l, r``: ln(1 + frequency) of (left, candidate) and (candidate, right); an absent neighbour gives 0.

    ``pairs`` has ``word, candidate, left, right``.
    """
    before = bigrams.select(F.col("w1").alias("left"), F.col("w2").alias("candidate"), F.log1p("freq").alias("l"))
    after = bigrams.select(F.col("w1").alias("candidate"), F.col("w2").alias("right"), F.log1p("freq").alias("r"))
    joined = pairs.join(before, ["left", "candidate"], "left").join(after, ["candidate", "right"], "left")
    return joined.withColumn("l", F.coalesce("l", F.lit(0.0))).withColumn("r", F.coalesce("r", F.lit(0.0)))


def channel(left: Column, right: Column) -> Column:
    return F.greatest(LEFT * left + RIGHT * right, F.lit(FLOOR))


def best(scored: DataFrame, max_typo: int = MAX_TYPO) -> DataFrame:
    """OP-53, 54: ``word, candidate, distance, score`` of the best candidate of each word nearer than ``max_typo`` edits;
    of equal scores the first in order of letters."""
    d = F.levenshtein("word", "candidate", max_typo)
    near = scored.withColumn("distance", d).filter((F.col("distance") >= 0) & (F.col("distance") < max_typo))
    near = near.withColumn("score", F.pow(F.lit(2.0), -F.col("distance")) * channel(F.col("l"), F.col("r")))
    order = Window.partitionBy("word").orderBy(F.desc("score"), F.asc("candidate"))
    return near.withColumn("n", F.row_number().over(order)).filter("n = 1").select("word", "candidate", "distance", "score")


def splits(scored: DataFrame) -> DataFrame:
    """OP-55: ``word, first, second, score``: the best cut of a word into two of its candidates, from its third letter to its
    third last. ``scored`` has ``word, candidate, l, r``; of equal scores the first cut."""
    words = scored.select("word").distinct().filter(F.length("word") >= 6)
    cuts = words.select("word", F.explode(F.sequence(F.lit(3), F.length("word") - 3)).alias("cut"))
    cuts = cuts.select("word", "cut", F.left("word", F.col("cut")).alias("first"), F.substring(F.col("word"), F.col("cut") + 1, F.length("word")).alias("second"))
    a = scored.select("word", F.col("candidate").alias("first"), "l")
    b = scored.select("word", F.col("candidate").alias("second"), "r")
    both = cuts.join(a, ["word", "first"]).join(b, ["word", "second"]).withColumn("score", F.log(channel(F.col("l"), F.col("r"))))
    order = Window.partitionBy("word").orderBy(F.desc("score"), F.asc("cut"))
    return both.withColumn("n", F.row_number().over(order)).filter("n = 1").select("word", "first", "second", "score")


def correct(words: list[str], at: int, trigrams: DataFrame, bigrams: DataFrame, max_typo: int = MAX_TYPO) -> list[str]:
    """The words with the one at ``at`` replaced by its best candidate, or cut in two, or left as it is."""
    spark = trigrams.sparkSession
    left, right = words[at - 1] if at else None, words[at + 1] if at + 1 < len(words) else None
    one = spark.createDataFrame([(words[at], left, right)], "word string, left string, right string")
    pairs = candidates(one, trigrams).join(F.broadcast(one), "word")  # one row
    scored = context(pairs, bigrams)
    hit = best(scored, max_typo).first()
    if hit:
        return [*words[:at], hit["candidate"], *words[at + 1 :]]
    cut = splits(scored).first()
    return [*words[:at], cut["first"], cut["second"], *words[at + 1 :]] if cut else words


def merge_slots(first: DataFrame, second: DataFrame) -> DataFrame:
    """OP-56: documents of both halves in one slot: counts added, positions one after the other."""
    tagged = first.withColumn("o", F.lit(0)).unionByName(second.withColumn("o", F.lit(1)))
    parts = F.sort_array(F.collect_list(F.struct("o", "positions")))
    return tagged.groupBy("doc_id").agg(F.sum("tf").cast("int").alias("tf"), F.flatten(F.transform(parts, lambda p: p["positions"])).alias("positions"))
