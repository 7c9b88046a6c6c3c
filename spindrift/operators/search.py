"""Query, ranking and top-k (OP-40 to OP-48) over postings, document statistics and URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import text as X

K1, B = 1.2, 0.75
PENALTY = 50
NEVER = (1 << 63) - 1
DEFAULT_CAP, MIN_CAP = 100, 10


def query_tokens(spark: SparkSession, query: str) -> tuple[list[str], list[tuple[str, str]]]:
    """(words, [(type, term)]) of a query, by the expressions that index the texts; one row on the driver."""
    tok = spark.range(1).select(X.tokens(F.lit(query)).alias("t"))
    kept = F.filter("t", lambda t: (t["type"] != "WORD") | ~t["value"].isin(X.STOP_WORDS))
    pair = F.transform(kept, lambda t: F.struct(t["type"].alias("type"), F.when(t["type"] == "WORD", X.stem(t["value"])).otherwise(t["value"]).alias("term")))
    row = tok.select(X.words(F.col("t")).alias("w"), pair.alias("p")).first()
    return list(row["w"] or []), [(x["type"], x["term"]) for x in row["p"] or []]


def idf(documents: Column, df: Column) -> Column:
    """OP-42; may be negative."""
    return F.log(documents / (df + 1))


def bm25(idf: Column, tf: Column, tokens: Column, avg_len: Column) -> Column:
    """OP-41: normalised frequency and a logarithmic length ratio. For short documents the denominator, and so the score,
    may be negative; a denominator of exactly 0 gives null instead of an error."""
    below = tf + K1 * (1 - B + B * (F.log(tokens / avg_len) + 0.01))
    return idf * tf * (K1 + 1) / F.nullif(below, F.lit(0.0))


def url_match(url: Column, terms: list[str]) -> Column:
    """OP-44a: ln(1 + letters of the terms that the URL in lower case contains)."""
    hit = [F.when(F.contains(F.lower(url), F.lit(t)), len(t)).otherwise(0) for t in terms]
    return F.log1p(sum(hit, F.lit(0)).cast("double"))


def proximity(positions: Column, slots: int) -> Column:
    """OP-44: least distance over chains of ascending positions, one position of each slot in turn; a missing slot costs."""

    def chain(i: int, s: Column) -> Column:
        if i + 1 >= slots:
            return F.lit(i * PENALTY).cast("long")
        start = F.struct(s.cast("long").alias("last"), F.lit(None).cast("long").alias("out"), F.lit(True).alias("alive"))

        def step(acc: Column, j: Column) -> Column:
            at = F.get(positions, j)
            after = F.get(F.filter(at, lambda x: x > acc["last"]), 0).cast("long")
            missing = ((slots - (j - i)) * PENALTY).cast("long") + acc["last"] - s
            return (
                F.when(~acc["alive"], acc)
                .when(F.size(at) == 0, F.struct(acc["last"].alias("last"), missing.alias("out"), F.lit(False).alias("alive")))
                .otherwise(F.struct(F.coalesce(after, acc["last"]).alias("last"), acc["out"].alias("out"), after.isNotNull().alias("alive")))
            )

        done = lambda acc: F.when(acc["alive"], i * PENALTY + acc["last"] - s).otherwise(acc["out"])
        return F.aggregate(F.sequence(F.lit(i + 1), F.lit(slots - 1)), start, step, done)

    starts = lambda i: F.transform(F.get(positions, F.lit(i)), lambda s: chain(i, s))
    best = [F.array_min(starts(i)) for i in range(slots)]
    least = best[0] if slots == 1 else F.least(*best)
    return F.coalesce(least, F.lit(NEVER))


def slot_rows(postings: DataFrame, slots: list[str]) -> DataFrame:
    """OP-40: ``slot, doc_id, tf, positions``: the postings of each term; the filter on terms reaches the scan of a stored index.
    A term that stands twice in the query has two slots."""
    pairs = postings.sparkSession.createDataFrame([(i, t) for i, t in enumerate(slots)], "slot int, term string")
    return postings.filter(F.col("term").isin(sorted(set(slots)))).join(F.broadcast(pairs), "term").select("slot", "doc_id", "tf", "positions")  # as many rows as query words


def rank(slot_rows: DataFrame, slots: list[str], documents: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """OP-40b to OP-44b: ``doc_id, url, bm25, tf_idf, proximity, url_match, has_header`` of all candidates.

    ``documents`` has ``doc_id, url, token_count``. One shuffle of the matching postings by document; a slot without the
    document adds nothing. Number of documents, average length and frequencies are one row each, joined by broadcast.
    """
    n = len(slots)
    stats = documents.agg(F.count("*").alias("documents"), F.avg("token_count").alias("avg_len")) if stats is None else stats
    freq = slot_rows.groupBy().agg(*[F.count_if(F.col("slot") == i).alias(f"df{i}") for i in range(n)])
    own = lambda i, c: F.max(F.when(F.col("slot") == i, F.col(c)))
    wide = slot_rows.groupBy("doc_id").agg(*[own(i, "tf").alias(f"tf{i}") for i in range(n)], *[own(i, "positions").alias(f"at{i}") for i in range(n)])
    every = wide.join(documents, "doc_id").crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(freq))
    tokens = F.col("token_count").cast("double")
    tf = [F.col(f"tf{i}") / F.nullif(tokens, F.lit(0.0)) for i in range(n)]
    weight = [idf(F.col("documents").cast("double"), F.col(f"df{i}")) for i in range(n)]
    none = F.expr("cast(array() as array<int>)")
    at = F.array(*[F.coalesce(F.transform(f"at{i}", lambda p: p["i"].cast("int")), none) for i in range(n)])
    headed = [F.coalesce(F.exists(f"at{i}", lambda p: p["ptype"] == "h"), F.lit(False)) for i in range(n)]
    return every.select(
        "doc_id",
        "url",
        sum((F.coalesce(bm25(weight[i], tf[i], tokens, F.col("avg_len")), F.lit(0.0)) for i in range(1, n)), F.coalesce(bm25(weight[0], tf[0], tokens, F.col("avg_len")), F.lit(0.0))).alias("bm25"),
        sum((F.coalesce(tf[i] * weight[i], F.lit(0.0)) for i in range(1, n)), F.coalesce(tf[0] * weight[0], F.lit(0.0))).alias("tf_idf"),
        proximity(at, n).alias("proximity"),
        F.coalesce(url_match(F.col("url"), slots), F.lit(0.0)).alias("url_match"),
        F.greatest(*headed, F.lit(False)).alias("has_header"),
    )


def cap(value: str | int | None) -> int:
    """OP-47: default 100, also for what is no number; at least 10."""
    try:
        return max(int(value), MIN_CAP) if value is not None else DEFAULT_CAP
    except ValueError:
        return DEFAULT_CAP


def top(ranked: DataFrame, limit: int) -> DataFrame:
    """OP-45, 46: the best by BM25, TF-IDF and proximity, then put in order of URL match and header flag.

    Both orders are made total by the other keys and the document. ``rank`` counts from 1.
    """
    first = ranked.orderBy(F.desc("bm25"), F.desc("tf_idf"), F.asc("proximity"), F.asc("doc_id")).limit(limit)
    keys = F.struct((-F.col("url_match")).alias("a"), (~F.col("has_header")).alias("b"), (-F.col("bm25")).alias("c"), (-F.col("tf_idf")).alias("d"), "proximity", "doc_id")
    # at most ``limit`` rows: a feature of the report, ordered in one array
    ordered = first.agg(F.sort_array(F.collect_list(F.struct(keys.alias("k"), F.struct(*ranked.columns).alias("v")))).alias("all"))
    return ordered.select(F.posexplode("all").alias("i", "x")).select((F.col("i") + 1).alias("rank"), "x.v.*")
