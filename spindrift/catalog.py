"""All registered queries of the engine's own operators, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift import fixtures
from spindrift.functions import quality as Q
from spindrift.functions import text as X
from spindrift.functions import urls as U
from spindrift.operators import crawl, index, neardup, search, spelling
from spindrift.sources import crawl_files as C
from spindrift.sources import html as H
from spindrift.sources.tables import latest_documents, table

Query = Callable[[SparkSession, str], DataFrame]

#: the search of the ranking queries: two terms
TERMS = ["report", "visitor"]
MISSPELT = [("raport", "the", "village"), ("vilage", None, "report"), ("reportvisitor", "old", None)]


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as one passage each."""
    return index.as_passages(table(spark, d, "documents"))


def page_passages(spark: SparkSession, d: str) -> DataFrame:
    return index.passages_once(table(spark, d, "passages"))


def stored_documents(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, url, token_count`` of pages with terms: the address of the latest fetch, the count of the index."""
    stats = index.doc_stats(index.term_rows(page_passages(spark, d)))
    return stats.join(latest_documents(table(spark, d, "documents_idx")).select("doc_id", "url"), "doc_id", "left").select("doc_id", "url", "token_count")


def ranked(spark: SparkSession, d: str) -> DataFrame:
    postings = index.postings(index.term_rows(page_passages(spark, d)))
    return search.rank(search.slot_rows(postings, TERMS), TERMS, stored_documents(spark, d))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def q_tokenize(spark, d):
    return index.token_rows(documents(spark, d)).select("doc_id", "i", "type", "value")


def q_stem_vocab(spark, d):
    return index.vocabulary(documents(spark, d)).select("word", X.stem(F.col("word")).alias("stem"))


def q_words(spark, d):
    return index.passage_words(documents(spark, d)).select("doc_id", F.array_join("words", " ").alias("words"))


def q_term_rows(spark, d):
    return index.term_rows(page_passages(spark, d))


def q_postings(spark, d):
    rows = index.postings(index.term_rows(documents(spark, d)))
    return rows.select("term", "doc_id", "tf", F.transform("positions", lambda p: p["i"]).alias("at"))


def q_page_postings(spark, d):
    rows = index.postings(index.term_rows(page_passages(spark, d)))
    return rows.select("term", "doc_id", "tf", F.element_at("positions", 1)["i"].alias("first"), F.size(F.filter("positions", lambda p: p["ptype"] == "h")).alias("in_header"))


def q_doc_stats(spark, d):
    return index.doc_stats(index.term_rows(documents(spark, d)))


def q_doc_freq(spark, d):
    return index.doc_freq(index.postings(index.term_rows(documents(spark, d))))


def q_corpus_stats(spark, d):
    return rounded(index.corpus_stats(index.doc_stats(index.term_rows(documents(spark, d)))), "avg_len")


def q_bigrams(spark, d):
    return index.bigrams(page_passages(spark, d))


def q_trigrams(spark, d):
    return index.trigrams(index.vocabulary(documents(spark, d)))


def q_ranking(spark, d):
    return rounded(ranked(spark, d).select("doc_id", "bm25", "tf_idf", "proximity", "url_match", "has_header"), "bm25", "tf_idf", "url_match")


def q_topk(spark, d):
    return rounded(search.top(ranked(spark, d), search.DEFAULT_CAP), "bm25", "tf_idf", "url_match")


def q_proximity(spark, d):
    """The least distance of the two terms in each page that has one."""
    return ranked(spark, d).select("doc_id", "proximity")


def q_normalize_url(spark, d):
    return U.with_normal_url(table(spark, d, "links").select("link_id", "link"), "link").select("link_id", "norm_url")


def q_url_parts(spark, d):
    link = F.col("link")
    return table(spark, d, "links").filter("link is not null").select("link_id", U.root_url(link).alias("root"), U.url_host(link).alias("host"), F.octet_length("link").alias("url_len"))


def q_same_origin(spark, d):
    links = table(spark, d, "links").filter("link is not null")
    base = latest_documents(table(spark, d, "documents_idx")).select(F.col("doc_id").alias("src_doc_id"), U.url_host(F.col("url")).alias("base"))
    return links.join(base, "src_doc_id").select("link_id", U.same_origin(F.col("host"), F.col("base")).alias("same_origin"))


def q_doc_ids(spark, d):
    """OP-D2: the id of a page is the SHA-256 of its normalised address."""
    return table(spark, d, "documents_idx").filter("url is not null").select(F.sha2(U.normalize_url(F.col("url")), 256).alias("doc_id")).distinct()


def q_blocked(spark, d):
    block = C.blocklist_domains(fixtures.blocklist(spark))
    return crawl.not_blocked(table(spark, d, "links"), block).groupBy("host").agg(F.count("*").alias("links"))


def q_visited(spark, d):
    return crawl.visited(table(spark, d, "links"))


def q_visited_gate(spark, d):
    return crawl.visited_gate(table(spark, d, "links"))


def q_link_priority(spark, d):
    c = F.col
    score = crawl.child_priority(F.lit(1.0), c("same_domain"), c("depth"), F.lit(0.0), c("priority"))
    return rounded(table(spark, d, "links").filter("priority is not null").select("link_id", score.alias("priority")), "priority")


def q_frontier(spark, d):
    return crawl.serve(table(spark, d, "links").filter("link is not null"), 48).select("link_id", "priority")


def q_spill(spark, d):
    queue, rest = crawl.split_frontier(table(spark, d, "links").filter("link is not null"), 1000)
    tag = lambda df, name: df.select("link_id", F.lit(name).alias("place"))
    return tag(queue, "queue").unionByName(tag(rest, "spill"))


def q_schedule(spark, d):
    return crawl.schedule(table(spark, d, "links"))


def q_expand(spark, d):
    links = table(spark, d, "links")
    parents = links.groupBy("src_doc_id").agg(F.max("priority").alias("priority"), F.min("depth").alias("depth"), F.count("*").alias("n"))
    pages = parents.select(F.col("src_doc_id").alias("doc_id"), "priority", "depth", (1 + F.log(F.col("n") + 1.0)).alias("page_priority"), F.lit(0.0).alias("penalty"))
    return rounded(crawl.expand(pages, links, only_same_domain=True).select("link_id", "depth", "priority"), "priority")


def gate_rows(spark, d) -> DataFrame:
    f = table(spark, d, "crawl_features").filter("doc_id is not null").groupBy("doc_id").agg(*[F.max(x).alias(x) for x in ("dom_depth", "tag_count", "url_len", "url_count", "path_len", "host_len")])
    return f.join(index.doc_stats(index.term_rows(page_passages(spark, d))), "doc_id")


def q_quality_gate(spark, d):
    c = F.col
    x = Q.features(c("dom_depth"), F.coalesce("tag_count", F.lit(0)), F.coalesce("url_count", F.lit(0)), c("token_count"), c("unique_tokens"), c("url_len"), c("path_len"), c("host_len"))
    rows = gate_rows(spark, d).select("doc_id", "token_count", Q.score(x).alias("score"))
    return rounded(rows.select("doc_id", "score", Q.skipped(c("score"), c("token_count")).alias("skipped")), "score")


def q_page_priority(spark, d):
    c = F.col
    links = F.coalesce("url_count", F.lit(0))
    score = crawl.page_priority(links, F.lit(0.0), c("unique_tokens").cast("double"), c("token_count"))
    return rounded(gate_rows(spark, d).select("doc_id", score.alias("priority")), "priority")


def q_shingles(spark, d):
    rows = index.passage_words(documents(spark, d)).select("doc_id", F.explode(X.shingles(F.col("words"))).alias("shingle"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("shingles"), F.min("shingle").alias("first"), F.max(neardup.shingle_hash(F.col("shingle"))).alias("most"))


def signatures(spark, d) -> DataFrame:
    return neardup.signatures(index.passage_words(documents(spark, d)).select("doc_id", "words"))


def q_minhash(spark, d):
    return signatures(spark, d)


def q_lsh_pairs(spark, d):
    return neardup.pairs(signatures(spark, d))


def q_near_dup_keep(spark, d):
    return neardup.keep_first(signatures(spark, d))


def spelling_input(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = spark.createDataFrame(MISSPELT, "word string, left string, right string")
    return rows, index.trigrams(index.vocabulary(page_passages(spark, d))), index.bigrams(page_passages(spark, d))


def spelling_scored(spark, d) -> DataFrame:
    rows, tri, big = spelling_input(spark, d)
    return spelling.context(spelling.candidates(rows, tri).join(F.broadcast(rows), "word"), big)


def q_spell_candidates(spark, d):
    rows, tri, _ = spelling_input(spark, d)
    return spelling.candidates(rows, tri)


def q_spell_best(spark, d):
    return rounded(spelling.best(spelling_scored(spark, d)), "score")


def q_spell_split(spark, d):
    return rounded(spelling.splits(spelling_scored(spark, d)), "score")


def q_html_passages(spark, d):
    return H.page_passages(H.parse_pages(fixtures.html_pages(spark)).filter("indexable"))


def q_html_links(spark, d):
    return H.page_links(H.parse_pages(fixtures.html_pages(spark)))


def q_html_features(spark, d):
    parsed = H.parse_pages(fixtures.html_pages(spark))
    return H.page_features(parsed, H.page_links(parsed, garbage=True))


def q_robots_rules(spark, d):
    return C.robots_rules(fixtures.robots(spark))


def q_robots_allowed(spark, d):
    links = table(spark, d, "links").filter("link is not null").select("link_id", "host", F.regexp_extract("link", r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    rules = C.robots_rules(fixtures.robots_for_all(spark, links))
    return C.allowed_links(links, rules, "bot").groupBy("host").agg(F.count("*").alias("links"))


def q_sitemap_links(spark, d):
    return C.sitemap_links(fixtures.sitemaps(spark))


def queries() -> dict[str, Query]:
    return {name.removeprefix("q_").replace("topk", "topk_two_phase"): f for name, f in globals().items() if name.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    from spindrift import catalog_sql

    return catalog_sql.oracle_sql()
