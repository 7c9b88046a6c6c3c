"""Queries of the ten problems over the tables of a folder, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, cuckoo, distinctive, encoding, language, leakage, repetition, site_lines, spam, templates
from spindrift.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def over(run: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, d: run(*[table(spark, d, n) for n in names])


def p4_frequent(passages: DataFrame, index: DataFrame) -> DataFrame:
    return site_lines.frequent_lines(site_lines.site_lines(passages, index), index).groupBy("site").agg(F.count("*").alias("lines"), F.max("pages").alias("most_pages"))


def p5_scores(postings: DataFrame, index: DataFrame) -> DataFrame:
    every = distinctive.distinctiveness(postings, index)
    return every.select("doc_id", "term", "degree", F.round("tf_score", 6).alias("tf_score"), F.round("graph_score", 6).alias("graph_score"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": over(spam.found, "passages", "documents_idx", "crawl_features"),
        "p2_found": over(spam.boilerplate, "passages", "documents_idx", "crawl_features"),
        "p2_bodies": over(templates.main_bodies, "passages", "documents_idx"),
        "p3_found": over(language.found, "passages", "documents_idx"),
        "p3_languages": over(language.languages, "passages", "documents_idx"),
        "p4_found": over(site_lines.found, "passages", "documents_idx"),
        "p4_frequent": over(p4_frequent, "passages", "documents_idx"),
        "p4_cleaned": over(site_lines.cleaned, "passages", "documents_idx"),
        "p5_found": over(distinctive.found, "postings", "documents_idx"),
        "p5_scores": over(p5_scores, "postings", "documents_idx"),
        "p6_found": over(encoding.found, "passages"),
        "p6_restored": over(encoding.repaired, "passages"),
        "p7_found": over(cuckoo.found, "links", "seed_urls", "documents_idx"),
        "p7_audit": over(cuckoo.audit, "links", "seed_urls", "documents_idx"),
        "p8_ids": over(bpe.encode, "documents"),
        "p8_roundtrip": over(bpe.roundtrip, "documents"),
        "p9_found": over(leakage.found, "documents", "benchmark"),
        "p9_leaks": over(leakage.leaks, "documents", "benchmark"),
        "p10_found": over(repetition.found, "documents"),
        "p10_shares": over(repetition.repetition, "documents"),
    }


LATEST = """
latest AS (
  SELECT doc_id, url, token_count FROM documents_idx WHERE doc_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY fetched_at DESC NULLS LAST, url DESC NULLS LAST, token_count DESC NULLS LAST) = 1
)"""
HOST = r"nullif(regexp_replace(lower(regexp_extract({u}, '^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)), '^(?:[^@]*@)?(?:www\.)?|:\d*$', '', 'g'), '')"

P4_LINES = f"""
{LATEST.strip()},
site AS (SELECT doc_id, {HOST.format(u="url")} AS site FROM latest WHERE url IS NOT NULL),
once AS (SELECT DISTINCT doc_id, pos, text FROM passages WHERE text IS NOT NULL AND doc_id IS NOT NULL AND pos IS NOT NULL),
line AS (
  SELECT doc_id, pos, unnest(generate_series(0, len(l) - 1)) AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, pos, string_split(text, chr(10)) AS l FROM once)
),
norm AS (
  SELECT DISTINCT site, line.doc_id, pos, line_no,
    regexp_replace(regexp_replace(lower(line), '\\p{{Nd}}+', '0', 'g'), '[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', '', 'g') AS n
  FROM line JOIN site ON site.doc_id = line.doc_id WHERE site IS NOT NULL
),
own AS (SELECT site, count(*) AS site_pages FROM site WHERE site IS NOT NULL GROUP BY site),
often AS (
  SELECT norm.site, n, count(DISTINCT doc_id) AS pages FROM norm JOIN own ON own.site = norm.site WHERE n <> ''
  GROUP BY norm.site, n, site_pages HAVING count(DISTINCT doc_id) >= 4 AND count(DISTINCT doc_id) >= 0.2 * site_pages
)"""

P5_ROWS = f"""
{LATEST.strip()},
once AS (
  SELECT term, doc_id, coalesce(max(tf), max(len(positions)))::DOUBLE AS tf FROM postings
  WHERE term IS NOT NULL AND doc_id IS NOT NULL GROUP BY term, doc_id
),
page AS (SELECT doc_id, sum(tf) AS total FROM once GROUP BY doc_id),
size AS (SELECT page.doc_id, CASE WHEN token_count >= 1 THEN token_count ELSE total END AS c FROM page LEFT JOIN latest ON latest.doc_id = page.doc_id),
freq AS (SELECT term, count(*) AS df FROM once GROUP BY term)"""

PATH = r"regexp_extract({u}, '^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)', 1)"
QUERY = r"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"


def _key(u: str) -> str:
    path = f"replace(url_decode(replace({PATH.format(u=u)}, '+', '%2B')), '//', '/')"
    pairs = f"list_sort([[string_split(x, '=')[1], x] FOR x IN string_split({QUERY.format(u=u)}, '&') IF x <> ''])"
    query = f"CASE WHEN {QUERY.format(u=u)} <> '' THEN '?' || array_to_string([y[2] FOR y IN {pairs}], '&') ELSE '' END"
    return f"coalesce({HOST.format(u=u)}, '') || CASE WHEN {path} LIKE '%/' THEN left({path}, length({path}) - 1) ELSE {path} END || {query}"


#: words as runs of letters and digits in lower case
WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"

P10 = f"""
word AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL)),
run AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p AS run FROM word WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM run WHERE run IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, run ORDER BY i) > 1),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(4) t(k) GROUP BY doc_id),
size AS (SELECT doc_id, count(*) AS n FROM word GROUP BY doc_id)"""

#: all stretches of every diagonal on which a run of four words is shared
P9 = f"""
item AS (SELECT item_id, w FROM (SELECT item_id, {WORDS} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) >= 15),
doc AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM item),
dw AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM doc),
iseed AS (SELECT item_id, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p AS s FROM iw WINDOW p AS (PARTITION BY item_id ORDER BY i)),
dseed AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p AS s FROM dw WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
diagonal AS (SELECT DISTINCT doc_id, item_id, dseed.i - iseed.i AS d FROM dseed JOIN iseed ON iseed.s = dseed.s),
cell AS (
  SELECT diagonal.doc_id, diagonal.item_id, d, iw.i AS k, iw.w = dw.w AS same FROM diagonal
  JOIN iw ON iw.item_id = diagonal.item_id JOIN dw ON dw.doc_id = diagonal.doc_id AND dw.i = iw.i + d),
cost AS (
  SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER p AS wrong, sum(CASE WHEN NOT same AND NOT before THEN 1 ELSE 0 END) OVER p AS twice
  FROM (SELECT *, coalesce(lag(same) OVER (PARTITION BY doc_id, item_id, d ORDER BY k), true) AS before FROM cell) WINDOW p AS (PARTITION BY doc_id, item_id, d ORDER BY k))"""

P4_CLEANED = """
whole AS (SELECT doc_id, pos, max(text) AS text FROM passages WHERE doc_id IS NOT NULL AND pos IS NOT NULL GROUP BY doc_id, pos),
gone AS (SELECT DISTINCT norm.doc_id, pos, line_no FROM norm JOIN often ON often.site = norm.site AND often.n = norm.n),
piece AS (SELECT doc_id, pos, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM (SELECT doc_id, pos, string_split(text, chr(10)) AS l FROM whole WHERE text IS NOT NULL)),
left_ AS (
  SELECT piece.doc_id, piece.pos, coalesce(string_agg(line, chr(10) ORDER BY piece.line_no) FILTER (gone.line_no IS NULL), '') AS text, count(gone.line_no)::INTEGER AS removed
  FROM piece LEFT JOIN gone ON gone.doc_id = piece.doc_id AND gone.pos = piece.pos AND gone.line_no = piece.line_no GROUP BY piece.doc_id, piece.pos)"""

P5_DEGREE = """
put AS (SELECT DISTINCT doc_id, term, unnest(positions).i AS i FROM postings WHERE term IS NOT NULL AND doc_id IS NOT NULL),
edge AS (SELECT DISTINCT a.doc_id, a.term, b.term AS other FROM put a JOIN put b ON b.doc_id = a.doc_id AND b.i BETWEEN a.i - 2 AND a.i + 2 AND b.term <> a.term),
near AS (SELECT doc_id, term, count(*)::INTEGER AS degree FROM edge GROUP BY doc_id, term)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p10_found": f"WITH {P10} SELECT hit.doc_id FROM hit JOIN size ON size.doc_id = hit.doc_id WHERE size.n >= 20 AND hit.n >= 0.4 * size.n",
        "p9_found": f"""WITH {P9} SELECT DISTINCT a.doc_id, a.item_id FROM cost a JOIN cost b ON b.doc_id = a.doc_id AND b.item_id = a.item_id AND b.d = a.d AND b.k >= a.k + 14
            WHERE a.same AND b.same AND 6 * (b.wrong - a.wrong) <= b.k - a.k + 1 AND b.twice = a.twice""",
        "p4_cleaned": f"""WITH {P4_LINES}, {P4_CLEANED.strip()}
            SELECT whole.doc_id, whole.pos, CASE WHEN coalesce(removed, 0) > 0 THEN left_.text ELSE whole.text END AS text, coalesce(removed, 0) AS removed
            FROM whole LEFT JOIN left_ ON left_.doc_id = whole.doc_id AND left_.pos = whole.pos""",
        "p5_scores": f"""WITH {P5_ROWS}, {P5_DEGREE.strip()},
            score AS (SELECT once.doc_id, once.term, once.tf, coalesce(degree, 0)::INTEGER AS degree, CASE WHEN c > 0 THEN c END AS c, ln(n / (df + 1)) / CASE WHEN n >= 2 THEN ln(n) END AS rarity
              FROM once JOIN size ON size.doc_id = once.doc_id JOIN freq ON freq.term = once.term LEFT JOIN near ON near.doc_id = once.doc_id AND near.term = once.term, (SELECT count(*) AS n FROM page))
            SELECT doc_id, term, degree, round(tf / c * rarity, 6) AS tf_score, round(degree / c * rarity, 6) AS graph_score FROM score""",
        "p4_found": f"WITH {P4_LINES} SELECT doc_id, pos, line_no::INTEGER AS line_no FROM norm JOIN often ON often.site = norm.site AND often.n = norm.n",
        "p4_frequent": f"WITH {P4_LINES} SELECT site, count(*) AS lines, max(pages) AS most_pages FROM often GROUP BY site",
        "p5_found": f"""WITH {P5_ROWS}
            SELECT once.doc_id, once.term FROM once JOIN size ON size.doc_id = once.doc_id JOIN freq ON freq.term = once.term, (SELECT count(*) AS n FROM page)
            WHERE c > 0 AND n >= 2 AND once.tf / c * (ln(n / (df + 1)) / ln(n)) >= 0.02""",
        "p7_found": f"""WITH
            every AS (
              SELECT link_id AS seq, {_key("link")} AS k FROM links WHERE link IS NOT NULL
              UNION ALL SELECT -1, {_key("url")} FROM seed_urls WHERE url IS NOT NULL
              UNION ALL SELECT -1, {_key("url")} FROM documents_idx WHERE url IS NOT NULL
            ),
            first AS (SELECT k, min(seq) AS m FROM every GROUP BY k)
            SELECT seq AS link_id FROM every JOIN first ON first.k = every.k WHERE seq > m AND seq >= 0""",
    }
