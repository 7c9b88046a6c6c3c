"""DuckDB SQL of the same results as the queries of :mod:`spindrift.catalog`."""

from __future__ import annotations

from spindrift import fixtures
from spindrift.functions import quality as Q
from spindrift.functions import text as X

STOP = ", ".join(f"'{w}'" for w in sorted(set(X.STOP_WORDS)))
SQL_ENTITY = X.ENTITY
PIECE = X.PIECE.replace(X.MARK, r"\x01")

ONCE = """once AS (
  SELECT doc_id, pos, arg_max(text, coalesce(text, '')) AS text, coalesce(arg_max(ptype, coalesce(text, '') || chr(1) || coalesce(ptype, '')), 'b') AS ptype
  FROM passages WHERE doc_id IS NOT NULL AND pos IS NOT NULL GROUP BY doc_id, pos)"""
WHOLE = "once AS (SELECT doc_id, 0 AS pos, text, 'b' AS ptype FROM documents)"


def tokens(source: str) -> str:
    """CTEs ``once`` and ``tok(doc_id, pos, ptype, i, type, value)``; i counts from 0."""
    clean = "replace(text, chr(1), '')"
    return f"""{source},
pieces AS (
  SELECT doc_id, pos, ptype, CASE
      WHEN regexp_full_match({clean}, '{X.EMAIL.strip("^$")}') AND NOT regexp_matches({clean}, '^{X.IPV4}') THEN [chr(2) || {clean}]
      ELSE regexp_extract_all(regexp_replace({clean}, '{SQL_ENTITY}', chr(1) || '\\1' || chr(1), 'g'), '{PIECE}') END AS p
  FROM once WHERE text IS NOT NULL),
tok AS (
  SELECT doc_id, pos, ptype, (i - 1)::INTEGER AS i,
    CASE WHEN x[1] = chr(2) THEN 'EMAIL_ADDR' WHEN x[1] = chr(1) AND x[2:5] = 'http' THEN 'URL_ADDR' WHEN x[1] = chr(1) THEN 'IP_V4_ADDR'
      WHEN regexp_matches(x, '^[A-Za-z]') THEN 'WORD' WHEN regexp_matches(x, '^\\p{{Nd}}') THEN 'NUMBER' ELSE 'SYMBOL' END AS type,
    CASE WHEN x[1] = chr(2) THEN x[2:] WHEN x[1] = chr(1) THEN replace(x, chr(1), '') ELSE lower(x) END AS value
  FROM (SELECT doc_id, pos, ptype, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM pieces))"""


def stems(words: str) -> str:
    """CTEs that end in ``stems(word, stem)`` for the relation ``words`` with a column ``word``."""
    out, last = [f"s0 AS (SELECT DISTINCT word, word AS w FROM {words})"], "s0"
    for k, (rules, above) in enumerate(X.STEPS, 1):
        cases = " ".join(
            f"WHEN ends_with(w, '{s}') AND len(regexp_extract_all(left(w, len(w) - {len(s)}), '[aeiou][^aeiou]')) > {above} THEN left(w, len(w) - {len(s)}) || '{r}'"
            for s, r in sorted(rules.items(), key=lambda x: -len(x[0]))
        )
        out.append(f"s{k} AS (SELECT word, CASE {cases} ELSE w END AS w FROM {last})")
        last = f"s{k}"
    return ",\n".join(out) + f",\nstems AS (SELECT word, CASE WHEN len(word) <= 2 THEN word ELSE w END AS stem FROM {last})"


def terms(source: str) -> str:
    """CTEs that end in ``term(doc_id, term, i, ptype)``."""
    return f"""{tokens(source)},
kept AS (SELECT * FROM tok WHERE type <> 'WORD' OR value NOT IN ({STOP})),
kw AS (SELECT DISTINCT value AS word FROM kept WHERE type = 'WORD'),
{stems("kw")},
named AS (SELECT doc_id, pos, ptype, i, CASE WHEN type = 'WORD' THEN stem ELSE value END AS term FROM kept LEFT JOIN stems ON type = 'WORD' AND word = value),
term AS (SELECT doc_id, term, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, i) - 1)::INTEGER AS i, ptype FROM named WHERE strlen(term) <= 64)"""


def words(source: str) -> str:
    return f"{tokens(source)}, word AS (SELECT doc_id, pos, i, value AS word FROM tok WHERE type = 'WORD' AND value NOT IN ({STOP}))"


STATS = "stats AS (SELECT doc_id, count(*)::INTEGER AS token_count, count(DISTINCT term)::INTEGER AS unique_tokens FROM term GROUP BY doc_id)"
LATEST = """latest AS (SELECT doc_id, url FROM documents_idx WHERE doc_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY fetched_at DESC NULLS LAST, url DESC NULLS LAST) = 1)"""

SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*:"
HOST = r"nullif(regexp_replace(lower(regexp_extract({u}, '^\s*(?:" + SCHEME + r")?//([^/?#]*)', 1)), '^(?:[^@]*@)?(?:www\.)?|:\d*$', '', 'g'), '')"


def norm(u: str) -> str:
    path = f"regexp_extract({u}, '^\\s*(?:{SCHEME})?//[^/?#]*([^?#]*)', 1)"
    path = f"replace(url_decode(replace({path}, '+', '%2B')), '//', '/')"
    query = f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"
    pairs = f"list_sort([[string_split(x, '=')[1], x] FOR x IN string_split({query}, '&') IF x <> ''])"
    tail = f"CASE WHEN {query} <> '' THEN '?' || array_to_string([y[2] FOR y IN {pairs}], '&') ELSE '' END"
    return f"CASE WHEN {u} IS NOT NULL THEN coalesce({HOST.format(u=u)}, '') || CASE WHEN {path} LIKE '%/' THEN left({path}, len({path}) - 1) ELSE {path} END || {tail} END"


def ranking(names: list[str]) -> str:
    """CTEs that end in ``ranked`` for two terms."""
    a, b = names
    size = " + ".join(f"CASE WHEN contains(lower(url), '{t}') THEN {len(t)} ELSE 0 END" for t in names)
    score = lambda k: f"coalesce(w{k} * f{k} * 2.2 / nullif(f{k} + 1.2 * (1 - 0.75 + 0.75 * (ln(token_count / avg_len) + 0.01)), 0), 0)"
    return f"""{terms(ONCE)}, {STATS}, {LATEST},
corpus AS (SELECT count(*)::DOUBLE AS n, avg(token_count) AS avg_len FROM stats),
slot AS (
  SELECT doc_id, count(*) FILTER (term = '{a}') AS c0, count(*) FILTER (term = '{b}') AS c1, bool_or(ptype = 'h' AND k <= 500) AS has_header,
    list(i ORDER BY i) FILTER (term = '{a}' AND k <= 500) AS p0, list(i ORDER BY i) FILTER (term = '{b}' AND k <= 500) AS p1
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, term ORDER BY i) AS k FROM term WHERE term IN ('{a}', '{b}')) GROUP BY doc_id),
df AS (SELECT count(*) FILTER (c0 > 0) AS d0, count(*) FILTER (c1 > 0) AS d1 FROM slot),
scored AS (
  SELECT slot.doc_id, url, token_count, avg_len, has_header, p0, p1, ln(n / (d0 + 1)) AS w0, ln(n / (d1 + 1)) AS w1,
    nullif(c0, 0)::DOUBLE / token_count AS f0, nullif(c1, 0)::DOUBLE / token_count AS f1
  FROM slot JOIN stats ON stats.doc_id = slot.doc_id LEFT JOIN latest ON latest.doc_id = slot.doc_id, corpus, df),
ranked AS (
  SELECT doc_id, url, {score(0)} + {score(1)} AS bm25, coalesce(f0 * w0, 0) + coalesce(f1 * w1, 0) AS tf_idf,
    least(50, coalesce(list_min([x FOR x IN [list_min([y - s FOR y IN coalesce(p1, []) IF y > s]) FOR s IN coalesce(p0, [])] IF x IS NOT NULL]), 50))::BIGINT AS proximity,
    coalesce(ln(1 + {size}), 0) AS url_match, coalesce(has_header, false) AS has_header
  FROM scored)"""


SHOWN = "round(bm25, 6) AS bm25, round(tf_idf, 6) AS tf_idf, proximity, round(url_match, 6) AS url_match, has_header"
HASH = "('0x' || left(md5({x}), 7))::BIGINT"
SHINGLES = f"""{words(WHOLE)},
run AS (SELECT doc_id, row_number() OVER w AS k, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w || ' ' || lead(word, 3) OVER w AS shingle
  FROM word WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


def minhash() -> str:
    from spindrift.operators.neardup import PERMUTATIONS, PRIME, salts

    a, b = salts()
    table = ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)))
    return f"""{SHINGLES},
salt(k, a, b) AS (VALUES {table}),
hashed AS (SELECT DISTINCT doc_id, {HASH.format(x="shingle")} AS h FROM run WHERE shingle IS NOT NULL AND k <= 4997 AND doc_id IN (SELECT doc_id FROM word GROUP BY doc_id HAVING count(*) > 4)),
least_ AS (SELECT doc_id, k, min((a * h + b) % {PRIME})::INTEGER AS m FROM hashed, salt GROUP BY doc_id, k),
sigs AS (SELECT doc_id, list(m ORDER BY k) AS sig FROM least_ GROUP BY doc_id HAVING count(*) = {PERMUTATIONS})"""


def pairs() -> str:
    return f"""{minhash()},
reps AS (SELECT min(doc_id) AS doc_id, sig FROM sigs GROUP BY sig),
band AS (SELECT doc_id, b, array_to_string(sig[b * 8 + 1 : b * 8 + 8], ',') AS key FROM reps, range(16) t(b)),
met AS (SELECT DISTINCT x.doc_id AS earlier, y.doc_id AS later FROM band x JOIN band y ON x.b = y.b AND x.key = y.key AND x.doc_id < y.doc_id),
scored AS (SELECT earlier, later, list_sum(list_transform(list_zip(a.sig, z.sig), lambda p: CASE WHEN p[1] = p[2] THEN 1 ELSE 0 END)) / 128.0 AS similarity
  FROM met JOIN reps a ON a.doc_id = earlier JOIN reps z ON z.doc_id = later)"""


def spelling() -> str:
    from spindrift.catalog import MISSPELT

    rows = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in MISSPELT)
    tri = "SELECT {w} AS word, unnest(list_distinct([substr({w}, k, 3) FOR k IN range(1, len({w}) - 1)])) AS tri FROM {t} WHERE len({w}) >= 3"
    return f"""{words(ONCE)},
big AS (SELECT w1, w2, count(*) AS freq FROM (SELECT word AS w1, lead(word) OVER (PARTITION BY doc_id ORDER BY pos, i) AS w2 FROM word) WHERE w2 IS NOT NULL GROUP BY w1, w2),
vocab AS (SELECT DISTINCT word FROM word),
miss(word, l, r) AS (VALUES {rows}),
cand AS (SELECT DISTINCT m.word, v.word AS candidate FROM ({tri.format(w="word", t="miss")}) m JOIN ({tri.format(w="word", t="vocab")}) v ON v.tri = m.tri),
scored AS (
  SELECT cand.word, candidate, ln(1 + coalesce(a.freq, 0)) AS l, ln(1 + coalesce(z.freq, 0)) AS r FROM cand JOIN miss ON miss.word = cand.word
  LEFT JOIN big a ON a.w1 = miss.l AND a.w2 = candidate LEFT JOIN big z ON z.w1 = candidate AND z.w2 = miss.r)"""


def quality() -> str:
    raw = ["dom_depth", "coalesce(tag_count, 0)", "coalesce(url_count, 0)", "token_count", "unique_tokens", "CASE WHEN coalesce(url_count, 0) <> 0 THEN token_count::DOUBLE / url_count END", "unique_tokens::DOUBLE / token_count", "url_len", "path_len", "host_len"]
    z = " + ".join([f"{Q.BIAS!r}::DOUBLE", *(f"({w!r})::DOUBLE * ({x} - {c!r}::DOUBLE) / {s!r}::DOUBLE" for w, x, c, s in zip(Q.WEIGHTS, raw, Q.CENTRES, Q.SCALES, strict=True))])
    cols = ", ".join(f"max({c}) AS {c}" for c in ("dom_depth", "tag_count", "url_len", "url_count", "path_len", "host_len"))
    return f"""WITH {terms(ONCE)}, {STATS},
f AS (SELECT doc_id, {cols} FROM crawl_features WHERE doc_id IS NOT NULL GROUP BY doc_id),
z AS (SELECT f.doc_id, token_count, {z} AS z FROM f JOIN stats ON stats.doc_id = f.doc_id),
s AS (SELECT doc_id, token_count, coalesce(CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END, 0) AS s FROM z)
SELECT doc_id, round(s, 6) AS score, s < {Q.THRESHOLD} AND token_count < {Q.MIN_TOKENS} AS skipped FROM s"""


# What the literal inputs of fixtures.py give, worked out by hand from the rules of the operators.
HTML_PASSAGES = """
  ('https://a.example/x/one.html', 0, 'Tide tables', 'b'), ('https://a.example/x/one.html', 1, 'leak', 'b'), ('https://a.example/x/one.html', 2, 'Harbour', 'h'),
  ('https://a.example/x/one.html', 3, 'notes', 'h'), ('https://a.example/x/one.html', 4, 'Read', 'b'), ('https://a.example/x/one.html', 5, 'the next', 'b'),
  ('https://a.example/x/one.html', 6, 'page & more.', 'b'), ('https://a.example/x/one.html', 7, 'pdf', 'b'), ('https://a.example/x/one.html', 8, 'self', 'b'),
  ('https://c.example/', 0, 'No label', 'h'), ('https://c.example/', 1, 'Plain text.', 'b'), ('https://c.example/', 2, 'over', 'b'), ('https://c.example/', 3, 'js', 'b'),
  ('https://c.example/', 4, 'here', 'b'), ('https://c.example/', 5, 'http', 'b'),
  ('https://d.example/q', 0, 'one', 'b'), ('https://d.example/q', 1, 'two', 'b'), ('https://d.example/q', 2, 'a', 'b'), ('https://d.example/q', 3, 'b', 'b'), ('https://d.example/q', 4, 'c', 'b'),
  ('https://d.example/q', 5, 'd', 'b'), ('https://d.example/q', 6, 'e', 'b')"""
HTML_LINKS = """
  ('https://a.example/x/one.html', 'https://a.example/x/two.html', true), ('https://a.example/x/one.html', 'https://a.example/x/one.html?format=html', true),
  ('https://c.example/', 'https://a.example/x/', false), ('https://d.example/q', 'https://d.example/p?file=a.pdf', true), ('https://d.example/q', 'https://d.example/q?format=pdf&format=html', true)"""
#: url, depth and number of start tags, usable links (those in menus too), lengths of address, path and host
HTML_FEATURES = """
  ('https://a.example/x/one.html', 4, 17, 3, 28, 11, 9), ('https://a.example/de', 1, 1, 0, 20, 3, 9), ('https://c.example/', 3, 8, 1, 18, 1, 9), ('https://c.example/empty', 0, 0, 0, 23, 6, 9),
  ('https://d.example/q', 3, 8, 2, 19, 2, 9)"""
ROBOTS_RULES = """
  ('a.example', '*', ['/tmp/open'], ['/private', '/tmp'], 5), ('a.example', 'bot', []::VARCHAR[], ['/search'], 0), ('b.example', 'bot', ['/'], []::VARCHAR[], 0)"""
SITEMAP_LINKS = "('https://a.example/', 'https://a.example/x?a=1&b=2'), ('https://a.example/', 'https://a.example/y'), ('https://c.example/p', 'https://c.example/s.xml')"


def oracle_sql() -> dict[str, str]:
    link = norm("link")
    blocked = [x[2:-1] for x in fixtures.BLOCKLIST if x.startswith("||") and x.endswith("^")]
    not_blocked = " AND ".join(f"(host IS NULL OR (host <> '{b}' AND NOT ends_with(host, '.{b}')))" for b in blocked)
    best = "pow(2, -d) * greatest(2 * l + 3 * r, 1e-5)"
    return {
        "tokenize": f"WITH {tokens(WHOLE)} SELECT doc_id, i, type, value FROM tok",
        "stem_vocab": f"WITH {words(WHOLE)}, {stems('word')} SELECT word, stem FROM stems",
        "words": f"WITH {words(WHOLE)} SELECT once.doc_id, coalesce(string_agg(word, ' ' ORDER BY i), '') AS words FROM once LEFT JOIN word ON word.doc_id = once.doc_id GROUP BY once.doc_id",
        "term_rows": f"WITH {terms(ONCE)} SELECT doc_id, term, i, ptype FROM term",
        "postings": f"WITH {terms(WHOLE)} SELECT term, doc_id, count(*)::INTEGER AS tf, list(i ORDER BY i)[1:500] AS at FROM term GROUP BY term, doc_id",
        "page_postings": f"WITH {terms(ONCE)}, k AS (SELECT *, row_number() OVER (PARTITION BY term, doc_id ORDER BY i) AS k FROM term) SELECT term, doc_id, count(*)::INTEGER AS tf, min(i) AS first, (count(*) FILTER (ptype = 'h' AND k <= 500))::INTEGER AS in_header FROM k GROUP BY term, doc_id",
        "doc_stats": f"WITH {terms(WHOLE)}, {STATS} SELECT doc_id, token_count, unique_tokens FROM stats",
        "doc_freq": f"WITH {terms(WHOLE)} SELECT term, count(DISTINCT doc_id) AS df FROM term GROUP BY term",
        "corpus_stats": f"WITH {terms(WHOLE)}, {STATS} SELECT count(*) AS documents, round(avg(token_count), 6) AS avg_len FROM stats",
        "bigrams": f"WITH {words(ONCE)} SELECT w1, w2, count(*) AS freq FROM (SELECT word AS w1, lead(word) OVER (PARTITION BY doc_id ORDER BY pos, i) AS w2 FROM word) WHERE w2 IS NOT NULL GROUP BY w1, w2",
        "trigrams": f"WITH {words(WHOLE)} SELECT DISTINCT word, unnest([substr(word, k, 3) FOR k IN range(1, len(word) - 1)]) AS tri FROM word WHERE len(word) >= 3",
        "ranking": f"WITH {ranking(['report', 'visitor'])} SELECT doc_id, {SHOWN} FROM ranked",
        "proximity": f"WITH {ranking(['report', 'visitor'])} SELECT doc_id, proximity FROM ranked",
        "topk_two_phase": f"""WITH {ranking(["report", "visitor"])}, first AS (SELECT * FROM ranked ORDER BY bm25 DESC, tf_idf DESC, proximity, doc_id LIMIT 100)
            SELECT row_number() OVER (ORDER BY url_match DESC, has_header DESC, bm25 DESC, tf_idf DESC, proximity, doc_id)::INTEGER AS rank, doc_id, url, {SHOWN} FROM first""",
        "normalize_url": f"SELECT link_id, {link} AS norm_url FROM links",
        "url_parts": f"SELECT link_id, regexp_extract(link, '^\\s*({SCHEME})//', 1) || '//' || regexp_extract(link, '^\\s*{SCHEME}//([^/?#]*)', 1) || '/' AS root, {HOST.format(u='link')} AS host, strlen(link)::INTEGER AS url_len FROM links WHERE link IS NOT NULL",
        "same_origin": f"WITH {LATEST} SELECT link_id, contains({HOST.format(u='url')}, host) AS same_origin FROM links JOIN latest ON latest.doc_id = src_doc_id WHERE link IS NOT NULL",
        "doc_ids": f"SELECT DISTINCT sha256({norm('url')}) AS doc_id FROM documents_idx WHERE url IS NOT NULL",
        "blocked": f"SELECT host, count(*) AS links FROM links WHERE {not_blocked} GROUP BY host",
        "visited": f"SELECT {link} AS norm_url, min(depth) AS depth, count(*) AS arrivals FROM links WHERE link IS NOT NULL GROUP BY 1",
        "visited_gate": f"""SELECT link_id, CASE WHEN known IS NULL THEN 'visit' WHEN depth >= known THEN 'stop' ELSE 'expand' END AS action, greatest(coalesce(known - depth, 0), 0) AS penalty
            FROM (SELECT link_id, depth, min(depth) OVER (PARTITION BY {link} ORDER BY link_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM links WHERE link IS NOT NULL)""",
        "link_priority": "SELECT link_id, round(CASE WHEN same_domain THEN 2.0 ELSE 1.0 END * 3 / (depth + 1.0) * pow(priority, 0.6), 6) AS priority FROM links WHERE priority IS NOT NULL",
        "frontier": "SELECT link_id, priority FROM links WHERE link IS NOT NULL ORDER BY priority DESC NULLS LAST, link_id LIMIT 48",
        "spill": "SELECT link_id, CASE WHEN row_number() OVER (ORDER BY coalesce(priority, '-infinity'::DOUBLE) DESC, link_id) <= 1000 THEN 'queue' ELSE 'spill' END AS place FROM links WHERE link IS NOT NULL",
        "schedule": "SELECT link_id, host, (row_number() OVER (PARTITION BY host ORDER BY priority DESC NULLS LAST, link_id) - 1) * 3 AS start_s FROM links WHERE host IS NOT NULL",
        "expand": """WITH p AS (SELECT src_doc_id, max(priority) AS parent, min(depth) AS d, 1 + ln(count(*) + 1.0) AS page FROM links GROUP BY src_doc_id)
            SELECT link_id, d + 1 AS depth, round(page * 2 * 3 / (d + 2.0) * pow(parent, 0.6), 6) AS priority FROM links JOIN p ON p.src_doc_id = links.src_doc_id WHERE same_domain""",
        "quality_gate": quality(),
        "page_priority": f"""WITH {terms(ONCE)}, {STATS}, f AS (SELECT doc_id, coalesce(max(url_count), 0) AS n FROM crawl_features WHERE doc_id IS NOT NULL GROUP BY doc_id)
            SELECT f.doc_id, round((1 + CASE WHEN n > 0 THEN ln(n + 1.0) ELSE 0 END) * unique_tokens / token_count, 6) AS priority FROM f JOIN stats ON stats.doc_id = f.doc_id""",
        "shingles": f"WITH {SHINGLES} SELECT doc_id, count(*) AS shingles, min(shingle) AS first, max({HASH.format(x='shingle')}) AS most FROM run WHERE shingle IS NOT NULL GROUP BY doc_id",
        "minhash": f"WITH {minhash()} SELECT doc_id, sig FROM sigs",
        "lsh_pairs": f"WITH {pairs()} SELECT earlier, later, similarity FROM scored WHERE similarity > 0.8",
        "spell_candidates": f"WITH {spelling()} SELECT word, candidate FROM cand",
        "spell_best": f"""WITH {spelling()}, near AS (SELECT *, levenshtein(word, candidate)::INTEGER AS d FROM scored)
            SELECT word, candidate, d AS distance, round({best}, 6) AS score FROM near WHERE d < 3 QUALIFY row_number() OVER (PARTITION BY word ORDER BY {best} DESC, candidate) = 1""",
        "spell_split": f"""WITH {spelling()}, cut AS (SELECT DISTINCT word, unnest(range(3, len(word) - 2)) AS c FROM scored WHERE len(word) >= 6),
            both_ AS (SELECT cut.word, c, a.candidate AS first, z.candidate AS second, ln(greatest(2 * a.l + 3 * z.r, 1e-5)) AS score
              FROM cut JOIN scored a ON a.word = cut.word AND a.candidate = left(cut.word, c) JOIN scored z ON z.word = cut.word AND z.candidate = substr(cut.word, c + 1))
            SELECT word, first, second, round(score, 6) AS score FROM both_ QUALIFY row_number() OVER (PARTITION BY word ORDER BY score DESC, c) = 1""",
        "html_passages": f"SELECT * FROM (VALUES {HTML_PASSAGES}) t(url, pos, text, ptype)",
        "html_links": f"SELECT * FROM (VALUES {HTML_LINKS}) t(url, link, same_domain)",
        "html_features": f"SELECT * FROM (VALUES {HTML_FEATURES}) t(url, dom_depth, tag_count, url_count, url_len, path_len, host_len)",
        "robots_rules": f"SELECT * FROM (VALUES {ROBOTS_RULES}) t(host, agent, allow, disallow, delay)",
        "sitemap_links": f"SELECT * FROM (VALUES {SITEMAP_LINKS}) t(page_url, link)",
        "near_dup_keep": f"""WITH RECURSIVE {pairs()},
            close AS (SELECT earlier, later FROM scored WHERE similarity > 0.8),
            node AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT earlier AS id FROM close UNION SELECT later FROM close)),
            step AS (
              SELECT 0::BIGINT AS k, []::BIGINT[] AS kept
              UNION ALL SELECT node.k, CASE WHEN len(list_intersect(kept, coalesce((SELECT list(earlier) FROM close WHERE later = node.id), []))) > 0 THEN kept ELSE list_append(kept, node.id) END
              FROM step JOIN node ON node.k = step.k + 1),
            accepted AS (SELECT unnest(kept) AS id FROM step WHERE k = (SELECT max(k) FROM step)),
            rep AS (SELECT sigs.doc_id, reps.doc_id AS rep FROM sigs JOIN reps ON reps.sig = sigs.sig)
            SELECT doc_id, doc_id = rep AND (rep NOT IN (SELECT id FROM node) OR rep IN (SELECT id FROM accepted)) AS kept, rep FROM rep""",
        "robots_allowed": "SELECT host, count(*) AS links FROM links WHERE link IS NOT NULL AND NOT regexp_matches(link, '^[A-Za-z]+://[^/?#]*/(help|view)') GROUP BY host",
    }
