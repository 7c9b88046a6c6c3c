"""Passages gathered to pages and read once: what problems 1, 2 and 3 need to know of every page, kept as a table.

The one pass of Python over the texts repairs, cuts and hashes the lines of each page and builds its suffix automaton. Its
result, a short row of numbers for each page, is written to the shared checkpoint folder as parquet, so that the template count
reads only the columns with hashes and the decisions need no text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from spindrift.functions.urls import url_host
from spindrift.llm import page_text as T
from spindrift.llm.encoding import repair
from spindrift.llm.suffix_automaton import SuffixAutomaton
from spindrift.sources.tables import stored

#: positions of a chunk; a page of more passages is worked on in several chunks, so that no group grows without bound
CHUNK = 4096
#: words of a repeated substring at least, in a page of up to so many words; a page of twice as many asks for one more, up to MOST
LEAST, LEAST_UP_TO, MOST = 3, 600, 8
#: from this share of its characters covered by repeats a sentence loses what they cover
REPEATED = 0.6
#: lines of one output batch
BATCH_LINES = 1 << 16


def gathered(passages: DataFrame, index: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """``doc_id, chunk, items, more, page, links, tags``: the passages of each page in order of ``pos``, cut into chunks of
    bounded length. ``page`` has ``url, html_lang`` of the latest fetch, null for pages not in the index, ``links`` and ``tags``
    the greatest counts of the features; they stand in chunk 0, which also tells by ``more`` whether there are others.

    One shuffle brings all of it together: the rows of the index and of the features join as rows without a passage. Each (doc_id,
    pos) counts once; rows without ``doc_id`` or ``pos`` are dropped.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    n = F.floor(F.col("pos") / CHUNK)
    item = F.struct(F.col("pos").cast("int").alias("pos"), text("text"), text("ptype"))
    at = "array<struct<chunk:bigint,item:struct<pos:int,text:string,ptype:string>,more:boolean>>"
    own = F.struct(n.alias("chunk"), item.alias("item"), (n != 0).alias("more"))
    mark = F.struct(F.lit(0).alias("chunk"), F.lit(None).alias("item"), F.lit(True).alias("more"))
    rows = passages.filter(F.col("doc_id").isNotNull() & F.col("pos").isNotNull()).select(text("doc_id"), F.explode(F.when(n == 0, F.array(own).cast(at)).otherwise(F.array(own.cast(at[6:-1]), mark.cast(at[6:-1])))).alias("x")).select("doc_id", "x.*")
    # the latest fetch, as sources.tables.latest_documents has it
    fetch = F.struct(F.coalesce(F.col("fetched_at").cast("double"), F.lit(-1e18)).alias("at"), text("url"), F.col("token_count"), text("html_lang"))
    rows = rows.unionByName(index.filter(F.col("doc_id").isNotNull()).select(text("doc_id"), F.lit(0).alias("chunk"), fetch.alias("page")), True)
    if features is None:
        features = passages.sparkSession.createDataFrame([], "doc_id string, url_count int, tag_count int")
    counts = features.filter(F.col("doc_id").isNotNull()).select(text("doc_id"), F.lit(0).alias("chunk"), F.col("url_count").cast("int").alias("links"), F.col("tag_count").cast("int").alias("tags"))
    return rows.unionByName(counts, True).groupBy("doc_id", "chunk").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max(F.coalesce("more", F.lit(False))).alias("more"), F.max("page").alias("page"), F.max("links").alias("links"), F.max("tags").alias("tags"))


def least(n: int) -> int:
    """Words of a repeated substring at least in a page of n words. The places a run can recur at by chance grow with the page;
    a recurring run goes on for one more word by chance at most half of the time, which evens out one doubling. Eight words
    recur by chance in no page."""
    return min(MOST, LEAST + max(0, math.ceil(math.log2(max(1, n) / LEAST_UP_TO))))


def coverage(sentences: list[tuple[int, bool, tuple[str | None, ...]]]) -> list[tuple[float, int]]:
    """(characters of a clause that repeats do not cover, characters that repeats cover) of each sentence of a page.

    The suffix automaton of all words of the page marks what its repeated maximal substrings cover. A sentence with the structure
    of a clause keeps its characters, unless most of them are covered: then what is covered is no clause.
    """
    words = [w for _, _, ws in sentences for w in ws]
    covered = SuffixAutomaton(words).covered(least(len(words)))
    out, at = [], 0
    for n, clause, ws in sentences:
        total = hit = 0
        for w, c in zip(ws, covered[at : at + len(ws)], strict=True):
            k = len(w) + 1 if w else 1
            total += k
            if c:
                hit += k
        at += len(ws)
        out.append((0.0 if not clause or not total else n * (1 - hit / total) if hit > REPEATED * total else float(n), hit))
    return out


COLUMNS = """doc_id string, chunk long, more boolean, site long, n int, html_lang string, listed boolean, links int, tags int, chars long, clauses double,
    l_pos array<int>, l_flags array<int>, l_whole array<long>, l_label array<long>, l_tail array<long>, l_lossy array<long>, l_parts array<int>, p_h array<long>, p_n array<int>,
    l_own array<int>, l_good array<float>, l_hit array<int>, l_words array<int>, h_head array<long>, h_follows array<long>"""


class Lists:
    """Lists of a batch: flat values of each column and where each row ends."""

    def __init__(self, names: list[str]):
        self.flat: dict[str, list] = {c: [] for c in names}
        self.ends: dict[str, list[int]] = {c: [0] for c in names}

    def close(self) -> None:
        for c, v in self.flat.items():
            self.ends[c].append(len(v))

    def array(self, name: str, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.ends[name], pa.int32()), pa.array(self.flat[name], kind.value_type))


def read_page(items: list[tuple[int, str, str | None]], out: Lists) -> tuple[int, float, list[str]]:
    """Adds the lists of one page (or chunk); gives its characters, those of clauses, and its lines."""
    v = out.flat
    sentences, texts, n_of, before, chars = [], [], [], 0, 0
    for pos, text, ptype in items:
        own = T.lines(text)
        heading = T.IN_HEADING if ptype == "h" else 0
        title = T.IS_PAGE_TITLE if heading and len(own) == 1 and len(own[0].split()) <= T.TITLE_WORDS else 0
        for line in own:
            x = T.line_of(line)
            texts.append(line)
            v["l_pos"].append(pos)
            v["l_flags"].append(x.flags | heading | title)
            v["l_whole"].append(x.whole)
            v["l_label"].append(x.label)
            v["l_tail"].append(x.tail)
            v["l_lossy"].append(x.lossy)
            v["l_parts"].append(len(x.parts))
            for h, n in x.parts:
                v["p_h"].append(h)
                v["p_n"].append(n)
            chars += len(line)
            sentences += x.sentences
            n_of.append(len(x.sentences))
            if before:
                v["h_head"].append(before)
                v["h_follows"].append(x.whole if x.flags & T.IS_TITLE and not heading else 0)
            before = 0 if x.flags & T.IS_SENTENCE else x.whole ^ T.HEADING
    if before:
        v["h_head"].append(before)
        v["h_follows"].append(0)
    clauses, at, each = 0.0, 0, coverage(sentences)
    for k, text in zip(n_of, texts, strict=True):
        own = each[at : at + k]
        good = sum(g for g, _ in own)
        v["l_own"].append(len(text))
        v["l_good"].append(good)
        v["l_hit"].append(sum(h for _, h in own))
        v["l_words"].append(sum(len(ws) for _, _, ws in sentences[at : at + k]))
        clauses += good
        at += k
    out.close()
    return chars, clauses, texts


def once(pos: list[int], text: list[str | None], ptype: list[str | None]) -> list[tuple[int, str, str | None]]:
    """(pos, repaired text, ptype) of each position once, of those that have text; of rows that differ the one of the greatest
    text, which stands last."""
    n = len(pos)
    return [(pos[i], repair(text[i])[0] or "", ptype[i]) for i in range(n) if text[i] and (i + 1 == n or pos[i + 1] != pos[i])]


#: more columns that a problem reads of each page, as (DDL, function of (items, lines) of the pages of a batch -> arrays)
Extra = tuple[str, Callable[[list[list[tuple[int, str, str | None]]], list[list[str]]], list[pa.Array]]]


def analysed(pages: DataFrame, extra: Extra | None = None) -> DataFrame:
    """A row for each chunk of a page with its lines (``l_``), their parts (``p_``) and possible heads of lists (``h_``) as
    lists of numbers; a written table of the shared folder."""
    schema: StructType = _parse_datatype_string(COLUMNS + (", " + extra[0] if extra else ""))
    arrow = to_arrow_schema(schema)
    base = _parse_datatype_string(COLUMNS).names
    lists = [c for c in base if c[1:2] == "_"]
    kinds = [arrow.field(c).type for c in base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = b.column(2)
            flat = items.flatten()
            pos, text, ptype = (flat.field(k).to_pylist() for k in range(3))
            ends = [0, *items.value_lengths().to_pylist()]
            at, start = 0, 0
            out, rows, pages_of, lines_of = Lists(lists), [], [], []
            for i in range(b.num_rows):
                n = ends[i + 1]
                page = once(pos[at : at + n], text[at : at + n], ptype[at : at + n])
                at += n
                chars, clauses, texts = read_page(page, out)
                rows.append((n, chars, clauses))
                if extra:
                    pages_of.append(page)
                    lines_of.append(texts)
                if len(out.flat["l_pos"]) >= BATCH_LINES or i + 1 == b.num_rows:
                    n_items, chars_, clauses_ = zip(*rows, strict=True)
                    own = {"n": n_items, "chars": chars_, "clauses": clauses_}
                    given = {c: b.column(k).slice(start, i + 1 - start) for k, c in enumerate(b.schema.names)}
                    columns = [out.array(c, t) if c in out.flat else pa.array(own[c], t) if c in own else given[c] for c, t in zip(base, kinds, strict=True)]
                    yield pa.record_batch(columns + (extra[1](pages_of, lines_of) if extra else []), schema=arrow)
                    out, rows, pages_of, lines_of, start = Lists(lists), [], [], [], i + 1

    host = url_host(F.col("page.url"))
    site = F.when(host.isNotNull(), F.xxhash64(host))
    slim = pages.select("doc_id", "chunk", "items", "more", site.alias("site"), F.col("page.html_lang").alias("html_lang"), F.col("page").isNotNull().alias("listed"), "links", "tags")
    return stored(slim.mapInArrow(run, schema))
