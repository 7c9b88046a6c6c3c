"""Problem 3: missing or wrong document language labels.

Error-correcting output codes: each language has a codeword, a binary n-gram classifier predicts each bit, and loss-weighted
decoding takes the language whose codeword costs least. The gap to the second gives a confidence; a small one flags ambiguity.
Classifiers are fitted on a bounded sample of labelled pages in rounds, each on the lines whose label the round before agrees
with, as labels may be wrong. Pages are read by their main body, passages and their segments each for themselves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from spindrift.llm import page_text as T
from spindrift.llm.encoding import LOST, repair
from spindrift.llm.pages import analysed, gathered
from spindrift.llm.templates import Decision, decided
from spindrift.sources.tables import latest_documents

LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "ru")
#: labelled pages of each language that the classifiers are fitted on at most, those of the smallest hashes; of each page
#: the passages and of each passage the characters that are fitted on at most. Only the fit is bounded so.
SAMPLE, SAMPLE_PASSAGES, SAMPLE_CHARS = 120, 24, 500
#: the languages in the order of votes; of equal votes the first wins
ORDER = tuple(sorted(LANGUAGES))
DIMENSIONS = 1 << 15
#: words of a passage that can be a case
MIN_WORDS = 5
#: rounds of fitting, and the confidence from which a round counts as agreeing with a label
ROUNDS, AGREED = 3, 0.8
#: a capitalised word is no name if it stands so often in one language, and this share of its places there
NOUN, OWN = 4, 0.9
#: a run of words is shared by several labels if the second most frequent has so many lines, this share of the first's, and so many
#: times the share that is usual for the first's runs: more than wrong labels bring
SHARED_LINES, SHARED, UNUSUAL = 3, 0.1, 2
#: a decision under this confidence is flagged as ambiguous; it is a case all the same
AMBIGUOUS = 0.95
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
LETTERS = re.compile(r"[^\W\d_]+")


def codewords() -> np.ndarray:
    """8 codewords of 15 bits as +1 and -1: rows of a Hadamard matrix of order 16 without its constant column. Any two differ
    in 8 bits, so three wrong classifiers are made good."""
    h = np.array([[1]])
    while len(h) < 16:
        h = np.block([[h, h], [h, -h]])
    return h[[1, 2, 4, 8, 3, 12, 7, 13], 1:]  # no column is constant, and no two are equal or opposite


CODE = codewords()


@lru_cache(1 << 16)
def ngrams(word: str) -> tuple[int, ...]:
    """Hashed features of a word in lower case: the word, its trigrams and its letters beyond ASCII."""
    padded = f"<{word}>"
    grams = {padded, *(padded[i : i + 3] for i in range(len(padded) - 2)), *(c for c in word if c > "\x7f")}
    return tuple(zlib.crc32(g.encode("utf-8", "replace")) % DIMENSIONS for g in sorted(grams))


def tokens(text: str) -> list[str]:
    """Words of a text without its web addresses, as written: a capital may begin a name. A text all in capitals is made small."""
    words = WORD.findall(T.URL.sub(" ", text) if "://" in text else text)
    return [w.lower() for w in words] if text.isupper() else words


def parted(samples: list[tuple[list[str], int]]) -> tuple[list[tuple[list[str], int]], list[tuple[list[str], set[int]]]]:
    """(the samples that tell of their label; the others, with the languages that they may be of instead of their label).

    The others are those of which a third of the words or more lie in runs of three words that several labels share: site lines
    of one language on pages of another, of which a site has the same on all of its pages. Their frequency under a label tells
    nothing, as it is that of the site. They may be of a language under whose label half of those runs stand at least.
    """
    runs = [list(zip(w, w[1:], w[2:])) for tok, _ in samples for w in [[x.lower() for x in tok]]]
    labels: dict[tuple[str, ...], Counter] = defaultdict(Counter)
    for own, (_, k) in zip(runs, samples, strict=True):
        for run in set(own):
            labels[run][k] += 1
    tops = {run: n.most_common(2) for run, n in labels.items()}
    shares: dict[int, list[float]] = defaultdict(list)
    for (k, most), *second in tops.values():
        shares[k].append(second[0][1] / most if second else 0.0)
    least = {k: max(SHARED, UNUSUAL * float(np.median(s))) for k, s in shares.items()}
    shared = {run for run, ((k, most), *second) in tops.items() if second and second[0][1] >= max(SHARED_LINES, least[k] * most)}
    alone, others = [], []
    for own, (tok, k) in zip(runs, samples, strict=True):
        at = [i for i, run in enumerate(own) if run in shared]
        if 3 * len({i + j for i in at for j in range(3)}) < len(tok) or not at:
            alone.append((tok, k))
        else:
            stands = Counter(x for i in at for x, n in labels[own[i]].items() if n >= SHARED_LINES)
            others.append((tok, {x for x, n in stands.items() if 2 * n >= len(at)}))
    return alone, others


class CodeClassifiers:
    """One linear n-gram classifier for each bit of the code (log ratios of smoothed frequencies)."""

    #: a word's margin in any bit is at most this, so that no one word outweighs the rest
    MOST = 2.0

    #: words whose margins a worker keeps; emptied when full
    KEPT = 1 << 17

    def __init__(self, weights: np.ndarray, known: frozenset[str]):
        self.weights, self.known = weights, known
        self.rows: dict[str, int] = {}
        self.margins = np.zeros((0, CODE.shape[1]), np.float32)

    @classmethod
    def counted(cls, samples: list[tuple[list[str], int]]) -> CodeClassifiers:
        """Of (tokens, number of the language): each language weighs the same, however many texts it has. Rare capitalised words,
        which may be names, are left out."""
        counts = np.zeros((len(LANGUAGES), DIMENSIONS))
        words, names = [Counter() for _ in LANGUAGES], [Counter() for _ in LANGUAGES]
        for tok, k in samples:
            for w in tok:
                (names if w[0].isupper() else words)[k][w.lower()] += 1
        every = sum(names, Counter())
        for k in range(len(LANGUAGES)):
            # of capitalised words only those seen small too, and those of one language alone: others may be names of sites
            noun = {w: n for w, n in names[k].items() if w in words[k] or (n >= NOUN and n >= OWN * every[w])}
            own = words[k] + Counter(noun)
            grams = [ngrams(w) for w in own]
            # a word said over and over in one sample weighs little more
            weight = np.repeat(np.log1p(np.fromiter(own.values(), float, len(own))), [len(g) for g in grams])
            counts[k] = np.bincount(np.fromiter((g for gs in grams for g in gs), int), weight, DIMENSIONS)
            words[k] |= own
        rate = (counts + 0.2) / (counts.sum(1, keepdims=True) + 0.2 * DIMENSIONS) if counts.any() else counts + 1
        seen, weights = counts.sum(0) > 1, np.zeros((DIMENSIONS, CODE.shape[1]))
        for b in range(CODE.shape[1]):
            plus, minus = rate[CODE[:, b] > 0], rate[CODE[:, b] < 0]
            weights[:, b] = np.where(seen, np.log(plus.max(0)) - np.log(minus.max(0)), 0.0)  # a bit is a union of languages
        return cls(weights.astype(np.float32), frozenset(w for c in words for w, n in c.items() if n >= 2))

    @classmethod
    def fit(cls, samples: list[tuple[str, str]]) -> CodeClassifiers:
        """Of (text, language), where languages may be wrong: after each round only the texts go on whose language the fit so far
        gives with confidence. The wrong ones are a minority in every language, so the first round outvotes them already. Texts
        that several labels share are not fitted on until the others have told their language."""
        kept, shared = parted([(tok, LANGUAGES.index(x)) for t, x in samples if (tok := tokens(t))])
        every, model = kept, cls.counted(kept)
        for _ in range(ROUNDS if every else 0):
            language, p = model.decided(model.summed([tok for tok, _ in every]))
            kept = [s for s, x, c in zip(every, language, p, strict=True) if x == s[1] and c >= AGREED]
            model = cls.counted(kept)
        language, p = model.decided(model.summed([tok for tok, _ in shared]))
        told = [(tok, int(x)) for (tok, may), x, c in zip(shared, language, p, strict=True) if x in may and c >= AGREED]
        return cls.counted(kept + told) if told else model

    def word(self, w: str, name: bool) -> np.ndarray:
        """Margins of one word. The word itself tells most, if it was seen; a capitalised one that was not may be a name."""
        grams = self.weights[list(ngrams(w))]
        whole = self.weights[zlib.crc32(f"<{w}>".encode("utf-8", "replace")) % DIMENSIONS]
        return np.clip(0.75 * whole + 0.5 * grams.mean(0) if w in self.known else grams.mean(0) * (0.05 if name else 0.25), -self.MOST, self.MOST)

    def row(self, token: str) -> int:
        """Place of a word's margins in the table."""
        k = self.rows.get(token)
        if k is None:
            k = self.rows[token] = len(self.rows)
            if k >= len(self.margins):
                self.margins = np.concatenate([self.margins, np.zeros((max(256, len(self.margins)), CODE.shape[1]), np.float32)])
            self.margins[k] = self.word(token.lower(), token[0].isupper())
        return k

    def summed(self, texts: list[list[str]]) -> np.ndarray:
        """Margins of texts given as tokens, a row for each."""
        out, row, get, start = np.zeros((len(texts), CODE.shape[1])), self.row, self.rows.get, 0
        ids: list[int] = []
        sizes: list[int] = []
        for i, tok in enumerate(texts):
            for at in range(0, max(1, len(tok)), self.KEPT // 2):
                part = tok[at : at + self.KEPT // 2]
                if len(ids) + len(part) > self.KEPT:
                    self._add(out, start, ids, sizes)
                    ids, sizes, start = [], [], i
                if len(self.rows) + len(part) > self.KEPT and not ids:
                    self.rows.clear()
                own = list(map(get, part))
                ids += map(row, part) if None in own else own
                if len(sizes) > i - start:  # a further part of the same text
                    sizes[-1] += len(part)
                else:
                    sizes.append(len(part))
        self._add(out, start, ids, sizes)
        return out

    def _add(self, out: np.ndarray, start: int, ids: list[int], sizes: list[int]) -> None:
        n = np.array(sizes, int)
        full = np.flatnonzero(n)
        if len(full):
            out[start + full] += np.add.reduceat(self.margins[ids], (np.cumsum(n) - n)[full], axis=0)

    @staticmethod
    def decided(margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, -1 for a text that tells nothing; confidence) of each row of margins."""
        language, p = np.full(len(margins), -1), np.zeros(len(margins))
        for at in range(0, len(margins), 4096):
            m = margins[at : at + 4096]
            size = np.abs(m)
            tells = size.max(1) > 1e-6
            loss = np.einsum("nlb,nb->nl", np.log1p(np.exp(-np.clip(CODE * m[:, None, :], -30, 30))), np.minimum(1.0, size)) / 2
            likely = np.exp(loss.min(1, keepdims=True) - loss)
            language[at : at + 4096] = np.where(tells, loss.argmin(1), -1)
            p[at : at + 4096] = np.where(tells, likely.max(1) / likely.sum(1), 0.0)
        return language, p

    def decode(self, text: str) -> tuple[str | None, float]:
        """(language, confidence); (None, 0) if the text has no word that tells anything."""
        language, p = self.decided(self.summed([tokens(text)]))
        return (LANGUAGES[language[0]], float(p[0])) if language[0] >= 0 else (None, 0.0)


def fit_classifiers(passages: DataFrame, index: DataFrame) -> CodeClassifiers:
    """Classifiers fitted on the labelled sample: for each language the SAMPLE pages of the smallest hashes whose label names
    it, and of each the first passages, line by line."""
    label = F.regexp_extract(F.lower(F.trim("html_lang")), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    pages = latest_documents(index).select(F.col("doc_id").cast("string").alias("doc_id"), label.alias("l"), F.xxhash64("doc_id").alias("h"))
    parts = [pages.filter(F.col("l") == x).orderBy("h", "doc_id").limit(SAMPLE) for x in LANGUAGES]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    rows = passages.filter((F.col("pos") < SAMPLE_PASSAGES) & (F.length("text") > 20)).select(F.col("doc_id").cast("string").alias("doc_id"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    rows = rows.join(F.broadcast(chosen.select("doc_id", "l")), "doc_id")  # at most SAMPLE pages of each language
    return CodeClassifiers.fit([(t, r["l"]) for r in rows.distinct().orderBy("l", "doc_id", "text").collect() for t in repair(r["text"])[0].split("\n")])


def declared(html_lang: str | None) -> str | None:
    """The language that a label names, region and letter case ignored; None if it names none."""
    m = re.match(r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", html_lang or "")
    code = m.group(1).lower() if m else None
    return None if code in ("und", "mul", "zxx", "mis") else code


#: words of a text with lost characters, and those of which nothing is left
LOST_WORD = re.compile(f"(?:[^\\W\\d_]|{LOST})+")


def all_lost(text: str) -> list[str]:
    """The words of which nothing is left, if they are the most: then they were of the one language without Latin letters."""
    words = LOST_WORD.findall(text) if LOST in text else []
    gone = [w for w in words if w.strip(LOST) == ""]
    return gone if sum(len(w) > 1 for w in gone) > len(words) - len(gone) else []


def n_words(text: str) -> int:
    """Runs of letters, without web addresses; a lost character within a word is a letter."""
    text = T.URL.sub(" ", text) if "://" in text else text
    if LOST not in text:
        return len(LETTERS.findall(text))
    return len(all_lost(text)) + sum(w.strip(LOST) != "" for w in LOST_WORD.findall(text))


def _russian(text: str) -> bool:
    """Whether most words of a text are lost: those were Russian, as only their letters all lie beyond ASCII."""
    return LOST in text and bool(all_lost(text))


def read(text: str, model: CodeClassifiers) -> tuple[str | None, float]:
    """:meth:`CodeClassifiers.decode`, also of a text of which most words are lost."""
    return ("ru", 1.0) if _russian(text) else model.decode(text)


def read_all(lines: list[str], passages: list[tuple[str, int]], model: CodeClassifiers) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the language, confidence, words) of each line, and of each passage, given as its text and the number of its
    lines."""
    cut = [tokens(x) for x in lines]
    margins = model.summed(cut)
    words = np.array([len(w) if "'" not in x and "’" not in x and LOST not in x else n_words(x) for w, x in zip(cut, lines, strict=True)], int)
    of = np.repeat(np.arange(len(passages)), [n for _, n in passages])
    sums = np.zeros((len(passages), CODE.shape[1]))
    np.add.at(sums, of, margins)
    out = []
    for texts, (language, p), n in ((lines, model.decided(margins), words), ([t for t, _ in passages], model.decided(sums), np.bincount(of, words, len(passages)).astype(int))):
        for i, t in enumerate(texts):
            if LOST in t:
                n[i] = n_words(t)
                if _russian(t):
                    language[i], p[i] = LANGUAGES.index("ru"), 1.0
        out.append((language, p, n))
    return out


def segments(text: str, model: CodeClassifiers) -> list[dict] | None:
    """The sentences of a text with their languages, if they are of more than one for certain."""
    parts = [(s, *model.decode(s)) for line in text.split("\n") for s in T.SENTENCE.split(line) if s.strip()]
    mixed = len({x for _, x, c in parts if x and c >= AMBIGUOUS}) > 1
    return [{"segment": s, "lang": x, "confidence": c} for s, x, c in parts] if mixed else None


SEGMENTS = "array<struct<segment:string,lang:string,confidence:double>>"
READ = "l_lang array<int>, l_conf array<float>, l_n array<int>, s_lang array<int>, s_conf array<float>, s_n array<int>"
COLUMNS = ["doc_id", "chunk", "listed", "html_lang", *(c.split()[0] for c in READ.split(", "))]
OUT = f"doc_id string, chunk long, listed boolean, label string, votes array<double>, total double, rest array<double>, rest_total double, pos array<int>, lang array<int>, confidence array<float>, words array<int>, segments array<{SEGMENTS}>"


def _lists(values: np.ndarray, sizes: list[int], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, kind))


def read_pages(passages: DataFrame, index: DataFrame, mixed: bool) -> DataFrame:
    """``doc_id, own, share, first, listed, label, read``: a row for each chunk of a page; ``own`` and ``share``, its language
    and that one's share of the votes, are those of the whole page, whose chunks' votes are summed. ``first`` marks one chunk of
    each page. ``read`` has the passages with text, with their segments only if ``mixed``."""
    model = fit_classifiers(passages, index)
    shared = passages.sparkSession.sparkContext.broadcast((model.weights, model.known))  # as large as the code and SAMPLE make it
    kept: list[CodeClassifiers] = []  # that of a worker

    def columns(pages: list[list[tuple[int, str, str | None]]], lines: list[list[str]]) -> list[pa.Array]:
        if not kept:
            kept.append(CodeClassifiers(*shared.value))
        each = [(text, n) for page in pages for _, text, _ in page if (n := len(T.lines(text)))]
        flat = [x for own in lines for x in own]
        of_line, of_passage = read_all(flat, each, kept[0])
        n_lines, n_passages = [len(x) for x in lines], [sum(bool(T.lines(t)) for _, t, _ in page) for page in pages]
        out = [_lists(v, sizes, kind) for of, sizes in ((of_line, n_lines), (of_passage, n_passages)) for v, kind in zip(of, (pa.int32(), pa.float32(), pa.int32()), strict=True)]
        if mixed:
            rows, at = [], 0
            for n in n_passages:
                rows.append([segments(t, kept[0]) for t, _ in each[at : at + n]])
                at += n
            kind = pa.struct([("segment", pa.string()), ("lang", pa.string()), ("confidence", pa.float64())])
            out.append(pa.array(rows, pa.list_(pa.list_(kind))))
        return out

    def finish(d: Decision) -> list[pa.Array]:
        language, p, n = (d.values(c) for c in ("l_lang", "l_conf", "l_n"))
        tells = language >= 0

        def votes(of: np.ndarray) -> tuple[pa.Array, pa.Array]:
            by = [d.sums(n * p, of & (language == LANGUAGES.index(x))) for x in ORDER]
            return pa.array(np.stack(by, 1).tolist(), pa.list_(pa.float64())), pa.array(d.sums(n, of & tells), pa.float64())

        col = lambda c: d.pages.column(c).combine_chunks()
        labels = pa.array([declared(x) for x in col("html_lang").to_pylist()], pa.string())
        pos = d.listed(d.pos[d.passage], np.ones(len(d.passage), bool), pa.int32())
        found = [col("s_lang"), col("s_conf"), col("s_n"), col("segments") if mixed else pa.nulls(d.pages.num_rows, arrow_segments)]
        return [col("doc_id"), col("chunk"), col("listed"), labels, *votes(d.kept), *votes(np.ones(len(n), bool)), pos, *found]

    arrow_segments = to_arrow_schema(_parse_datatype_string(f"s array<{SEGMENTS}>")).field(0).type
    extra = (READ + (f", segments array<{SEGMENTS}>" if mixed else ""), columns)
    rows = decided(analysed(gathered(passages, index), extra), COLUMNS + ["segments"] * mixed, finish, OUT)
    page = Window.partitionBy("doc_id")
    summed = lambda c: F.array(*[F.sum(F.get(c, F.lit(k))).over(page) for k in range(len(ORDER))])
    rows = rows.withColumns(
        {"votes": summed("votes"), "rest": summed("rest"), "total": F.sum("total").over(page), "rest_total": F.sum("rest_total").over(page), "first": F.col("chunk") == F.min("chunk").over(page)}
        | {"listed": F.max("listed").over(page), "label": F.max("label").over(page)}
    )
    rows = rows.withColumns({"votes": F.when(F.col("total") > 0, F.col("votes")).otherwise(F.col("rest")), "total": F.when(F.col("total") > 0, F.col("total")).otherwise(F.col("rest_total"))})
    most = F.array_max("votes")
    own = F.when(F.col("total") > 0, F.get(F.array(*map(F.lit, ORDER)), F.array_position("votes", most).cast("int") - 1))
    name = F.transform("lang", lambda k: F.get(F.array(*map(F.lit, LANGUAGES)), k))
    zipped = F.arrays_zip("pos", name.alias("lang"), F.col("confidence").cast("array<double>").alias("confidence"), "words", F.coalesce("segments", F.expr(f"cast(array() as array<{SEGMENTS}>)")).alias("segments"))
    return rows.select("doc_id", own.alias("own"), F.when(F.col("total") > 0, most / F.col("total")).otherwise(0.0).alias("share"), "first", "listed", "label", zipped.alias("read"))


def languages(passages: DataFrame, index: DataFrame) -> DataFrame:
    """``doc_id, pos, lang, confidence, page_lang, words, segments, ambiguous``: one row for each page, with ``pos`` -1 and the
    language of its main body, and one for each passage with text; ``segments`` has the sentences of a passage that mixes
    languages, ``ambiguous`` flags a decision under ``AMBIGUOUS``.

    Null and empty passages have no row; a text that tells nothing has a null language and confidence 0. Repeated passages
    count once, empty tables give no rows, extra columns are ignored. A garbled passage is read as it was written.
    """
    rows = read_pages(passages, index, True)
    fields = ["pos", "lang", "confidence", "words", "segments"]
    page = rows.filter("first").select("doc_id", F.lit(-1).alias("pos"), F.col("own").alias("lang"), F.col("share").alias("confidence"), F.lit(0).alias("words"), F.lit(None).alias("segments"), F.col("own").alias("page_lang"))
    each = rows.select("doc_id", "own", F.explode("read").alias("r")).select("doc_id", *[f"r.{c}" for c in fields], F.col("own").alias("page_lang"))
    return each.unionByName(page).select("doc_id", "pos", "lang", "confidence", "page_lang", "words", "segments", (F.col("confidence") < AMBIGUOUS).alias("ambiguous"))


def found(passages: DataFrame, index: DataFrame) -> DataFrame:
    """``doc_id, pos, lang``: pages (pos -1) whose label is null, no language or another than that of the main body, and
    passages of five words or more in another language than it, ambiguous ones too. The main body is the whole page's; a page without a row in the
    index has no label to judge."""
    rows = read_pages(passages, index, False).filter("own is not null")
    page = F.when(F.col("first") & F.col("listed") & ~F.col("own").eqNullSafe(F.col("label")), F.array(F.struct(F.lit(-1).alias("pos"), F.col("own").alias("lang"))))
    case = lambda r: (r["lang"] != F.col("own")) & (r["words"] >= MIN_WORDS)
    cases = F.transform(F.filter("read", case), lambda r: F.struct(r["pos"].alias("pos"), r["lang"].alias("lang")))
    return rows.select("doc_id", F.explode(F.concat(F.coalesce(page, F.array().cast("array<struct<pos:int,lang:string>>")), cases)).alias("x")).select("doc_id", "x.pos", "x.lang")
