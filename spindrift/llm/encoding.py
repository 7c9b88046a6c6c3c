"""Problem 6: text garbled by a wrong character encoding.

The characters of a text are mapped back to the bytes of a legacy code page, a byte automaton for UTF-8 finds the maximal
well-formed multibyte spans, and only those spans are decoded; doubled errors take another round. Cyrillic words of a
single-byte code page shown in another are told by their letters. Replacement characters mark what is lost.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: code pages a text may have been shown in, those most used first
PAGES = ("cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r", "cp866", "iso8859_15", "cp1250")
#: rounds of decoding for doubled errors
ROUNDS = 4
LOST = "�"


@lru_cache(None)
def byte_map(page: str) -> dict[str, int]:
    """{character: byte} of the upper half; C1 controls stand for bytes that the page leaves undefined."""
    out = {}
    for b in range(128, 256):
        c = codecs.decode(bytes([b]), page, "replace")
        out[chr(b) if c == LOST else c] = b
    for b in range(128, 160):
        out.setdefault(chr(b), b)
    return out


@lru_cache(None)
def tables(page: str) -> tuple[str, re.Pattern]:
    """The automaton of well-formed multibyte UTF-8 over the characters of a page, as a compiled pattern.

    States follow the Unicode table of well-formed byte sequences: no overlong forms, surrogates or values over 10FFFF.
    """
    m: dict[int, set[str]] = {}
    for c, b in byte_map(page).items():
        m.setdefault(b, set()).add(c)
    cls = lambda lo, hi: "[" + "".join(re.escape(c) for b in range(lo, hi + 1) for c in sorted(m.get(b, ()))) + "]" if any(b in m for b in range(lo, hi + 1)) else r"(?!)"
    t = cls(0x80, 0xBF)
    one = "|".join([
        f"{cls(0xC2, 0xDF)}{t}",
        f"{cls(0xE0, 0xE0)}{cls(0xA0, 0xBF)}{t}",
        f"(?:{cls(0xE1, 0xEC)}|{cls(0xEE, 0xEF)}){t}{t}",
        f"{cls(0xED, 0xED)}{cls(0x80, 0x9F)}{t}",
        f"{cls(0xF0, 0xF0)}{cls(0x90, 0xBF)}{t}{t}",
        f"{cls(0xF1, 0xF3)}{t}{t}{t}",
        f"{cls(0xF4, 0xF4)}{cls(0x80, 0x8F)}{t}{t}",
    ])
    return page, re.compile(f"(?:{one})+")


#: two characters beyond ASCII side by side, overlapping ones too
SIDE_BY_SIDE = re.compile("(?=([^\x00-\x7f]{2}))")


@lru_cache(1 << 16)
def pages_of(pair: str) -> frozenset[str]:
    """The code pages in which two characters may begin a multibyte span: a lead byte and one that continues it."""
    byte = lambda page, c: byte_map(page).get(c, 0)
    return frozenset(page for page in PAGES if 0xC2 <= byte(page, pair[0]) <= 0xF4 and 0x80 <= byte(page, pair[1]) <= 0xBF)


#: closing marks that may rightly follow a letter which reads as a lead byte
CLOSING = set("»”’›“\"'…–—")


RUSSIAN = set("абвгдеёжзийклмнопрстуфхцчшщъыьэюяАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x180:
        return "latin"
    if 0x400 <= o < 0x460 or o in (0x490, 0x491):
        return "cyrillic"
    if 0x2000 <= o < 0x2C00 or o in (0xFEFF, 0xFB01, 0xFB02) or c in page_signs():
        return "sign"
    return "other"


@lru_cache(None)
def page_signs() -> frozenset[str]:
    """All characters of the code pages: what a text garbled more than once decodes to at first."""
    return frozenset(c for page in PAGES for c in byte_map(page))


#: how far a well-formed span is garbled text: not at all, if the rest of the text is, for certain
NO, WEAK, SURE = 0, 1, 2


def _belief(span: str, decoded: str, before: str, after: str) -> int:
    """Whether a well-formed span is garbled text and not letters and signs that happen to look like it."""
    if any(unicodedata.category(c) in ("Cn", "Cc", "Co") and not 0x80 <= ord(c) < 0xA0 for c in decoded):
        return NO
    scripts = [_script(c) for c in decoded]
    own = all(c in RUSSIAN for c in before + after if c.isalpha()) and any(c.isalpha() for c in before + after)
    if "other" in scripts:
        # other scripts: only a long run of one that begins with no letter of the text's own
        return SURE if len(decoded) >= 4 and scripts.count("other") == len(decoded) and not set(span) <= RUSSIAN else NO
    if set(span) <= RUSSIAN:
        if before.isascii() and before.isalpha() and scripts == ["latin"]:
            return SURE  # within a Latin word
        if scripts in (["latin"], ["sign"]) and not decoded.isalpha():
            return WEAK
        return WEAK if len(decoded) == 1 and not (before + after).strip() else NO
    if span[0] in RUSSIAN and own and len(decoded) < 3:
        return NO
    if "cyrillic" in scripts:
        real = sum(c in RUSSIAN for c in decoded)
        if real < len(decoded) - scripts.count("sign") - scripts.count("latin"):
            return WEAK if real >= 3 else NO
        if len(decoded) >= 3:
            return SURE
        return NO if span[-1] in CLOSING and (before + after).strip() else WEAK if len(decoded) == 1 else SURE
    if len(decoded) == 1 and span[-1] in CLOSING and (before.isupper() or (span[0] not in "ÃÂ" and before.isalpha())):
        return NO  # a capital before a closing mark, as in a word of capitals at the end of a quotation
    return SURE


def _spans(text: str, page: str) -> list[tuple[int, int, str]]:
    """Maximal well-formed spans of a page that are garbled text, with what they decode to."""
    sure, out = False, []
    m = byte_map(page)
    for hit in tables(page)[1].finditer(text):
        a, b = hit.span()
        decoded = bytes(m[c] for c in hit.group()).decode("utf-8")
        belief = _belief(hit.group(), decoded, text[max(0, a - 1) : a], text[b : b + 1])
        sure |= belief == SURE
        if belief:
            out.append((a, b, decoded))
    return out if sure or (out and len(out[0][2]) == 1 and not set(text[: out[0][0]] + text[out[0][1] :]) - set(" \t\n.,()0123456789")) else []


#: runs of letters in the upper half of Latin-1, with the signs that the Cyrillic pages have there
HIGH_WORD = re.compile("[À-ÿ¨¸¹¿¡]{3,}")
LATIN_HIGH = re.compile("[À-ÿ¨¸¹]+")
#: Cyrillic words of which small letters come before capitals, as of KOI8-R read as cp1251 or the reverse
SWAPPED = re.compile("(?<![А-яЁё])[а-яё][А-ЯЁЀ-Џ]{2,}(?![а-яё])|(?<![А-яЁё])[а-яё]+[А-ЯЁЀ-Џ]{3,}")


def _vowels(word: str) -> bool:
    return any(c in "аеёиоуыэюя" for c in word.lower())


def _cyrillic_words(text: str) -> list[tuple[int, int, str]]:
    """Cyrillic of one single-byte page shown as Latin-1 or cp1252: words only of accented letters."""
    seeds = [m for m in HIGH_WORD.finditer(text) if not re.search("[A-Za-z]", text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]) and len(set(m.group())) > 1]
    if not seeds:
        return []
    sample = "".join(m.group() for m in seeds)
    best = None
    for page in ("cp1251", "koi8_r", "iso8859_5"):
        try:
            read = sample.encode("latin-1").decode(page)
        except UnicodeError:
            continue
        # small letters outnumber capitals, and common letters the rare ones
        score = sum(c in "оеаинтсрвл" for c in read.lower()) - 2 * sum(c.isupper() for c in read) + sum(c.islower() for c in read)
        if set(read) <= RUSSIAN and (best is None or score > best[0]):
            best = (score, page)
    if best is None:
        return []
    out = []
    for m in LATIN_HIGH.finditer(text):
        around = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
        near = text[max(0, m.start() - 12) : m.start()] + text[m.end() : m.end() + 12]
        if not re.search("[A-Za-z]", around) and (len(m.group()) > 1 or LATIN_HIGH.search(near)):
            try:
                out.append((m.start(), m.end(), m.group().encode("latin-1").decode(best[1])))
            except UnicodeError:
                continue
    return out


def _swapped_words(text: str) -> list[tuple[int, int, str]]:
    """KOI8-R shown as cp1251 or the reverse: the case of every letter is turned about."""
    hits = [m for m in SWAPPED.finditer(text)]
    if not hits:
        return []
    out = []
    for m in re.finditer(r"[^\W\d_a-zA-Zљї]+", text):  # those two are a space and a sign of the other page
        for a, b in (("cp1251", "koi8_r"), ("koi8_r", "cp1251")):
            try:
                read = m.group().encode(a).decode(b)
            except UnicodeError:
                continue
            if set(read) <= RUSSIAN and (read.islower() or read.istitle()) and (len(read) < 3 or _vowels(read)):
                out.append((m.start(), m.end(), read))
                break
    return out if len(out) * 2 >= len(hits) else []


#: one Cyrillic letter within a Latin word, or one accented capital within small letters: a Latin letter of another page
MIXED = re.compile("(?<=[a-z])[А-яЁёЂ-џ](?=[a-z])")


def _mixed_letters(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in MIXED.finditer(text):
        try:
            read = m.group().encode("cp1251").decode("cp1252")
        except UnicodeError:
            continue
        if read.isalpha():
            out.append((m.start(), m.end(), read))
    return out


SUSPECT = re.compile(r"[^\x00-\x7f]")
#: two characters beyond ASCII side by side, of which one is no Russian letter, no matter where
PAIR = re.compile("(?=[^\x00-\x7f]{2})(?:[^А-яЁё]|[А-яЁё][^\x00-\x7fА-яЁё]|(?<=[a-zA-Z])[А-яЁё]{2})")


def clean_at_sight(text: str) -> bool:
    """Whether nothing in a text can be garbled: no character beyond ASCII, or none beside another but Russian letters."""
    if not SUSPECT.search(text):
        return True
    return not PAIR.search(text) and LOST not in text and not SWAPPED.search(text) and not MIXED.search(text)


def repair(text: str | None) -> tuple[str | None, bool, bool]:
    """(text with the garbled spans decoded, whether any span was garbled, whether something stays lost)."""
    if not text or clean_at_sight(text):
        return text, False, False
    garbled = False
    for _ in range(ROUNDS):
        best: list[tuple[int, int, str]] = []
        taken = 0
        possible = frozenset().union(*map(pages_of, set(SIDE_BY_SIDE.findall(text))))
        for page in PAGES:
            if page not in possible:
                continue
            spans = _spans(text, page)
            covered = sum(b - a for a, b, _ in spans)
            if covered > taken:
                best, taken = spans, covered
        words = _cyrillic_words(text)
        if sum(b - a for a, b, _ in words) > taken:
            best = words
        best = best or _swapped_words(text) or _mixed_letters(text)
        if not best:
            break
        garbled, parts, at = True, [], 0
        for a, b, decoded in best:
            parts += [text[at:a], decoded]
            at = b
        text = "".join(parts) + text[at:]
    lost = LOST in text
    return text, garbled or lost, lost


SCHEMA = "doc_id string, pos int, text string, restored string, garbled boolean, lost boolean"


def repaired(passages: DataFrame) -> DataFrame:
    """``doc_id, pos, text, restored, garbled, lost`` of every passage; one pass without a shuffle.

    Null and empty texts are never garbled and stay as they are. Repeated rows come out repeated; an empty table gives no
    rows; extra columns are ignored; long texts are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [repair(t.as_py()) for t in b.column(2)]
            r, g, lost = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(r, pa.string()), pa.array(g, pa.bool_()), pa.array(lost, pa.bool_())], names=["doc_id", "pos", "text", "restored", "garbled", "lost"])

    return passages.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("pos").cast("int").alias("pos"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def found(passages: DataFrame) -> DataFrame:
    return repaired(passages).filter("garbled").select("doc_id", "pos").distinct()
