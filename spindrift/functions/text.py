"""Tokenising and text scalar functions (OP-20 to OP-29) as Column expressions; no Python in the path of a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the original engine's for the same results.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was were will with this but they have had "
    "what when where who which why how all any both each few more most other some such no nor not only own same so than too very"
).split()
STEP_1A = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
STEP_1B = {"eed": "ee", "ed": "", "ing": ""}
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), "")
#: (rules, the measure of what is left must be above this)
STEPS = ((STEP_1A, -1), (STEP_1B, 0), (STEP_2, 0), (STEP_3, 0), (STEP_4, 1))
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4 = rf"\b{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}\b"
URL = r"https?://[a-zA-Z0-9.-]+(?:\.[a-zA-Z]{2,})+/?[^\t\n\f\r ]*"
# End of fixed values.

MARK = "\x01"
ENTITY = f"({URL}|{IPV4})"
PIECE = rf"{MARK}[^{MARK}]*{MARK}|[A-Za-z]+|\p{{Nd}}+|[\p{{P}}\p{{S}}]+"
MAX_TERM_BYTES = 64


def tokens(text: Column) -> Column:
    """OP-20 to OP-23: ``array<struct<type, value>>`` of the words, numbers, signs and entities of a text.

    Entities are taken first, leftmost and longest; the rest is lower-cased and cut into runs of one class. Null gives null.
    """
    clean = F.replace(text, F.lit(MARK), F.lit(""))
    pieces = F.regexp_extract_all(F.regexp_replace(clean, ENTITY, f"{MARK}$1{MARK}"), F.lit(PIECE), F.lit(0))

    def token(p: Column) -> Column:
        inner = F.replace(p, F.lit(MARK), F.lit(""))
        entity = F.startswith(p, F.lit(MARK))
        kind = (
            F.when(entity & F.startswith(inner, F.lit("http")), "URL_ADDR")
            .when(entity, "IP_V4_ADDR")
            .when(p.rlike("^[A-Za-z]"), "WORD")
            .when(p.rlike(r"^\p{Nd}"), "NUMBER")
            .otherwise("SYMBOL")
        )
        return F.struct(kind.alias("type"), F.when(entity, inner).otherwise(F.lower(inner)).alias("value"))

    email = F.array(F.struct(F.lit("EMAIL_ADDR").alias("type"), clean.alias("value")))
    return F.when(clean.rlike(EMAIL.replace("$", r"\z")) & ~clean.rlike("^" + IPV4), email).otherwise(F.transform(pieces, token))


def measure(word: Column) -> Column:
    """OP-26: steps from a vowel of ``aeiou`` to another letter."""
    return F.regexp_count(word, F.lit("[aeiou][^aeiou]"))


def _step(rules: dict[str, str], above: int):
    """One step: of the suffixes whose rest measures enough, the longest is replaced.

    Most words end in none of them, which their last letters tell in one look-up."""
    ordered = sorted(rules.items(), key=lambda r: -len(r[0]))
    n = min(len(s) for s in rules)
    ends = sorted({s[-n:] for s in rules})
    table = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(r).alias("r"), F.lit(len(s)).alias("n")) for s, r in ordered])

    def run(w: Column) -> Column:
        rest = lambda r: F.left(w, F.length(w) - r["n"])
        hit = F.get(F.filter(table, lambda r: F.endswith(w, r["s"]) & (measure(rest(r)) > above)), 0)
        changed = F.get(F.transform(F.array(hit), lambda r: F.coalesce(F.concat(rest(r), r["r"]), w)), 0)
        return F.when(F.right(w, F.lit(n)).isin(ends), changed).otherwise(w)

    return run


_STEPS = tuple((rules, above) for rules, above in STEPS)


def stem(word: Column) -> Column:
    """OP-27: the stem of a word in lower case; words of two letters or less stay, longest suffix first in each step."""
    out = word
    for rules, above in _STEPS:
        # the lambda's variable holds the last step's word, so that it is worked out once
        out = F.get(F.transform(F.array(out), _step(rules, above)), 0)
    return F.when(F.length(word) <= 2, word).otherwise(out)


def words(tokens: Column) -> Column:
    """OP-24: the words of a token array, unstemmed and without stop words."""
    kept = F.filter(tokens, lambda t: (t["type"] == "WORD") & ~t["value"].isin(STOP_WORDS))
    return F.transform(kept, lambda t: t["value"])


def terms(tokens: Column) -> Column:
    """OP-24: index terms: stems of the words, numbers, signs and entities; those over 64 bytes are left out."""
    kept = F.filter(tokens, lambda t: (t["type"] != "WORD") | ~t["value"].isin(STOP_WORDS))
    out = F.transform(kept, lambda t: F.when(t["type"] == "WORD", stem(t["value"])).otherwise(t["value"]))
    return F.filter(out, lambda t: F.octet_length(t) <= MAX_TERM_BYTES)


def shingles(words: Column, n: int = 4) -> Column:
    """OP-34: runs of n words joined by a space; none for fewer words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def letter_trigrams(word: Column) -> Column:
    """OP-39: the distinct runs of three letters of a word."""
    starts = F.when(F.length(word) >= 3, F.sequence(F.lit(1), F.length(word) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(word, i, F.lit(3))))
