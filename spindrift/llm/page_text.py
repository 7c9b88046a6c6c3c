"""Lines, elements and clause structure of page text; pure Python over single lines and passages.

Most lines lack most of what the patterns look for, so a look at single characters comes before each of the dearer ones."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import xxhash

from spindrift.llm.encoding import LOST, repair

WORD = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"\d+")
#: what stands between the entries of a menu or a breadcrumb
SEPARATOR = re.compile(r"\s*(?:[|·>»•]|\s[/–]\s|\s�+\s|\s{2,})\s*")
SEPARATES = re.compile(r"[|·>»•/–�]|\s\s")
SENTENCE = re.compile(r"(?<=[.!?…])[\"”»’)]*\s+")
LABEL = re.compile(r"^\s*([^:–.!?]{2,30}?)\s*(?::|\s[–-])\s")
LABELS = re.compile(r"[:–-]\s")
#: an end that titles have in lists of other pages: a date, a number in brackets, a cut, an arrow, a word after the last stop
TAIL = re.compile(r"(\(\d+\)|[–-]\s?\d{1,2}\.\d{1,2}\.\d{4}|(?<![.!?])\s…|→|(?<=[.!?])\s+[^\W\d_][^.!?]{2,20})$")
ENDS = re.compile(r"[.!?…][\"”»’)\]]*(?:\s*[(\[][^()\[\]]{0,40}[)\]])?\s*$")
NUMBERED = re.compile(r"^\s*\d+[.)]\s+")
URL = re.compile(r"https?://\S+")
BEYOND = re.compile("[^\x00-\x7f]+")
SIGNS = re.compile(r"[\W_]+")
SOLID = re.compile(r"[^\W_]")
STOP_WITHIN = re.compile(r"[.!?]\s")
#: words of a clause at least
CLAUSE_WORDS = 4
#: words of a heading that is a title; a longer one is text
TITLE_WORDS = 16


def key(line: str) -> str:
    """A line in lower case, without white space, each run of digits one 0."""
    return "".join(DIGITS.sub("0", line.lower()).split())


def lossy(line: str) -> str | None:
    """What is the same of a line and of the line with its characters beyond ASCII lost: the rest of it, or if that is little,
    the lengths of what was lost, word by word (a lost character leaves one mark, or two where it had two bytes)."""
    rest = BEYOND.sub("", key(line))
    if sum(c.isalpha() for c in rest) >= 8:
        return rest
    runs = [len(r) for r in BEYOND.findall(line)]
    if len(runs) < 2:
        return None
    half = 2 if LOST in line and all(n % 2 == 0 for n in runs) else 1
    return " ".join(BEYOND.sub(lambda m: f"<{len(m.group()) // half}>", DIGITS.sub("0", line.lower())).split())


def hashed(kind: str, text: str) -> int:
    return xxhash.xxh64_intdigest(kind + text) - (1 << 63)


def lines(repaired: str) -> list[str]:
    """Lines of a repaired passage, without blank ones."""
    return [s for line in repaired.split("\n") if (s := line.strip())]


def ends(line: str) -> bool:
    """Whether a line ends with a stop, closing marks and a short bracket after it included."""
    return bool(line) and (line[-1] in ".!?…" or (not line[-1].isalnum() and ENDS.search(line) is not None))


def parts_of(sentences: list[str]) -> list[str]:
    out = []
    for s in sentences:
        out += [p for p in SEPARATOR.split(s) if SOLID.search(p)] if SEPARATES.search(s) else [s] if SOLID.search(s) else []
    return out


def parts(line: str) -> tuple[str, ...]:
    """The smallest elements of a line: sentences, and the entries of a list with separators."""
    return tuple(parts_of(SENTENCE.split(line)))


#: what :func:`line_of` tells of a line by single bits; the last two are of the passage it stands in
IS_SENTENCE, IS_TITLE, HAS_END, IS_LOST, TAIL_IS_CUT, IN_HEADING, IS_PAGE_TITLE = (1 << k for k in range(7))
#: the hash of a line as a heading is that of the whole line with these bits turned
HEADING = 0x5DEECE66D


class Line(NamedTuple):
    """Hashes of a line's elements, 0 for none: the line, its label, its end, the line without losses, and its parts with their
    letters; ``flags``; ``sentences`` of (characters, whether it has a clause's structure, its words)."""

    whole: int
    label: int
    tail: int
    lossy: int
    parts: tuple[tuple[int, int], ...]
    flags: int
    sentences: tuple[tuple[int, bool, tuple[str | None, ...]], ...]


@lru_cache(1 << 12)
def line_of(line: str) -> Line:
    k = key(line)
    cut = SENTENCE.split(line)
    label = LABEL.search(line) if LABELS.search(line, 0, 40) else None
    tail = TAIL.search(line) if line[-1] not in ".!?" else None
    lossy_key = None if line.isascii() else lossy(line)
    own = [line] if len(cut) == 1 and not SEPARATES.search(line) else parts_of(cut)
    each = tuple((hashed("S", x), len(x)) for p in own if (x := k if p is line else key(p)))
    lost, end = LOST in line, ends(line)
    bits = IS_SENTENCE * is_sentence(line) | IS_TITLE * title_like(line) | HAS_END * end | IS_LOST * lost
    if tail and end and tail.group(1).strip() == "…" and not title_cut(line):
        bits |= TAIL_IS_CUT
    return Line(
        whole=hashed("L", k),
        label=hashed("P", key(label.group(1))) if label else 0,
        tail=hashed("E", key(tail.group(1))) if tail else 0,
        lossy=0 if lossy_key is None else hashed("X", lossy_key),
        parts=each if SOLID.search(k) else (),
        flags=bits,
        sentences=tuple(clause(s) for s in cut),
    )


def clause(sentence: str) -> tuple[int, bool, tuple[str | None, ...]]:
    """(characters, whether it has a clause's structure: four words or more and a stop; its words in lower case without signs
    and without web addresses, None for one of which nothing is left)."""
    words = (URL.sub(" ", sentence) if "://" in sentence else sentence).lower().split()
    n = len(words) if len(words) > 9 else sum(not w.isnumeric() and (LOST in w or SOLID.search(w) is not None) for w in words)
    bare = [w if w.isalnum() else SIGNS.sub("", w) or (None if LOST in w else w) for w in words]
    return len(sentence), n >= CLAUSE_WORDS and ends(sentence), tuple(bare)


def is_sentence(line: str) -> bool:
    """Whether a line holds a sentence: four words or more, and a full stop at its end or within."""
    line = NUMBERED.sub("", line) if line[:1].isdigit() else line
    return (ends(line) or STOP_WITHIN.search(line) is not None) and len(WORD.findall(line)) >= 4


def title_cut(line: str) -> bool:
    """Whether a line ends as a title that was cut: a mark of omission after a space and no sentence before it."""
    return line.endswith(" …") and not re.search(r"[.!?]", line)


def title_like(line: str) -> bool:
    """A line without a sentence's end."""
    title = line.removesuffix("…").rstrip()
    return 2 <= len(WORD.findall(title)) <= 25 and not is_sentence(title)
