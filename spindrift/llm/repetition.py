"""Problem 10: repetition inside a single document.

A linear-chain conditional random field labels each segment of a document (a line, cut further into sentences) as content or
boilerplate by Viterbi decoding; the share of words in content decides retention. The field is fitted on a bounded sample of
segments labelled by the exact rule. The cases of the problem are stated by that rule itself, the share of words within runs of
four words that occurred earlier in the text: it decides them, among the documents of which the field or the rule marks a segment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
SEGMENT = re.compile(r"\n+|(?<=[.!?…。])\s+")
RUN = 4
MIN_WORDS = 20
MIN_SHARE = 0.4
#: documents the field is fitted on at most; they are those of the smallest hashes
SAMPLE = 600
#: only texts of up to so many characters are fitted on; all are measured whole
SAMPLE_CHARS = 20_000
#: segments of a text that are fitted on
SAMPLE_SEGMENTS = 200
#: a document is kept for training if this share of its words is content
RETAIN = 0.6
CONTENT, BOILER = 0, 1
FEATURES = 7


def repeated(words: list[str]) -> np.ndarray:
    """For each word whether it lies in a run of four words that already occurred earlier; runs may overlap."""
    out, seen = np.zeros(len(words), bool), set()
    for i, run in enumerate(zip(words, words[1:], words[2:], words[3:], strict=False)):
        if run in seen:
            out[i : i + RUN] = True
        else:
            seen.add(run)
    return out


def segments(text: str) -> list[list[str]]:
    """Words of each segment, in lower case; segments without words are left out."""
    return [w for part in SEGMENT.split(text.lower()) if (w := WORD.findall(part))]


def features(parts: list[list[str]], again: np.ndarray) -> np.ndarray:
    """Of each segment: bias, share of repeated words, the same squared, whether the whole segment occurred before, share of
    distinct words, share of words that the segment before has, length."""
    sizes = np.array([len(w) for w in parts])
    share = np.add.reduceat(again.astype(float), np.cumsum(sizes) - sizes) / sizes
    rest, before, last = [], set(), set()
    for w in parts:
        own, key = set(w), tuple(w)
        rest.append((key in before, len(own) / len(w), len(own & last) / len(own)))
        before.add(key)
        last = own
    return np.column_stack([np.ones(len(parts)), share, share * share, np.array(rest, float), np.minimum(1.0, sizes / 40)])


class ChainField:
    """Linear-chain conditional random field with two labels: ``emit[feature, label]`` and ``move[label, label]``."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros((FEATURES, 2)) if emit is None else emit
        self.move = np.zeros((2, 2)) if move is None else move

    def marginals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Probability of each label at each place and of each pair of neighbours (summed), and the log partition."""
        e = x @ self.emit
        n = len(e)
        f, b = np.zeros((n, 2)), np.zeros((n, 2))
        f[0] = e[0]
        for t in range(1, n):
            f[t] = e[t] + np.logaddexp(f[t - 1, 0] + self.move[0], f[t - 1, 1] + self.move[1])
        for t in range(n - 2, -1, -1):
            v = self.move + e[t + 1] + b[t + 1]
            b[t] = np.logaddexp(v[:, 0], v[:, 1])
        z = float(np.logaddexp(f[-1, 0], f[-1, 1]))
        pair = np.exp(f[:-1, :, None] + self.move + (e[1:] + b[1:])[:, None, :] - z).sum(0) if n > 1 else np.zeros((2, 2))
        return np.exp(f + b - z), pair, z

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        (stay0, to1), (to0, stay1) = self.move.tolist()
        back, a, b = [], 0.0, 0.0
        for e0, e1 in (x @ self.emit).tolist():
            # of equal scores content, the first label, wins
            from0, from1 = a + stay0 >= b + to0, a + to1 >= b + stay1
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = (a + stay0 if from0 else b + to0) + e0, (a + to1 if from1 else b + stay1) + e1
            if len(back) == 1:
                a, b = e0, e1  # nothing stands before the first
        out = np.zeros(len(back), int)
        label = 0 if a >= b else 1
        for t in range(len(back) - 1, -1, -1):
            out[t] = label
            label = back[t][label]
        return out

    def fit(self, xs: list[np.ndarray], ys: list[np.ndarray], rounds: int = 60, rate: float = 0.5, decay: float = 1e-3) -> ChainField:
        """Maximum likelihood by gradient ascent with one step size per weight (Adagrad)."""
        g2e, g2m, n = np.full_like(self.emit, 1e-6), np.full_like(self.move, 1e-6), sum(map(len, xs)) or 1
        for _ in range(rounds):
            ge, gm = -decay * self.emit, -decay * self.move
            for x, y in zip(xs, ys, strict=True):
                p, pair, _ = self.marginals(x)
                truth = np.eye(2)[y]
                ge = ge + x.T @ (truth - p) / n
                if len(y) > 1:
                    gm = gm + (truth[:-1].T @ truth[1:] - pair) / n
            g2e, g2m = g2e + ge**2, g2m + gm**2
            self.emit, self.move = self.emit + rate * ge / np.sqrt(g2e), self.move + rate * gm / np.sqrt(g2m)
        return self


def default_field() -> ChainField:
    """Where there is no sample to fit on: a segment is boilerplate if a third of its words are repeated."""
    emit = np.zeros((FEATURES, 2))
    emit[0, BOILER], emit[1, BOILER] = -4.0, 12.0
    return ChainField(emit, np.array([[0.3, -0.3], [-0.3, 0.3]]))


def fit_field(texts: list[str]) -> ChainField:
    xs, ys = [], []
    for text in texts:
        parts = segments(text)
        if parts:
            again = repeated([w for p in parts for w in p])
            x = features(parts, again)
            xs.append(x[:SAMPLE_SEGMENTS])
            ys.append((x[:SAMPLE_SEGMENTS, 1] >= MIN_SHARE).astype(int))
    if sum(y.sum() for y in ys) < 5:
        return default_field()
    return ChainField().fit(xs, ys)


def measure(text: str | None, field: ChainField) -> tuple[int, float, float, float]:
    """Words, share of repeated words, share of words in content by the Viterbi labels, and the greatest share of repeated words
    of a segment."""
    parts = segments(text or "")
    if not parts:
        return 0, 0.0, 1.0, 0.0
    again = repeated([w for p in parts for w in p])
    n = np.array([len(p) for p in parts])
    x = features(parts, again)
    labels, total = field.viterbi(x), n.sum()
    return int(total), float(again.mean()), float(n[labels == CONTENT].sum() / total), float(x[:, 1].max())


SCHEMA = "doc_id long, n_words int, repeated_share double, content_share double, most_repeated double"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [pa.int32(), pa.float64(), pa.float64(), pa.float64()]


def measured(documents: DataFrame) -> DataFrame:
    """The figures of :func:`repetition` and ``most_repeated``, the greatest repeated share of a segment. Fitting the field runs a
    job over the sample."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sample = docs.filter(F.length("text").between(1, SAMPLE_CHARS)).orderBy(F.xxhash64("doc_id"), "text").limit(SAMPLE).select("text").collect()
    field = fit_field([r["text"] for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t.as_py(), field) for t in b.column(1)]
            cols = list(zip(*rows, strict=True)) or [()] * len(TYPES)
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(cols, TYPES, strict=True))], names=NAMES)

    return docs.mapInArrow(run, SCHEMA)


def repetition(documents: DataFrame) -> DataFrame:
    """``doc_id, n_words, repeated_share, content_share, retained`` of every row; one pass without a shuffle.

    ``retained`` is the field's decision: RETAIN of the words are in segments labelled content. Null, empty and blank texts have
    0 words, no repetition and content 1. Repeated rows are measured each; an empty table gives no rows; extra columns are
    ignored. Texts are read whole.
    """
    return measured(documents).select("doc_id", "n_words", "repeated_share", "content_share", (F.col("content_share") >= RETAIN).alias("retained"))


def found(documents: DataFrame) -> DataFrame:
    """Documents that the stated rule names. A document's repeated share is the mean of its segments' by words, so each has a segment
    of MIN_SHARE; the field's labels add no case and lose none."""
    marked = (F.col("content_share") < 1) | (F.col("most_repeated") >= MIN_SHARE)
    return measured(documents).filter(marked & (F.col("n_words") >= MIN_WORDS) & (F.col("repeated_share") >= MIN_SHARE)).select("doc_id").distinct()
