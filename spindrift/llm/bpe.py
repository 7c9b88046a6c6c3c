"""Problem 8: encoding the whole corpus with a public byte-level BPE tokenizer.

Each pretoken is encoded with a priority queue of merge ranks over a doubly linked list of symbols; entries of the queue that
a later merge made stale are skipped. Decoding concatenates the strings of the vocabulary. The tokenizer's files are read on
each executor from a folder given by parameter; nothing of them is part of this package.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: how the tokenizer cuts a text into pretokens; a fixed value of the public format
PRETOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: pretokens whose ids a worker keeps; the table is emptied when full, so memory is bounded and results are the same
CACHE = 200_000
#: longer pretokens are encoded each time
CACHED_LENGTH = 64
#: ids of one output batch
BATCH_IDS = 1 << 20


class BytePairEncoder:
    """Encoder and decoder over ``{bytes: id}``, where the id of a merged symbol is the rank of its merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.strings = {i: b for b, i in ranks.items()}
        self.cut = regex.compile(PRETOKEN).findall
        self.cache: dict[str, list[int]] = {}

    @classmethod
    def load(cls, folder: str = TOKENIZERS, name: str = VOCABULARY) -> BytePairEncoder:
        with open(f"{folder}/{name}", "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pretoken; the lowest rank first, of equal ranks the leftmost. O(n log n) in its length."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        n, get = len(word), self.ranks.get
        symbol = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, length = heapq.heappop(queue)
            j = after[i]
            if not symbol[i] or j >= n or len(symbol[i]) + len(symbol[j]) != length:
                continue  # stale: one of the two symbols was merged since
            symbol[i] += symbol[j]
            symbol[j] = b""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = symbol[i] + symbol[k]
                if (r := get(pair)) is not None:
                    heapq.heappush(queue, (r, i, len(pair)))
            if (h := before[i]) >= 0:
                pair = symbol[h] + symbol[i]
                if (r := get(pair)) is not None:
                    heapq.heappush(queue, (r, h, len(pair)))
        return [self.ranks[s] for s in symbol if s]

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; an empty list for null and empty text. Strings of special tokens are plain text."""
        out: list[int] = []
        cache = self.cache
        for word in self.cut(text or ""):
            ids = cache.get(word)
            if ids is None:
                ids = self.merge(word.encode("utf-8", "replace"))
                if len(word) <= CACHED_LENGTH:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(folder: str, name: str) -> BytePairEncoder:
    """The encoder of this worker process."""
    if (folder, name) not in _ENCODERS:
        _ENCODERS[folder, name] = BytePairEncoder.load(folder, name)
    return _ENCODERS[folder, name]


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``key, ids`` of every row, in one pass without a shuffle. Null and empty texts have the empty list; repeated rows are
    encoded each; an empty table gives no rows; extra columns are dropped before Python sees a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for b in batches:
            start, ids, offsets = 0, [], [0]
            texts = b.column(1)
            for i in range(b.num_rows):
                ids += enc.encode(texts[i].as_py())
                offsets.append(len(ids))
                if len(ids) >= BATCH_IDS or i + 1 == b.num_rows:
                    values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(ids, np.int32)))
                    yield pa.record_batch([b.column(0).slice(start, i + 1 - start), values], names=[key, "ids"])
                    start, ids, offsets = i + 1, [], [0]

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def roundtrip(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``key, n_ids, same``: whether decoding the ids of a text gives the text (the empty text for null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for b in batches:
            sizes, same = [], []
            for t in b.column(1):
                ids = enc.encode(t.as_py())
                sizes.append(len(ids))
                same.append(enc.decode(ids) == (t.as_py() or ""))
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int32()), pa.array(same, pa.bool_())], names=[key, "n_ids", "same"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, n_ids int, same boolean")
