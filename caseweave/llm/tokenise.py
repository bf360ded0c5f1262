"""Encoding of whole texts with a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern. Within a word a priority queue holds the adjacent symbol pairs by
merge rank (then position) over a doubly linked list of symbols; the least is merged, its neighbours' new pairs are
pushed, and entries that no longer describe two living neighbours are skipped when they surface. Decoding concatenates
the symbols' byte strings. Words repeat, so each Python worker keeps the ids of the words it has met, up to a bound of
words and of bytes; what is kept changes the time, never the result.

The vocabulary file is read by the driver and sent to the executors as one broadcast; it is refused above
``MAX_VOCABULARY`` bytes. Null and empty texts give an empty list of ids; every text is encoded whole; special tokens
are ordinary text. Empty tables give empty tables; repeated rows are kept; other columns are dropped.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY = 64 << 20
#: The pattern published with the vocabulary: words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_WORDS, MAX_WORD_CHARS = 200_000, 200


class Bpe:
    def __init__(self, vocabulary: bytes):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.words = regex.compile(PATTERN)
        self.kept = _Kept(self.encode_word)
        self.sizes = _Kept(lambda w: len(self.kept[w]))

    def encode_word(self, word: str) -> list[int]:
        raw, ranks = word.encode("utf-8", "surrogatepass"), self.ranks
        if raw in ranks:
            return [ranks[raw]]
        n = len(raw)
        sym: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i, size = heapq.heappop(queue)
            a = sym[i]
            j = right[i]
            if a is None or j >= n or len(a) + len(sym[j]) != size:  # type: ignore[arg-type]
                continue  # stale: one of the two has been merged since
            merged = a + sym[j]  # type: ignore[operator]
            sym[i], sym[j] = merged, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := ranks.get(merged + sym[k])) is not None:  # type: ignore[operator]
                    heapq.heappush(queue, (r, i, size + len(sym[k])))  # type: ignore[arg-type]
            if (h := left[i]) >= 0 and (r := ranks.get(sym[h] + merged)) is not None:  # type: ignore[operator]
                heapq.heappush(queue, (r, h, len(sym[h]) + size))  # type: ignore[arg-type]
        return [ranks[s] for s in sym if s is not None]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.kept.__getitem__, self.words.findall(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(self.sizes.__getitem__, self.words.findall(text))) if text else 0

    def decode(self, ids: list[int]) -> str:
        if not hasattr(self, "strings"):
            self.strings = {r: s for s, r in self.ranks.items()}
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "surrogatepass")


class _Kept(dict):  # type: ignore[type-arg]
    """Results by word; emptied when full, long words are not kept."""

    def __init__(self, make: Callable[[str], Any]):
        self.make = make

    def __missing__(self, word: str) -> Any:
        value = self.make(word)
        if len(word) <= MAX_WORD_CHARS:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = value
        return value


_loaded: dict[int, Bpe] = {}


def _worker_bpe(vocabulary: Any) -> Bpe:
    """One encoder per Python worker and vocabulary."""
    raw = vocabulary.value
    key = hash(raw)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(raw)
    return _loaded[key]


def _broadcast_vocabulary(df: DataFrame, path: str) -> Any:
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY + 1)
    if len(raw) > MAX_VOCABULARY:
        raise ValueError(f"{path}: more than {MAX_VOCABULARY} bytes")
    return df.sparkSession.sparkContext.broadcast(raw)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids) of every row."""
    shared = _broadcast_vocabulary(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker_bpe(shared)
        find, kept = bpe.words.findall, bpe.kept.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, ends = array("i"), [0]
                for text in part.column(1).to_pylist():
                    if text:
                        ids.extend(chain.from_iterable(map(kept, find(text))))
                    ends.append(len(ids))
                flat = pa.array(np.frombuffer(ids, dtype=np.int32) if ids else np.empty(0, np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, id_col: str, text_col: str, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, kept columns, n_tokens) of every row, without making the ids."""
    shared = _broadcast_vocabulary(df, vocabulary)
    kept = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker_bpe(shared)
        for batch in batches:
            counts = pa.array([bpe.count(t) for t in batch.column(len(kept)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], counts], names=[*kept, "n_tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.select(*kept, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"{kinds}, n_tokens bigint")
