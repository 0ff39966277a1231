"""Byte-level BPE encoding of a whole corpus.

Merging follows the queue method: the symbols of a pre-token form a doubly
linked list, all adjacent pairs with a merge rank lie in a priority queue, the
lowest rank is merged first (the leftmost of equal ranks), and queue entries
whose symbols changed since are stale and skipped.  A pre-token of n bytes takes
O(n log n), so text without blanks does not become quadratic.

A pre-token never goes on from a visible character into white space, so a text
may be cut there into stretches (white space, then visible characters) that are
encoded apart.  Each Python worker keeps the vocabulary and two bounded memos, of
finished stretches and of finished pre-tokens; no row needs a shuffle.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.physical import spread

#: Fixed value: the pre-token pattern that belongs to the byte_bpe_* vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Fixed value: the code points of the property White_Space.
SPACE = "\\t-\\r \\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class Memo(dict):
    """Maps a short string to ``make(string)``; emptied when it is full."""

    def __init__(self, make, max_entries: int = 400_000, max_length: int = 64):
        super().__init__()
        self.make, self.max_entries, self.max_length = make, max_entries, max_length

    def __missing__(self, key: str) -> tuple[int, ...]:
        value = self.make(key)
        if len(key) <= self.max_length:
            if len(self) >= self.max_entries:
                self.clear()
            self[key] = value
        return value


class ByteBpe:
    """Encoder and decoder of one vocabulary of ranked byte strings."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pretokens = regex.compile(PRETOKEN).findall
        self.stretches = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.of_pretoken = Memo(lambda x: tuple(self.merge(x.encode("utf-8", "surrogatepass"))))
        self.of_stretch = Memo(lambda x: tuple(chain.from_iterable(map(self.of_pretoken.__getitem__, self.pretokens(x)))))

    def merge(self, data: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        symbol = [data[i : i + 1] for i in range(n)]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            rank = ranks.get(data[i : i + 2])
            if rank is not None:
                queue.append((rank, i, 2))
        heapq.heapify(queue)
        while queue:
            rank, i, size = heapq.heappop(queue)
            left = symbol[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or len(left) + len(symbol[j]) != size or ranks.get(left + symbol[j]) != rank:
                continue  # stale: one of the two symbols has been merged since
            symbol[i] = left = left + symbol[j]
            symbol[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get(left + symbol[k])
                if rank is not None:
                    heapq.heappush(queue, (rank, i, len(left) + len(symbol[k])))
            h = before[i]
            if h >= 0:
                rank = ranks.get(symbol[h] + left)
                if rank is not None:
                    heapq.heappush(queue, (rank, h, len(symbol[h]) + len(left)))
        return [ranks[s] for s in symbol if s is not None]

    def encode(self, text: str) -> array:
        return array("i", chain.from_iterable(map(self.of_stretch.__getitem__, self.stretches(text))))

    def count(self, text: str) -> int:
        return sum(map(len, map(self.of_stretch.__getitem__, self.stretches(text))))

    def decode(self, ids) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def _bpe(path: str) -> ByteBpe:
    if path not in _LOADED:
        # A worker without the file takes the one that SparkContext.addFile sent.
        _LOADED[path] = ByteBpe(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return _LOADED[path]


def encode_texts(
    df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row of ``df``.

    NULL and empty texts give an empty list; special-token strings are ordinary
    text; repeated rows and NULL keys stay as they are; columns other than the
    two are not read.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocabulary)
        for batch in it:
            values, offsets = array("i"), [0]
            for value in batch.column(1).to_pylist():
                if value:
                    values.extend(bpe.encode(value))
                offsets.append(len(values))
            ids = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), len(values), [None, pa.py_buffer(values)])
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    out = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(batches, schema)
    return out.withColumnRenamed("key", key)


def count_tokens(
    df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """``key`` and ``n_tokens`` of every row; 0 for NULL and empty texts."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocabulary)
        for batch in it:
            sizes = [bpe.count(value) if value else 0 for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["key", "n_tokens"])

    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("n_tokens", T.LongType())])
    out = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(batches, schema)
    return out.withColumnRenamed("key", key)


def decode_ids(
    df: DataFrame, key: str, ids: str, vocabulary: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """``key`` and ``text``: the vocabulary strings of ``ids`` put together.

    NULL and empty lists give an empty text.  An id outside the vocabulary fails
    the task, since it cannot come from this tokenizer.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocabulary)
        for batch in it:
            texts = [bpe.decode(value) if value else "" for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("text", T.StringType())])
    out = df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(batches, schema)
    return out.withColumnRenamed("key", key)
