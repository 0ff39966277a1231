"""Vectors for texts through a pluggable provider."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest text sent to the model, in characters, and batch size.
EMBED_CHARS, PAGE_EMBED_CHARS, BATCH = 1000, 600, 8

Provider = Callable[[list[str]], np.ndarray]


def hashing_provider(dim: int = 768) -> Callable[[], Provider]:
    """Deterministic vectors without a model: signed feature hashing of words."""

    def make() -> Provider:
        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for i, text in enumerate(texts):
                for word in text.lower().split():
                    code = zlib.crc32(word.encode("utf-8", "surrogatepass"))
                    out[i, code % dim] += 1.0 if code & 0x80000000 else -1.0
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norms == 0, 1, norms)

        return embed

    return make


def letter_profile(text: Column) -> Column:
    """How often each letter from a to z occurs, as a vector of 26 numbers; NULL gives NULL.

    The plainest vectors that depend on the text alone, made without leaving the
    JVM.  Their relevance says nothing about a model's.
    """
    count = lambda low: (F.length(text) - F.length(F.replace(F.replace(text, F.lit(low)), F.lit(low.upper())))).cast("double")
    return F.when(text.isNotNull(), F.array(*[count(chr(c)) for c in range(ord("a"), ord("z") + 1)]))


def http_provider(url: str, timeout: float = 120.0) -> Callable[[], Provider]:
    """A service that takes ``{"inputs": [...]}`` and returns a list of vectors."""

    def make() -> Provider:
        def embed(texts: list[str]) -> np.ndarray:
            import urllib.request

            body = json.dumps({"inputs": texts, "truncate": True}).encode()
            request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as response:
                return np.array(json.load(response), np.float32)

        return embed

    return make


def embedded(df: DataFrame, text: str, provider: Callable[[], Provider], chars: int = EMBED_CHARS, batch: int = BATCH, dim: int | None = None) -> DataFrame:
    """``df`` with ``embedding``; the provider is made once in each worker.

    Texts are cut to ``chars`` for the model only.  A provider that returns
    another number of vectors, or another dimension than ``dim``, fails the task.
    """

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = provider()
        for texts in batches:
            out: list[np.ndarray] = []
            values = texts.fillna("").tolist()
            for at in range(0, len(values), batch):
                part = values[at : at + batch]
                found = embed(part)
                if len(found) != len(part):
                    raise RuntimeError(f"{len(found)} vectors for {len(part)} texts")
                if dim is not None and len(part) and found.shape[1] != dim:
                    raise RuntimeError(f"vectors of {found.shape[1]} numbers, expected {dim}")
                out += list(found)
            yield pd.Series(out)

    return df.withColumn("embedding", vectors(F.substring(F.col(text), 1, chars)))
