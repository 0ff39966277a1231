"""A trigram index over chunks of files, and what a regular expression needs of it.

From the parse tree of a regular expression come its required trigrams: a text can
only match if, for at least one of the expression's alternatives, it holds all the
trigrams of that alternative's literal runs.  The index keeps a posting (trigram,
file, chunk) for the trigrams that some expression needs, and intersecting the
postings leaves the chunks on which expressions must be verified.

All postings of a chunk come from one file, so ``candidate_chunks`` intersects them
in the batch that makes them and nothing is shuffled; ``postings`` and
``candidates`` are the same for an index that is kept as a table.
"""

from __future__ import annotations

import functools
import re._parser as sre
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.physical import spread

#: A chunk is the run of lines that begin within so many bytes of a text, counted
#: from its beginning; a longer line is a chunk.  What verifies a chunk may read on.
CHUNK_BYTES = 256
#: Texts of about so many bytes are looked at together.
BATCH_BYTES = 1_500_000
#: Beyond so many alternatives of one expression open literal runs end where they
#: are, which requires less of a text and so loses no match.
MOST_ALTERNATIVES = 400


#: What ``\\s`` matches.
_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def _grams(run: str) -> frozenset[str]:
    """The trigrams of a run; a shorter run of at least three bytes as it is."""
    if len(run) < 3:
        return frozenset([run] if len(run.encode()) >= 3 else [])
    return frozenset(run[i : i + 3] for i in range(len(run) - 2))


def _least(sets: set[tuple[frozenset[str], str]]) -> set[tuple[frozenset[str], str]]:
    """Without the alternatives that another one with the same open run makes needless."""
    by_run: dict[str, list[frozenset[str]]] = {}
    for grams, run in sorted(sets, key=lambda x: len(x[0])):
        known = by_run.setdefault(run, [])
        if not any(k <= grams for k in known):
            known.append(grams)
    return {(grams, run) for run, known in by_run.items() for grams in known}


def _required(tree, begun: set[tuple[frozenset[str], str]]) -> set[tuple[frozenset[str], str]]:
    """Alternatives after a parse tree: trigrams that must be held, and the literal run that may go on."""

    def ended(options: set[tuple[frozenset[str], str]]) -> set[tuple[frozenset[str], str]]:
        return _least({(grams | _grams(run), "") for grams, run in options})

    def either(letters: list[str]) -> set[tuple[frozenset[str], str]]:
        return {(grams, run + c) for grams, run in begun for c in letters}

    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            begun = either([chr(value).lower()])
        elif name == "SUBPATTERN":
            begun = _required(value[3], begun)
        elif name == "ATOMIC_GROUP":
            begun = _required(value, begun)
        elif name == "BRANCH":
            begun = {x for branch in value[1] for x in _required(branch, begun)}
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = value
            if least == 0 and most == 1:
                begun = begun | _required(inner, begun)
            else:
                begun = ended(_required(inner, begun) if least else begun)
        elif name == "IN" and len(value) <= 8 and all(str(v[0]) == "LITERAL" for v in value):
            begun = either(sorted({chr(v[1]).lower() for v in value}))
        elif name == "IN" and 1 < len(value) <= 8 and all(str(v[0]) == "LITERAL" or str(v[1]) == "CATEGORY_SPACE" for v in value):
            begun = either(sorted({c for v in value for c in ([chr(v[1]).lower()] if str(v[0]) == "LITERAL" else _SPACES)}))
        elif name == "ASSERT" and value[0] > 0:
            begun = ended(_required(value[1], begun))
        elif name not in ("AT", "ASSERT", "ASSERT_NOT"):
            begun = ended(begun)
        begun = _least(begun)
        if len(begun) > MOST_ALTERNATIVES:
            begun = ended(begun)
    return begun


def required_trigrams(pattern: str) -> list[frozenset[str]]:
    """The trigram sets of which a matching text must hold at least one whole.

    An alternative without any trigram gives an empty set: everything may match.
    Sets that contain another one are left out, as they require no less.  One or
    two letters that take three bytes or more in UTF-8 stand for their trigrams
    of bytes.
    """
    sets = {grams | _grams(run) for grams, run in _required(sre.parse(pattern), {(frozenset(), "")})}
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def required_bytes(patterns: list[str]) -> list[frozenset[bytes]]:
    """The sets of byte trigrams, in UTF-8 and lower case, of all ``patterns`` together."""
    sets = set()
    for grams in {s for p in patterns for s in required_trigrams(p)}:
        coded = [g.encode() for g in grams]
        sets.add(frozenset(c[i : i + 3] for c in coded for i in range(len(c) - 2)))
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def lower_case(text: str) -> str:
    """``text`` in lower case, letter by letter, so that places stay."""
    lower = text.lower()
    if len(lower) != len(text):  # a few letters change length
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return lower.replace("\u017f", "s").replace("\u0131", "i")  # as patterns without case match them


def _code(trigram: bytes) -> int:
    a, b, c = trigram
    return a << 16 | b << 8 | c


class Chunks:
    """The chunks of several texts: postings of the wanted trigrams and lines of each.

    ``text`` and ``number`` name a chunk, ``first`` and ``last`` its lines, counted
    from 0.  A posting is a pair of ``chunk`` and ``trigram``, its place among the
    sorted codes of the wanted ones.
    """

    def __init__(self, texts: list[str], codes: np.ndarray, wanted: np.ndarray):
        low = [lower_case(t).encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join(low), np.uint8)
        begins = np.concatenate(([0], np.cumsum([len(x) + 1 for x in low])))[:-1].astype(np.int64)
        line = np.concatenate(([0], np.flatnonzero(data == 10) + 1))
        of = np.searchsorted(begins, line, "right") - 1
        block = (line - begins[of]) // CHUNK_BYTES
        new = np.concatenate(([True], (of[1:] != of[:-1]) | (block[1:] != block[:-1])))
        chunk_of_line = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        first_line = np.searchsorted(line, begins)
        self.text = of[at]
        self.first = at - first_line[self.text]
        self.last = np.concatenate((at[1:], [len(line)])) - 1 - first_line[self.text]
        self.number = np.arange(len(at)) - np.searchsorted(self.text, self.text)
        wide = data.astype(np.int32)
        grams = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:] if len(data) > 2 else np.zeros(0, np.int32)
        hits = np.flatnonzero(wanted[grams])
        chunk = chunk_of_line[np.searchsorted(line, hits, "right") - 1]
        pairs = np.unique(chunk * len(codes) + np.searchsorted(codes, grams[hits]))
        self.chunk, self.trigram = pairs // len(codes), pairs % len(codes)

    def met(self, sets: list[np.ndarray], trigrams: int) -> np.ndarray:
        """Of each chunk and each of ``sets``: does the chunk hold all its trigrams?"""
        held = np.zeros((len(self.text), trigrams), bool)
        held[self.chunk, self.trigram] = True
        return np.stack([held[:, s].all(axis=1) for s in sets], axis=1)


class Index:
    """Required trigrams of expressions, looked up in the chunks of texts."""

    def __init__(self, required: list[frozenset[bytes]]):
        if not all(required):
            raise ValueError("a pattern has an alternative without any required trigram")
        self.codes = np.array(sorted({_code(t) for s in required for t in s}), np.int64)
        self.sets = [np.searchsorted(self.codes, sorted(_code(t) for t in s)) for s in required]
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[self.codes] = True

    def chunks(self, texts: list[str]) -> Iterator[tuple[int, Chunks]]:
        """(place of the first text, chunks) of groups of texts."""
        group: list[str] = []
        held = 0
        for i, text in enumerate(texts):
            group.append(text)
            held += len(text)
            if held >= BATCH_BYTES or i + 1 == len(texts):
                yield i + 1 - len(group), Chunks(group, self.codes, self.wanted)
                group, held = [], 0

    def candidate_chunks(self, texts: list[str]) -> list[list[tuple[int, int, list[int]]]]:
        """(first line, last line, requirements met) of each candidate chunk of each text."""
        out: list[list[tuple[int, int, list[int]]]] = [[] for _ in texts]
        for begin, found in self.chunks(texts):
            met = found.met(self.sets, len(self.codes))
            at = np.flatnonzero(met.any(axis=1))
            which, needs = np.nonzero(met[at])
            parts = np.split(needs, np.searchsorted(which, np.arange(1, len(at))))
            for text, first, last, part in zip(found.text[at].tolist(), found.first[at].tolist(), found.last[at].tolist(), parts):
                out[begin + text].append((first, last, part.tolist()))
        return out


@functools.cache
def index_of(required: tuple[frozenset[bytes], ...]) -> Index:
    """One index of these requirements for each worker."""
    return Index(list(required))


def postings(df: DataFrame, key: str, text: str, patterns: list[str]) -> DataFrame:
    """``key, chunk, trigram``: the chunks that hold each required trigram, in lower case.

    Chunks are numbered from 0 in each text.  NULL keys and texts have none.
    """
    required = tuple(required_bytes(patterns))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(required)
        for batch in it:
            for begin, found in index.chunks(batch.column(1).to_pylist()):
                keys = batch.column(0).take(pa.array(begin + found.text[found.chunk]))
                numbers, codes = found.number[found.chunk], index.codes[found.trigram]
                yield pa.RecordBatch.from_arrays([keys, pa.array(numbers, pa.int32()), pa.array(codes, pa.int32())], names=["key", "chunk", "trigram"])

    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("key").isNotNull())
    return spread(source).mapInArrow(batches, f"key {kind}, chunk int, trigram int")


def candidates(index: DataFrame, patterns: list[str]) -> DataFrame:
    """``key`` and ``chunk``: the chunks of a stored index on which some pattern may match.

    The table of alternatives depends on the patterns only, so it is broadcast.
    Postings of rows with the same key are looked at together.
    """
    needs = [(i, _code(t), len(s)) for i, s in enumerate(required_bytes(patterns)) for t in s]
    wanted = index.sparkSession.createDataFrame(needs, "need int, trigram int, size long")
    held = index.distinct().join(F.broadcast(wanted), "trigram").groupBy("key", "chunk", "need", "size").agg(F.count("*").alias("n"))
    return held.where("n = size").select("key", "chunk").distinct()


def selectivity(df: DataFrame, text: str, patterns: list[str]) -> DataFrame:
    """``chunks, candidates``: how many chunks there are and how many the index leaves."""
    required = tuple(required_bytes(patterns))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(required)
        for batch in it:
            found = [x for _, x in index.chunks(batch.column(0).to_pylist())]
            sizes, left = [len(x.text) for x in found], [int(x.met(index.sets, len(index.codes)).any(axis=1).sum()) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(left, pa.int64())], names=["chunks", "candidates"])

    counted = spread(df.select(F.col(text).alias("text")).where("text is not null")).mapInArrow(batches, "chunks long, candidates long")
    return counted.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("candidates"), F.lit(0)).alias("candidates"))
