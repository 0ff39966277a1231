"""Cutting oversized texts at natural boundaries.

A text is a sequence of tokens (runs of white space and runs of other characters;
an ideographic full stop ends a token too).  The prefix sums of the token lengths
are the offsets at which a piece may end, kept as sorted arrays, one for each
strength of boundary.  A piece ends at the last offset under the limit, found by
binary search; the next piece begins ``overlap`` characters before that end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.physical import spread

_SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_STOPS = np.array([ord(c) for c in ".!?…。！？"], np.uint32)
_WIDE_STOPS = np.array([ord(c) for c in "。！？"], np.uint32)


def _glued(code: int) -> bool:
    """Does this character belong to the one before it (accent, selector, joiner)?"""
    return 0x300 <= code <= 0x36F or 0x3099 <= code <= 0x309A or 0xFE00 <= code <= 0xFE0F or code == 0x200D or 0x1F3FB <= code <= 0x1F3FF


def boundaries(codes: np.ndarray) -> list[np.ndarray]:
    """Sorted offsets: after paragraphs, after lines, after sentences, after words."""
    space = np.isin(codes, _SPACES)
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    lengths = np.diff(np.concatenate(([0], turns, [len(codes)])))
    ends = np.cumsum(lengths)
    blank = space[ends - 1]
    ends, lengths = ends[blank], lengths[blank]
    newlines = np.concatenate(([0], np.cumsum(codes == 10)))
    lines = newlines[ends] - newlines[ends - lengths]
    inner = ends - lengths > 0
    sentence = np.zeros(len(ends), bool)
    sentence[inner] = np.isin(codes[(ends - lengths)[inner] - 1], _STOPS)
    wide = np.flatnonzero(np.isin(codes, _WIDE_STOPS)) + 1
    after_sentence = np.union1d(ends[sentence | (lines > 0)], wide)
    return [ends[lines > 1], ends[lines > 0], after_sentence, np.union1d(ends, wide)]


def spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece; see ``split_texts`` for the rules."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    levels = boundaries(codes)
    out, start = [], 0
    while n - start > limit:
        most, end = start + limit, 0
        for least, arrays in ((start + max(overlap, limit // 2), levels), (start + overlap, levels[-1:])):
            for array in arrays:
                at = int(np.searchsorted(array, most, "right")) - 1
                if at >= 0 and array[at] > least:
                    end = int(array[at])
                    break
            if end:
                break
        else:
            end = most
            while end > start + overlap + 1 and (_glued(int(codes[end])) or codes[end - 1] == 0x200D):
                end -= 1
            if end == start + overlap + 1:
                end = most
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


def split_texts(
    df: DataFrame, key: str, text: str, limit: int, overlap: int, with_text: bool = True
) -> DataFrame:
    """Pieces of every text: ``key, piece_no, n_pieces, start_char, end_char[, piece]``.

    No piece exceeds ``limit`` characters (code points).  A piece ends at the last
    paragraph end in the second half of the room it has, else at the last line
    end, sentence end or word end there, else at any word end behind the overlap,
    else it is cut hard at the limit (not before an accent or joiner).  Each
    further piece repeats exactly the last ``overlap`` characters of the one
    before, so the pieces without their overlaps are the text, character by
    character.  A text within the limit, the empty one included, is one piece;
    NULL gives none.  Rows are independent: repeated rows give repeated pieces,
    and columns other than the two are not read.

    Only texts above the limit leave the JVM.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("piece")).where(F.col("piece").isNotNull())
    length = F.length("piece").cast("long")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    short = rows.where(length <= limit).select("key", zero.alias("piece_no"), one.alias("n_pieces"), zero.alias("start_char"), length.alias("end_char"), "piece")
    fields = [T.StructField("key", df.schema[key].dataType)]
    fields += [T.StructField(c, T.LongType()) for c in ("piece_no", "n_pieces", "start_char", "end_char")]
    if with_text:
        fields.append(T.StructField("piece", T.StringType()))
    else:
        short = short.drop("piece")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            row, number, total, starts, ends, pieces = [], [], [], [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                cut = spans(value, limit, overlap)
                row += [i] * len(cut)
                number += range(len(cut))
                total += [len(cut)] * len(cut)
                starts += [a for a, _ in cut]
                ends += [b for _, b in cut]
                if with_text:
                    pieces += [value[a:b] for a, b in cut]
            columns = [batch.column(0).take(pa.array(row, pa.int64()))]
            columns += [pa.array(x, pa.int64()) for x in (number, total, starts, ends)]
            columns += [pa.array(pieces, pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    long = spread(rows.where(length > limit)).mapInArrow(batches, T.StructType(fields))
    return short.unionByName(long).withColumnRenamed("key", key)


def oversized(df: DataFrame, key: str, text: str, limit: int, overlap: int) -> DataFrame:
    """Keys of the rows that ``split_texts`` cuts into several pieces, one row each."""
    cut = split_texts(df, key, text, limit, overlap, with_text=False)
    return cut.where((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).select(key)
