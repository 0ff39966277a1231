import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def ours():
    return bpe.ByteBpe(bpe.DEFAULT_VOCABULARY)


@pytest.fixture(scope="module")
def public(ours):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PRETOKEN, mergeable_ranks=ours.ranks, special_tokens={})


@settings(max_examples=500, deadline=None)
@given(text=st.text(max_size=80))
def test_equals_public_library(text, ours, public):
    ids = list(ours.encode(text))
    assert ids == public.encode_ordinary(text)
    assert ours.decode(ids) == text and ours.count(text) == len(ids)


@pytest.mark.parametrize("text", ["", "  a   b\n\n c\t", "don't we'll", "x" * 5000, "数据" * 3000, "a\x1c b\x1f!", "<|endoftext|>", "﻿​ 👩‍🔬", "　 a b \xa0", "   "])
def test_hard_texts(text, ours, public):
    assert list(ours.encode(text)) == public.encode_ordinary(text)


def test_memo_is_bounded(ours):
    memo = bpe.Memo(lambda x: (len(x),), max_entries=3, max_length=4)
    assert [memo[x] for x in ("a", "bb", "ccc", "dddd", "eeeee")] == [(1,), (2,), (3,), (4,), (5,)]
    assert len(memo) <= 3


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "hello world", "x"), (3, "hello world", "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc int, text string, ids string")
    found = bpe.encode_texts(df, "doc", "text")
    got = sorted((str(r["doc"]), list(r["ids"])) for r in found.collect())
    assert got == [("1", []), ("2", []), ("3", [31373, 995]), ("3", [31373, 995]), ("None", [64])]
    assert sorted(r["text"] for r in bpe.decode_ids(found, "doc", "ids").collect()) == ["", "", "a", "hello world", "hello world"]
    assert sorted(r["n_tokens"] for r in bpe.count_tokens(df, "doc", "text").collect()) == [0, 0, 1, 2, 2]
    assert bpe.encode_texts(df.limit(0), "doc", "text").count() == 0
