import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import pieces as P

TEXT = st.text(alphabet=st.sampled_from("ab. \n\ré́。👩‍🔬"), max_size=400)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(2, 50), st.integers(0, 49))
def test_nothing_lost_nothing_too_long(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    cut = P.spans(text, limit, overlap)
    assert cut[0][0] == 0 and cut[-1][1] == len(text)
    assert all(b - a <= limit for a, b in cut)
    for (a, b), (c, d) in zip(cut, cut[1:]):
        assert b - c == overlap and c > a or (overlap == 0 and b == c)
        assert d > b
    whole = text[slice(*cut[0])] + "".join(text[a + overlap : b] for a, b in cut[1:])
    assert whole == text


def brute(text, limit, overlap):
    """Ends by looking at every offset, from the strongest kind of boundary down."""
    spaces = set("\t\n\v\f\r \x85\xa0")
    ends = {0: set(), 1: set(), 2: set(), 3: set()}
    for i in range(1, len(text) + 1):
        after_wide = text[i - 1] in "。！？"
        after_space = text[i - 1] in spaces and (i == len(text) or text[i] not in spaces)
        if after_space:
            j = i
            while j and text[j - 1] in spaces:
                j -= 1
            lines = text[j:i].count("\n")
            ends[0].update([i] if lines > 1 else [])
            ends[1].update([i] if lines > 0 else [])
            ends[2].update([i] if lines > 0 or (j and text[j - 1] in ".!?…。！？") else [])
        if after_wide:
            ends[2].add(i)
        if after_space or after_wide:
            ends[3].add(i)
    out, start = [], 0
    while len(text) - start > limit:
        for kind in range(4):
            fit = [e for e in ends[kind] if start + max(overlap, limit // 2) < e <= start + limit]
            if fit:
                break
        else:
            fit = [e for e in ends[3] if start + overlap < e <= start + limit]
        end = max(fit, default=start + limit)
        out.append((start, end))
        start = end - overlap
    return [*out, (start, len(text))]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n。", max_size=200), st.integers(4, 40), st.integers(0, 3))
def test_equals_brute_force(text, limit, overlap):
    assert P.spans(text, limit, overlap) == brute(text, limit, overlap)


def test_accents_stay_with_their_letter():
    cut = P.spans("é" * 30, 9, 0)
    assert all(("é" * 30)[b : b + 1] != "́" for _, b in cut)


def test_rows(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, "x" * 10, "k"), (4, "word " * 500, "k"), (4, "word " * 500, "k"), (None, "y" * 30, "k")]
    df = spark.createDataFrame(rows, "id int, text string, piece string")
    found = P.split_texts(df, "id", "text", 20, 5).collect()
    assert sorted({r["id"] for r in found}, key=str) == sorted([2, 3, 4, None], key=str)
    assert [(r["piece"], r["n_pieces"]) for r in found if r["id"] == 2] == [("", 1)]
    four = [r for r in found if r["id"] == 4]
    assert len(four) == 2 * four[0]["n_pieces"]
    assert sorted(str(r["id"]) for r in P.oversized(df, "id", "text", 20, 5).collect()) == ["4", "4", "None"]
    assert P.split_texts(df.limit(0), "id", "text", 20, 5).count() == 0
    with pytest.raises(ValueError):
        P.split_texts(df, "id", "text", 20, 20)
