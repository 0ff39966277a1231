import pytest

from docloom.functions import cleaning

CASES = [
    # text, page, flat, incremental
    ("---\ntitle: a\n---\n# Head\n\n\n\nBody  x\n", "# Head\n\nBody x", "# Head Body x", "# Head Body x"),
    ("+++\nt = 1\n+++\nBody", "Body", "Body", "Body"),
    ("a {{< note >}} b", "a b", "a b", "a b"),
    ("a <!-- x\ny --> b", "a b", "a b", "a b"),
    ("<p>one</p><br/>two", "one two", "one two", "one two"),
    ("Home page of Menu", "page of", "page of", "page of"),
    ("Homework stays", "Homework stays", "Homework stays", "Homework stays"),
    ("see [Docs (new)](https://a.example/x(y)) now", "see Docs (new) now", "see [Docs (new)]( now", "see [Docs (new)]( now"),
    ("go https://a.example/b?c=1 on", "go on", "go on", "go on"),
    ("a\xa0\xa0b", "a\xa0\xa0b", "a b", "a b"),
    ("", "", "", ""),
    (None, None, None, None),
    ("one\n---\ntwo\n---\nthree", "one\n---\ntwo\n---\nthree", "one --- two --- three", "one three"),
]


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_cleaners(spark, kind):
    make = (cleaning.clean_page, cleaning.clean_flat, cleaning.clean_incremental)[kind]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    found = {r["i"]: r["c"] for r in df.select("i", make(df["t"]).alias("c")).collect()}
    for i, case in enumerate(CASES):
        assert found[i] == case[1 + kind], case[0]


def test_mixed_fences_are_kept_apart(spark):
    df = spark.createDataFrame([("---\na: 1\n+++\nx",)], "t string")
    assert df.select(cleaning.strip_front_matter(df["t"])).first()[0] == "---\na: 1\n+++\nx"
