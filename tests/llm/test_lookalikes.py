import pytest

from docloom.llm import lookalikes as L


@pytest.fixture(scope="module")
def rewrite():
    return L.Rewriter(L.representatives({c: 10 for c in map(chr, range(32, 127))}))


SAME = [
    ("Ｐｉｐｅｌｉｎｅ　１２", "Pipeline 12"), ("é", "é"), ("ộ", "ộ"), ("ﬁle", "file"), ("sсоре", "scope"), ("ΑΒΕ", "ABE"), ("a​b­", "ab"),
    ("a b c", "a b c"), ("a‑b‐c", "a-b-c"), ("ﾊﾟｲﾌﾟ", "パイプ"), ("Å", "Å"), ("µ", "μ"), ("a\r\nb", "a\nb"), ("е́", "é"), ("‮ab", "ab"), ("e‍́x", "éx"),
]
OTHER = [("a", "A"), ("é", "e"), ("x²", "x2"), ("①", "1"), ("a.", "a,"), ("ab", "a b"), ("đ", "d"), ("ß", "ss"), ("½", "1/2"), ("–", "-"), ("𝒳", "X"), ("и", "й")]


@pytest.mark.parametrize("a, b", SAME)
def test_same_look(a, b, rewrite):
    assert rewrite(a) == rewrite(b)
    assert rewrite(rewrite(a)) == rewrite(a)


@pytest.mark.parametrize("a, b", OTHER)
def test_other_look(a, b, rewrite):
    assert rewrite(a) != rewrite(b)


def test_frequency_decides():
    rules = L.representatives({"а": 100, "a": 1})
    assert rules["a"] == "а" and L.Rewriter(rules)("bad") == "bаd"


def test_classes_are_transitive():
    group = next(m for m in L.look_alike_classes() if "o" in m)
    assert {"ο", "о", "ｏ"} <= set(group)


def test_rows(spark):
    rows = [(1, "Pipeline é"), (2, "Ｐipeline é"), (3, "Pipeline é"), (4, "Pipelinе é"), (5, "pipeline é"), (6, None), (7, ""), (8, "​ "), (9, " "), (9, " ")]
    df = spark.createDataFrame(rows, "doc long, text string").selectExpr("doc", "text", "'x' AS form_id", "'y' AS key")
    found = sorted(tuple(r) for r in L.same_look_pairs(df, "doc", "text").collect())
    assert found == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)]
    forms = {r["doc"]: r["form"] for r in L.normalize_texts(df, "doc", "text").collect()}
    assert forms[6] is None and forms[7] == "" and forms[1] == forms[2] == forms[4] != forms[5]
    assert L.same_look_pairs(df.limit(0), "doc", "text").count() == 0


def test_copies_beside_a_variant(spark):
    df = spark.range(10_000).selectExpr("id AS doc", "if(id = 77, 'Ｐipeline', 'Pipeline') AS text")
    found = L.same_look_pairs(df, "doc", "text")
    assert found.count() == 9_999 and found.where("(doc_a = 77) = (doc_b = 77) or doc_a >= doc_b").count() == 0


def test_pairs_equal_brute_force(spark):
    texts = ["a-b", "a‑b", "a‐b", "x", "ｘ", "y", None, "", "a-b", "a-b", "ｘ"] * 3
    df = spark.createDataFrame([(i % 30 if i != 5 else None, t) for i, t in enumerate(texts)], "doc int, text string")
    form = L.Rewriter(L.learn_rules(df, "text"))
    rows = [(r["doc"], r["text"], form(r["text"])) for r in df.collect() if r["text"] and r["doc"] is not None]
    want = {(a, b) for a, x, f in rows for b, y, g in rows if a < b and x != y and f == g}
    assert sorted(tuple(r) for r in L.same_look_pairs(df, "doc", "text").collect()) == sorted(want)
