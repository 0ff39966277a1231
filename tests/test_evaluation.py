import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import evaluation as E
from docloom.sources import files


def test_gates(spark, tmp_path):
    rows = [{"id": "a", "query": "q", "tool": "t", "collection": "c", "expected_source_urls": ["https://x.example/1"], "must_appear_in_answer": ["quota"], "forbidden_in_answer": ["secret"]}]
    (tmp_path / "g.json").write_text(json.dumps({"queries": rows}))
    golden = files.golden_set(spark, str(tmp_path / "g.json"))
    good = golden.withColumn("output", F.lit("x\n**Source:** https://x.example/1\ntext"))
    bad = golden.withColumn("output", F.lit("quota https://x.example/1"))
    first = E.retrieval_gate(good)
    assert first.first()["passed"] and first.first()["missing_evidence"] == ["quota"]
    assert E.exit_code(first) == 0 and E.exit_code(E.retrieval_gate(bad)) == 1

    def gate(answer, fired=True):
        return E.answer_gate(golden.select("*", F.lit(answer).alias("answer"), F.lit(fired).alias("tool_fired"), F.array(F.lit("https://x.example/1")).alias("allowed_urls")))

    assert gate("the quota, see [x](https://x.example/1).").first()["passed"]
    assert gate("quota https://y.example").first()["invented_urls"] == ["https://y.example"]
    assert gate("nothing").first()["missing_strings"] == ["quota"]
    assert gate("quota secret").first()["forbidden_strings"] == ["secret"]
    assert not gate("quota", False).first()["passed"]
    assert E.exit_code(first, gate("nothing")) == 2
    with pytest.raises(ValueError, match="unknown"):
        E.selected_rows(golden, ["a", "z"])


def test_requests_and_order_of_gates(spark):
    golden = spark.createDataFrame([("a", "words", None, "t"), ("b", "words", "focus", "t")], "id string, query string, retrieval_query string, tool string")
    assert sorted(map(tuple, E.retrieval_requests(golden, ["t"]).collect())) == [("a", "t", "words", 10), ("b", "t", "focus", 10)]
    with pytest.raises(Exception, match="unsupported tool: t"):
        E.retrieval_requests(golden, ["u"]).collect()
    first = spark.createDataFrame([("a", True), ("b", False), ("c", True), ("d", True)], "id string, passed boolean")
    second = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "id string, passed boolean")
    assert sorted(map(tuple, E.gated(first, second).collect())) == [("a", True, True, "passed"), ("b", False, False, "blocked"), ("c", True, False, "failed"), ("d", True, False, "failed")]
