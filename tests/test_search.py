import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import search

HITS = "id int, content_text string, citation_url string, file_path string, chunk_index int, score double, rank int"


def test_top_k_filters_before_the_limit(spark):
    rows = [(i, [math.cos(i / 9), math.sin(i / 9)], i % 2) for i in range(10)] + [(99, None, 1), (98, [0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "id int, vector array<double>, label int")
    found = search.top_k(df, [1.0, 0.0], 3, "id", "vector", ["label"], F.col("label") == 1)
    assert [(r["id"], r["rank"]) for r in found.orderBy("rank").collect()] == [(1, 1), (3, 2), (5, 3)]
    assert "TakeOrderedAndProject" in found._jdf.queryExecution().executedPlan().toString()


def test_ties_go_to_the_lower_key(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in (5, 3, 9)], "id int, vector array<double>")
    assert [r["id"] for r in search.top_k(df, [2.0, 0.0], 2, "id", "vector", []).orderBy("rank").collect()] == [3, 5]
    assert sorted((r["query_id"], r["id"]) for r in search.batch_top_k(df, df.where("id = 5"), 2, "id", "vector").collect()) == [(5, 3), (5, 5)]


def test_batch_blocks_do_not_matter(spark):
    rows = [(i, [math.cos(i * 1.7), math.sin(i * 1.7), math.cos(i)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, vector array<double>").repartition(3)
    small = search.batch_top_k(df, df, 4, "id", "vector", block=7)
    large = search.batch_top_k(df, df, 4, "id", "vector")
    pick = lambda d: sorted((r["query_id"], r["rank"], r["id"]) for r in d.collect())
    assert pick(small) == pick(large) and small.count() == 240
    assert search.batch_top_k(df, df.limit(0), 4, "id", "vector").count() == 0


def test_ties_of_many_equal_vectors(spark):
    rows = [(f"k{i:03d}", [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(300)] + [(None, None)]
    df = spark.createDataFrame(rows, "id string, vector array<float>").repartition(4)
    found = search.batch_top_k(df, df.where("id in ('k000', 'k001')"), 3, "id", "vector").collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in found) == [("k000", 1, "k000"), ("k000", 2, "k003"), ("k000", 3, "k006"), ("k001", 1, "k001"), ("k001", 2, "k002"), ("k001", 3, "k004")]


def test_pruned_search_of_clusters(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(20, 16)) * 4
    rows = [(i, (middles[i % 20] + rng.normal(size=16)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, vector array<double>").repartition(3)
    asked = df.where("id % 100 = 0")
    centres = search.fit_cells(df, "vector", search.default_cells(2000), sample_rows=1000)
    pruned, scanned = search.pruned_top_k(df, asked, 10, "id", "vector", centres, 6)
    exact = {(r["query_id"], r["id"]) for r in search.batch_top_k(df, asked, 10, "id", "vector").collect()}
    found = {(r["query_id"], r["id"]) for r in pruned.collect()}
    assert len(found & exact) >= 0.9 * len(exact) and scanned.agg({"scanned": "avg"}).first()[0] <= 0.1 * 2000
    all_of_it, _ = search.pruned_top_k(df, asked, 10, "id", "vector", centres, len(centres))
    assert {(r["query_id"], r["id"]) for r in all_of_it.collect()} == exact
    none, counted = search.pruned_top_k(df, asked.limit(0), 10, "id", "vector", centres, 2)
    assert none.count() == 0 and counted.count() == 0


def test_address_of_the_first_chunk(spark):
    hits = spark.createDataFrame([(1, "generic", "https://d.example/p#7", "p.md", 7, 0.9, 1)], HITS)
    chunks = spark.createDataFrame([("p.md", 7, "b", "https://d.example/p#7"), ("p.md", 1, "a", "https://d.example/p"), ("p.md", 0, " ", "https://d.example/none")], "file_path string, chunk_index int, content_text string, citation_url string")
    assert search.expand_top_document(hits, chunks, "page").first()["citation_url"] == "https://d.example/p"
    assert search.expand_top_document(hits, chunks.limit(0), "page").first()["citation_url"] == "https://d.example/p#7"


def test_text_and_citations_of_the_older_tool(spark):
    hits = spark.createDataFrame([(2, 0.25, "b.md", "u", "two"), (1, 0.5, "a.md", "u", "one"), (3, 0.1, "c.md", "", "")], "rank int, similarity double, file_path string, citation_url string, content_text string")
    found = search.tool_result(hits).first()
    assert found["citations"] == ["u"] and found["output"].startswith("File: a.md\nContent: one\nURL: u\nSimilarity: 0.500\n\nFile: b.md")
    assert search.tool_result(hits.limit(0)).first()["output"] == search.NO_RESULTS
    assert tuple(search.tool_result(hits, "other").first()) == ("Unknown tool: other", [])


def test_unsafe_filter_values():
    assert search.safe_filter_value("repo", "o/r-1.x_y") == "o/r-1.x_y"
    for value in ("a b", "x'", 'a" or 1==1', "", None):
        with pytest.raises(ValueError):
            search.safe_filter_value("repo", value)


def test_rerank_and_expansion(spark):
    hits = spark.createDataFrame([(1, "generic", "https://d.example/start", "start.md", 0, 0.90, 1), (2, "hit", "https://d.example/gpu-quota", "gpu-quota.md", 6, 0.82, 2)], HITS)
    chunks = spark.createDataFrame(
        [("gpu-quota.md", 11, "second", "https://d.example/gpu-quota"), ("gpu-quota.md", 6, " first ", "https://d.example/gpu-quota"), ("gpu-quota.md", 6, "first", "u"), ("start.md", 0, "other", "u"), ("gpu-quota.md", 12, "  ", "u")],
        "file_path string, chunk_index int, content_text string, citation_url string",
    )
    found = search.expand_top_document(hits, chunks, "What is the quota?")
    assert found.first()["content_text"] == "first\n\nsecond"
    output = search.rendered(found, "docs").first()["output"]
    assert output == "### Result 1 (score: 0.8200)\n**Source:** https://d.example/gpu-quota\n**File:** gpu-quota.md\n\nfirst\n\nsecond\n"


def test_hits_without_source_fall_back_to_the_first(spark):
    hits = spark.createDataFrame([(1, "a", None, "", 0, 0.5, 1), (2, "b", "", None, 0, 0.9, 2)], HITS)
    assert search.top_document(hits, "query").first()["id"] == 1


def test_budget(spark):
    rows = [("d", i, chr(97 + i) * 10_000) for i in range(4)]
    found = search.budgeted_context(spark.createDataFrame(rows, "doc string, chunk_index int, content_text string"), ["doc"]).first()
    expected, used = [], 0
    for _, _, content in rows:
        room = 24_000 - used - (2 if expected else 0)
        if room <= 0:
            break
        expected.append(content[:room])
        used += min(len(content), room) + (2 if len(expected) > 1 else 0)
    assert found["context"] == "\n\n".join(expected) and found["n_chunks"] == 3


def test_empty_results(spark):
    empty = spark.createDataFrame([], HITS + ", repo_name string, issue_number int, issue_state string, issue_labels string")
    assert search.rendered(empty, "issues").first()["output"] == search.EMPTY["issues"]


def test_code_entry(spark):
    schema = "rank int, score double, citation_url string, file_path string, resource_kind string, resource_name string, resource_namespace string, file_type string, content_text string"
    rows = [(1, 0.5, "u", "p", "Notebook", "n", "s", "yaml", "text"), (2, 0.25, None, "q", "", "", "", "", "more")]
    output = search.rendered(spark.createDataFrame(rows, schema), "code").first()["output"]
    assert "**Resource:** Notebook `n` (namespace: s)\n**Type:** yaml\n\n```\ntext\n```\n\n---\n### Result 2 (score: 0.2500)\n**Source:** \n**File:** q\n\n```\nmore" in output


def test_a_failed_search_says_why(spark):
    corpus = spark.createDataFrame([(1, "text", "u", "r", 7, "open", "", [1.0])], "id int, content_text string, citation_url string, repo_name string, issue_number int, issue_state string, issue_labels string, vector array<double>")
    ask = lambda **where: search.answered(spark, lambda: search.search_issues(corpus, [1.0], 5, **where), "issues").first()["output"]
    assert ask(repo="r").startswith("### Result 1 (score: 1.0000)") and ask(state="closed") == search.EMPTY["issues"]
    assert ask(repo="a b").startswith("Search failed: repo may hold")
