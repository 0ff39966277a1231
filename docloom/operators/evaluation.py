"""Scoring of tool outputs and answers against a golden set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import answer_urls, source_urls


def missing(wanted: Column, text: Column) -> Column:
    """The wanted strings that ``text`` does not contain (case matters)."""
    return F.filter(F.coalesce(wanted, F.array().cast("array<string>")), lambda w: ~F.contains(text, w))


#: Fixed value: how many results a golden question asks for.
GOLDEN_TOP_K = 10


def retrieval_requests(golden: DataFrame, tools: list[str], top_k: int = GOLDEN_TOP_K) -> DataFrame:
    """``id, tool, query, top_k`` of each golden row, to be sent to its tool.

    ``retrieval_query`` is asked where there is one, the words of the user else.
    A row with a tool that is not known is an error when it is read.
    """
    known = F.when(F.col("tool").isin(tools), F.col("tool")).otherwise(F.raise_error(F.concat(F.lit("unsupported tool: "), F.coalesce("tool", F.lit("NULL")))))
    return golden.select("id", known.alias("tool"), F.coalesce("retrieval_query", "query").alias("query"), F.lit(top_k).alias("top_k"))


def retrieval_gate(rows: DataFrame) -> DataFrame:
    """Passed if each expected address is among the Source lines of ``output``.

    Missing evidence strings are told but do not block.
    """
    found = source_urls(F.coalesce("output", F.lit("")))
    out = rows.withColumn("source_urls", found).withColumn("missing_sources", F.array_sort(F.array_except("expected_source_urls", "source_urls")))
    out = out.withColumn("missing_evidence", missing(F.col("must_appear_in_answer"), F.coalesce("output", F.lit(""))))
    return out.withColumn("passed", F.size("missing_sources") == 0)


def coverage(wanted: DataFrame, shown: DataFrame, by: str, url: str) -> DataFrame:
    """``by, n_expected, n_missing, passed``: the retrieval gate for address sets of any size.

    Both sides are made distinct and joined on both columns, so no group is
    gathered.  Groups without wanted addresses do not appear.
    """
    hits = shown.select(by, url).distinct().withColumn("_hit", F.lit(1))
    joined = wanted.select(by, url).distinct().join(hits, [by, url], "left")
    counted = joined.groupBy(by).agg(F.count("*").alias("n_expected"), (F.count("*") - F.count("_hit")).alias("n_missing"))
    return counted.withColumn("passed", F.col("n_missing") == 0)


def answer_gate(rows: DataFrame) -> DataFrame:
    """Passed if the tool fired and the answer invents, misses and says nothing wrong.

    ``rows`` have ``answer, tool_fired, allowed_urls`` and the golden strings.
    """
    out = rows.withColumn("cited_urls", answer_urls(F.coalesce("answer", F.lit(""))))
    out = out.withColumn("invented_urls", F.array_sort(F.array_except("cited_urls", "allowed_urls")))
    out = out.withColumn("missing_strings", missing(F.col("must_appear_in_answer"), F.coalesce("answer", F.lit(""))))
    forbidden = F.filter(F.coalesce("forbidden_in_answer", F.array().cast("array<string>")), lambda w: F.contains(F.coalesce("answer", F.lit("")), w))
    out = out.withColumn("forbidden_strings", forbidden)
    clean = (F.size("invented_urls") == 0) & (F.size("missing_strings") == 0) & (F.size("forbidden_strings") == 0)
    return out.withColumn("passed", F.col("tool_fired") & clean)


def gated(first: DataFrame, second: DataFrame) -> DataFrame:
    """``id, retrieved, passed, status`` of each row: answers count only where retrieval passed.

    ``status`` is ``blocked``, ``failed`` or ``passed``; a row without answer has failed.
    """
    rows = first.select("id", F.col("passed").alias("retrieved")).join(second.select("id", F.col("passed").alias("answered")), "id", "left")
    passed = F.col("retrieved") & F.coalesce("answered", F.lit(False))
    status = F.when(~F.col("retrieved"), "blocked").when(passed, "passed").otherwise("failed")
    return rows.select("id", "retrieved", passed.alias("passed"), status.alias("status"))


def exit_code(gate_one: DataFrame, gate_two: DataFrame | None = None) -> int:
    """0 if all passed, 1 if retrieval is blocked, 2 if an answer failed."""
    if not gate_one.agg(F.coalesce(F.bool_and("passed"), F.lit(True))).first()[0]:
        return 1
    if gate_two is not None and not gate_two.agg(F.coalesce(F.bool_and("passed"), F.lit(True))).first()[0]:
        return 2
    return 0


def selected_rows(golden: DataFrame, ids: list[str]) -> DataFrame:
    """The rows with these ids, repeated rows too; an unknown id is an error."""
    found = golden.where(F.col("id").isin(ids))
    unknown = set(ids) - {r["id"] for r in found.select("id").distinct().collect()}  # as many as ids asked for
    if unknown:
        raise ValueError(f"unknown ids: {sorted(unknown)}")
    return found
