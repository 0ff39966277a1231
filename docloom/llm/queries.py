"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, containers, credentials, handwritten, lookalikes, personal, pieces, repeated_lines, trigrams
from docloom.operators.physical import materialize


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return personal.kinds_found(table(spark, sf, "issues_data"), "id", "body", "comments")


def p1_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return personal.sanitized(table(spark, sf, "issues_data"), "id", "body", "comments")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, sf, "code_data"), "id", "path", "content", "repo")


def p2_handwritten(spark: SparkSession, sf: str) -> DataFrame:
    """The hand-written files, whole."""
    return table(spark, sf, "code_data").join(p2_found(spark, sf), "id", "left_anti")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.credential_lines(table(spark, sf, "code_data"), "id", "path", "content")


def p3_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.redacted(table(spark, sf, "code_data"), "id", "path", "content")


def p3_index(spark: SparkSession, sf: str) -> DataFrame:
    """How many chunks the trigram index leaves to be verified."""
    counted = trigrams.selectivity(table(spark, sf, "code_data"), "content", credentials.PATTERNS)
    return counted.withColumn("share", F.round(F.col("candidates") / F.greatest("chunks", F.lit(1)), 4))


def _by_spec(spark: SparkSession, sf: str, make: Callable) -> DataFrame:
    """Union over the rows of split_specs, a table of fixed size."""
    specs = table(spark, sf, "split_specs").orderBy("spec_id").collect()
    parts = [make(table(spark, sf, s["table_name"]), s).select(F.lit(s["table_name"]).alias("table_name"), "*") for s in specs]
    return reduce(DataFrame.unionByName, parts)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _by_spec(spark, sf, lambda t, s: pieces.oversized(t, "id", s["field_name"], s["max_chars"], s["overlap_chars"]))


def p4_rejoined(spark: SparkSession, sf: str) -> DataFrame:
    """The texts again, from their pieces without the overlaps."""
    rests = p4_pieces(spark, sf).join(F.broadcast(table(spark, sf, "split_specs").select("table_name", "overlap_chars", "max_chars")), "table_name")
    rest = F.when(F.col("piece_no") == 0, F.col("piece")).otherwise(F.expr("substring(piece, cast(overlap_chars as int) + 1)"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("piece_no", rest.alias("rest")))), lambda x: x["rest"])
    return rests.groupBy("table_name", "id").agg(F.array_join(ordered, "").alias("text"), (F.count("*") == 1).alias("one_piece"), F.bool_and(F.length("piece") <= F.col("max_chars")).alias("within_limit"))


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _by_spec(spark, sf, lambda t, s: pieces.split_texts(t, "id", s["field_name"], s["max_chars"], s["overlap_chars"]))


_ISSUES = {"key": "id", "source": "repo_name", "document": "issue_number", "text": "body"}


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_lines.marked_lines(table(spark, sf, "issues_data"), **_ISSUES, published="created_at")


def p5_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_lines.without_lines(table(spark, sf, "issues_data"), **_ISSUES, published="created_at")


def p5_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The repeated lines, with the documents, different texts and days of publication of each."""
    return repeated_lines.repeated(table(spark, sf, "issues_data"), **_ISSUES, published="created_at", min_clusters=1)


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf, "documents"), "doc_id", "text")


def p6_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """The texts again, from their ids; equal to the stored texts (NULL as empty)."""
    return bpe.decode_ids(p6_ids(spark, sf), "doc_id", "ids")


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    sizes = materialize(bpe.count_tokens(table(spark, sf, "documents"), "doc_id", "text"), "sizes")
    specs = table(spark, sf, "pack_specs").select("spec_id", "capacity_tokens")
    capacities = [r["capacity_tokens"] for r in specs.select("capacity_tokens").distinct().collect()]  # a table of parameters
    packed = containers.pack_all(sizes, "doc_id", "n_tokens", capacities)
    return packed.join(F.broadcast(specs), packed["capacity"] == specs["capacity_tokens"]).select("spec_id", "doc_id", "part_no", "start", "length", "container_id")


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers of each spec are."""
    each = p7_containers(spark, sf).groupBy("spec_id", "container_id").agg(F.sum("length").alias("used"))
    specs = table(spark, sf, "pack_specs").select("spec_id", "capacity_tokens")
    return (
        each.join(F.broadcast(specs), "spec_id").groupBy("spec_id", "capacity_tokens")
        .agg(F.count("*").alias("containers"), F.sum("used").alias("used"), F.max("used").alias("fullest"))
        .withColumn("fill", F.round(F.col("used") / (F.col("containers") * F.col("capacity_tokens")), 6))
    )


def p7_facts(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the containers: nothing overfull, no gaps in their numbers, no item split that fits."""
    rows = materialize(p7_containers(spark, sf), "containers")
    specs = F.broadcast(table(spark, sf, "pack_specs").select("spec_id", "capacity_tokens"))
    full = rows.groupBy("spec_id", "container_id").agg(F.sum("length").alias("used")).join(specs, "spec_id")
    by_spec = full.groupBy("spec_id").agg(F.count(F.when(F.col("used") > F.col("capacity_tokens"), 1)).alias("overfull"), (F.max("container_id") + 1 - F.count("*")).alias("gaps"))
    items = rows.groupBy("spec_id", "doc_id").agg(F.count("*").alias("parts"), F.sum("length").alias("size"), F.max(F.col("start") + F.col("length")).alias("end")).join(specs, "spec_id")
    by_item = items.groupBy("spec_id").agg(
        F.count("*").alias("documents"), F.count(F.when((F.col("parts") > 1) & (F.col("size") <= F.col("capacity_tokens")), 1)).alias("split"), F.count(F.when(F.col("size") != F.col("end"), 1)).alias("incomplete")
    )
    return by_spec.join(by_item, "spec_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.same_look_pairs(table(spark, sf, "documents"), "doc_id", "text")


def p8_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.normalize_texts(table(spark, sf, "documents"), "doc_id", "text")


def p8_plain(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of plain characters only, which stay as they are."""
    plain = table(spark, sf, "documents").select("doc_id", F.col("text").rlike(r"\A[\x20-\x7e\n]*\z").alias("plain")).where("plain")
    return p8_normalized(spark, sf).join(plain.select("doc_id"), "doc_id", "left_semi")


_ALL = (p1_found, p1_redacted, p2_found, p2_handwritten, p3_found, p3_redacted, p3_index, p4_found, p4_pieces, p4_rejoined, p5_found, p5_cleaned, p5_lines, p6_ids, p6_decoded, p7_containers, p7_fill, p7_facts, p8_found, p8_normalized, p8_plain)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_LINES_SQL = """lines AS (
              SELECT id, repo_name, issue_number, substr(created_at, 1, 10) AS day, body, unnest(string_split(body, chr(10))) AS line,
                     unnest(range(1, len(string_split(body, chr(10))) + 1)) AS line_no
              FROM issues_data WHERE body IS NOT NULL),
            keyed AS (SELECT *, lower(regexp_replace(line, '[^\\p{L}]', '', 'g')) AS k FROM lines),
            long AS (SELECT * FROM keyed WHERE length(k) >= 20 AND repo_name IS NOT NULL),
            total AS (SELECT repo_name, count(DISTINCT issue_number) AS n FROM issues_data WHERE body IS NOT NULL GROUP BY 1),
            often AS (
              SELECT repo_name, k, count(DISTINCT issue_number) AS n_documents FROM long JOIN total USING (repo_name) GROUP BY repo_name, k, n
              HAVING count(DISTINCT issue_number) >= 4 AND count(DISTINCT issue_number) >= 0.1 * n)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": """
            SELECT 'github_data' AS table_name, id FROM github_data WHERE length(content) > (SELECT max_chars FROM split_specs WHERE table_name = 'github_data')
            UNION ALL SELECT 'issues_data', id FROM issues_data WHERE length(body) > (SELECT max_chars FROM split_specs WHERE table_name = 'issues_data')
            UNION ALL SELECT 'docs_chunks', id FROM docs_chunks WHERE length(content_text) > (SELECT max_chars FROM split_specs WHERE table_name = 'docs_chunks')""",
        "p4_rejoined": """
            WITH texts AS (
              SELECT 'github_data' AS table_name, id, content AS text FROM github_data
              UNION ALL SELECT 'issues_data', id, body FROM issues_data UNION ALL SELECT 'docs_chunks', id, content_text FROM docs_chunks)
            SELECT table_name, id, text, length(text) <= max_chars AS one_piece, true AS within_limit FROM texts JOIN split_specs USING (table_name) WHERE text IS NOT NULL""",
        "p5_found": f"WITH {_LINES_SQL} SELECT id, CAST(line_no AS BIGINT) AS line_no FROM long SEMI JOIN often USING (repo_name, k)",
        "p5_lines": f"""
            WITH {_LINES_SQL},
            firsts AS (SELECT repo_name, issue_number, body, min(issue_number) OVER (PARTITION BY repo_name, body) AS first
                       FROM issues_data WHERE repo_name IS NOT NULL AND body IS NOT NULL AND issue_number IS NOT NULL),
            cluster AS (SELECT repo_name, issue_number, min(first) AS cluster FROM firsts GROUP BY 1, 2)
            SELECT repo_name AS source, min(line) AS line, any_value(n_documents) AS n_documents, count(DISTINCT cluster) AS n_clusters,
                   count(DISTINCT day) FILTER (issue_number IS NOT NULL) AS n_days
            FROM long JOIN often USING (repo_name, k) LEFT JOIN cluster USING (repo_name, issue_number) GROUP BY repo_name, k""",
        "p5_cleaned": f"""
            WITH {_LINES_SQL},
            kept AS (SELECT id, line, line_no, NOT (length(k) >= 20 AND EXISTS (SELECT 1 FROM often o WHERE o.repo_name = keyed.repo_name AND o.k = keyed.k)) AS stays FROM keyed)
            SELECT id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (stays), '') AS body FROM kept GROUP BY id
            UNION ALL SELECT id, body FROM issues_data WHERE body IS NULL""",
        "p7_facts": "SELECT spec_id, 0::BIGINT AS overfull, 0::BIGINT AS gaps, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS split, 0::BIGINT AS incomplete FROM pack_specs",
        "p8_plain": r"SELECT doc_id, text AS form FROM documents WHERE regexp_full_match(text, '[\x20-\x7e\n]*')",
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
