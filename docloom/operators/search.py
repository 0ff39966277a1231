"""Filtered nearest-neighbour search, reranking, context expansion and rendering."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import filled, snippet, stems
from docloom.functions.cleaning import strip
from docloom.operators.physical import materialize

CONTEXT_CHUNKS, CONTEXT_CHARS = 20, 24_000
#: Queries of a batch search are broadcast in groups of about so many bytes, each group
#: with one scan of the corpus, and compared in blocks of so many.
QUERY_BYTES, QUERY_BLOCK = 64 << 20, 512
#: Scores are rounded to so many places, so that equal vectors have equal scores.
SCORE_PLACES = 12

#: Fixed value: what a filter value may be made of.
_SAFE = re.compile(r"[A-Za-z0-9_/.-]+")


def safe_filter_value(name: str, value: str) -> str:
    """``value`` if it is made of plain characters only, else ValueError."""
    if not _SAFE.fullmatch(value or ""):
        raise ValueError(f"{name} may hold letters, digits and _ / . - only: {value!r}")
    return value


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; NULL if a vector has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def normalized(vector: Column) -> Column:
    norm = F.nullif(F.sqrt(dot(vector, vector)), F.lit(0.0))
    return F.transform(vector, lambda x: (x.cast("double") / norm).cast("float"))


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of an Arrow list column without NULLs as rows of length 1, and which have a length."""
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(norm > 0, norm, 1)[:, None], norm > 0


def top_k(corpus: DataFrame, query: list[float], k: int, key: str, vector: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """The ``k`` most similar rows: ``columns``, ``score``, ``rank`` from 1.

    The filter applies before the limit, as a filter of the scan; ties go to the
    lower key.  Rows without vector, or with one of no length, are left out.  Each
    Arrow batch is scored by array operations and gives its ``k`` best rows.
    """
    asked = np.array(query, np.float64)
    asked = asked / max(float(np.sqrt(asked @ asked)), 1e-300)
    rows = (corpus if where is None else corpus.where(where)).where(F.col(vector).isNotNull())
    taken = rows.select(key, *[c for c in columns if c != key], F.col(vector).alias("_vector"))
    schema = T.StructType([*taken.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, long = unit_rows(batch.column(batch.num_columns - 1))
            scores = np.round(np.einsum("ij,j->i", x, asked), SCORE_PLACES) if len(x) else np.zeros(0)
            scored = pa.table([*batch.columns[:-1], pa.array(scores)], names=schema.names).filter(pa.array(long))
            best = scored.sort_by([("score", "descending"), (key, "ascending")]).slice(0, k)
            yield from best.to_batches()

    best = taken.mapInArrow(nearest, schema).orderBy(F.col("score").desc(), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), key)))


def _best_pairs(scores: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` highest scores of each column; of equal ones the first in ``order``."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
        row, column = np.nonzero(scores >= cut)
    else:
        row, column = (x.ravel() for x in np.indices(scores.shape))
    place = np.lexsort((order[row], -scores[row, column], column))
    row, column = row[place], column[place]
    nth = np.arange(len(column)) - np.searchsorted(column, column)
    return row[nth < k], column[nth < k]


def _matched(corpus: DataFrame, key: str, vector: str, names: list, matrix: np.ndarray, k: int, centres: np.ndarray | None = None, probed: np.ndarray | None = None) -> DataFrame:
    """``query_id, found, score`` and, with cells, ``scanned``: the best rows of each batch for each query.

    The queries are broadcast.  With ``centres`` a row meets only the queries that
    probe its cell; ``scanned`` counts these rows, in rows without ``found``.
    """
    kind = corpus.schema[key].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("found", kind), T.StructField("score", T.DoubleType()), T.StructField("scanned", T.LongType())])
    shared = corpus.sparkSession.sparkContext.broadcast((names, matrix, centres, probed))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, centres, probed = shared.value
        scanned = np.zeros(len(names), np.int64)
        typed = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            typed = pa.array(names, keys.type) if typed is None else typed
            x, _ = unit_rows(batch.column(1))
            order = np.argsort(np.argsort(keys.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
            if centres is None:
                groups = [(np.arange(len(x)), np.arange(at, min(at + QUERY_BLOCK, len(names)))) for at in range(0, len(names), QUERY_BLOCK)]
            else:
                cell = np.argmax(x @ centres.T, axis=1)
                groups = []
                for c in np.unique(cell):
                    asked = np.flatnonzero(probed[:, c])
                    scanned[asked] += int((cell == c).sum())
                    groups += [(np.flatnonzero(cell == c), asked[at : at + QUERY_BLOCK]) for at in range(0, len(asked), QUERY_BLOCK)]
            for rows, asked in groups:
                scores = np.round(x[rows] @ matrix[asked].T, SCORE_PLACES)
                row, column = _best_pairs(scores, order[rows], k)
                columns = [typed.take(pa.array(asked[column])), keys.take(pa.array(rows[row])), pa.array(scores[row, column]), pa.nulls(len(row), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        if centres is not None and scanned.any():
            yield pa.RecordBatch.from_arrays([typed, pa.nulls(len(names), typed.type), pa.nulls(len(names), pa.float64()), pa.array(scanned)], names=schema.names)

    return corpus.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(nearest, schema)


def _query_groups(queries: DataFrame, key: str, vector: str, block: int | None) -> Iterator[tuple[list, np.ndarray]]:
    """Keys and unit vectors of the queries, in groups of at most about QUERY_BYTES."""
    asked = queries.where(F.col(vector).isNotNull()).select(key, vector)
    count, wide = asked.agg(F.count("*"), F.max(F.size(vector))).first()
    groups = -(-count // (block or max(1, QUERY_BYTES // (8 * (wide or 1)))))
    for at in range(groups):
        taken = asked.where(F.pmod(F.xxhash64(key), F.lit(groups)) == at).collect()  # bounded by the group's size
        if taken:
            matrix = np.array([r[1] for r in taken], np.float64)
            yield [r[0] for r in taken], matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def _ranked(parts: list[DataFrame], corpus: DataFrame, k: int, key: str) -> DataFrame:
    if not parts:
        return corpus.limit(0).select(F.col(key).alias("query_id"), key, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    found = reduce(DataFrame.unionByName, parts).where("scanned is null")
    window = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "found")
    ranked = found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("found").alias(key), "score", "rank")


def batch_top_k(corpus: DataFrame, queries: DataFrame, k: int, key: str, vector: str, block: int | None = None) -> DataFrame:
    """``query_id, key, score, rank``: the ``k`` nearest rows of each query.

    Queries are broadcast in groups of bounded size (``block`` queries, by default
    what fits into QUERY_BYTES); for each group the corpus is scanned once, matrix
    products of each Arrow batch leave k candidates a query, and a window over these
    picks the winners.  Nothing of the corpus is shuffled but the candidates.
    """
    return _ranked([_matched(corpus, key, vector, names, matrix, k) for names, matrix in _query_groups(queries, key, vector, block)], corpus, k, key)


def top_document(hits: DataFrame, query: str) -> DataFrame:
    """The hit whose address and path share most word stems with the query.

    Ties go to the higher score, then the better rank.  Hits without address and
    path do not take part; if none has either, the first hit stays.
    """
    where = F.concat_ws(" ", filled(F.col("citation_url")), filled(F.col("file_path")))
    asked = stems(F.lit(query))
    named = (filled(F.col("citation_url")) != "") | (filled(F.col("file_path")) != "")
    overlap = F.when(named, F.size(F.array_intersect(asked, stems(where)))).otherwise(-1)
    return hits.withColumn("overlap", overlap).orderBy(F.col("overlap").desc(), F.when(named, F.col("score")).desc_nulls_last(), "rank").limit(1)


def budgeted_context(chunks: DataFrame, by: list[str], max_chunks: int = CONTEXT_CHUNKS, max_chars: int = CONTEXT_CHARS) -> DataFrame:
    """One bounded text for each document: chunks in order, joined by blank lines.

    Equal chunks at the same index count once; at most ``max_chunks`` chunks are
    taken, from the lowest index; the chunk that crosses ``max_chars`` is cut.
    """
    content = strip(filled(F.col("content_text")))
    unique = chunks.select(*by, "chunk_index", content.alias("content")).where("content <> ''").distinct()
    ordered = Window.partitionBy(*by).orderBy("chunk_index", "content")
    taken = unique.withColumn("nth", F.row_number().over(ordered)).where(F.col("nth") <= max_chunks)
    before = F.coalesce(F.sum(F.length("content") + 2).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = taken.withColumn("room", F.lit(max_chars) - before).where("room > 0")
    cut = room.select(*by, "nth", F.expr("substring(content, 1, cast(room as int))").alias("content"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("nth", "content"))), lambda x: x["content"])
    return cut.groupBy(*by).agg(F.array_join(pieces, "\n\n").alias("context"), F.count("*").alias("n_chunks"))


def expand_top_document(hits: DataFrame, chunks: DataFrame, query: str) -> DataFrame:
    """The best document of ``hits`` with bounded, ordered context from ``chunks``.

    The join is on the path only; the address is that of the first chunk.  A
    document without stored chunks keeps the text and address of its hit.  The best
    hit, one row, is written first, so that the search runs once.
    """
    best = materialize(top_document(hits, query), "best")
    stored = chunks.join(F.broadcast(best.select("file_path")), "file_path", "left_semi")  # one row
    context = budgeted_context(stored, ["file_path"])
    content = strip(filled(F.col("content_text")))
    first = stored.where(content != "").groupBy("file_path").agg(F.min_by("citation_url", F.struct("chunk_index", content, "citation_url")).alias("first_url"))
    joined = best.join(context, "file_path", "left").join(first, "file_path", "left")
    joined = joined.withColumn("content_text", F.coalesce("context", "content_text")).withColumn("citation_url", F.when(F.col("context").isNull(), F.col("citation_url")).otherwise(F.col("first_url")))
    return joined.drop("context", "first_url").withColumn("rank", F.lit(1))


#: Fixed values, in the three entries below: how results are worded.
def _score(score: Column) -> Column:
    return F.format_string("%.4f", score)


def docs_entry() -> Column:
    return F.concat(
        F.lit("### Result "), F.col("rank"), F.lit(" (score: "), _score(F.col("score")), F.lit(")\n**Source:** "), filled(F.col("citation_url")),
        F.lit("\n**File:** "), filled(F.col("file_path")), F.lit("\n\n"), filled(F.col("content_text")), F.lit("\n"),
    )


def issue_entry() -> Column:
    number = F.when(F.coalesce(F.col("issue_number"), F.lit(0)) != 0, F.concat(F.lit("\n**Issue:** #"), F.col("issue_number")))
    state = F.when(filled(F.col("issue_state")) != "", F.concat(F.lit(" ("), F.col("issue_state"), F.lit(")")))
    labels = F.when(filled(F.col("issue_labels")) != "", F.concat(F.lit("\n**Labels:** "), F.col("issue_labels")))
    return F.concat(
        F.lit("### Result "), F.col("rank"), F.lit(" (score: "), _score(F.col("score")), F.lit(")\n**Source:** "), filled(F.col("citation_url")),
        F.lit("\n**Repo:** "), filled(F.col("repo_name")), filled(number), filled(state), filled(labels), F.lit("\n\n"), filled(F.col("content_text")), F.lit("\n"),
    )


def code_entry() -> Column:
    kind, name, space = (filled(F.col(c)) for c in ("resource_kind", "resource_name", "resource_namespace"))
    shown = F.concat(
        F.lit("\n**Resource:** "), kind, F.when(name != "", F.concat(F.lit(" `"), name, F.lit("`"))).otherwise(""),
        F.when(space != "", F.concat(F.lit(" (namespace: "), space, F.lit(")"))).otherwise(""),
    )
    kind_line = F.when(filled(F.col("file_type")) != "", F.concat(F.lit("\n**Type:** "), F.col("file_type")))
    return F.concat(
        F.lit("### Result "), F.col("rank"), F.lit(" (score: "), _score(F.col("score")), F.lit(")\n**Source:** "), filled(F.col("citation_url")),
        F.lit("\n**File:** "), filled(F.col("file_path")), F.when((kind != "") | (name != ""), shown).otherwise(""), filled(kind_line),
        F.lit("\n\n```\n"), filled(F.col("content_text")), F.lit("\n```\n"),
    )


#: What a search that fails, or has no hits, says.
FAILED = "Search failed"
EMPTY = {"docs": "No results found for your query.", "issues": "No issues found for your query.", "code": "No code results found for your query."}


def rendered(hits: DataFrame, kind: str, by: list[str] | None = None) -> DataFrame:
    """All entries of a result as one markdown text (of each group ``by``)."""
    entry = {"docs": docs_entry, "issues": issue_entry, "code": code_entry}[kind]()
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry")))), lambda x: x["entry"])
    output = F.when(F.count("*") == 0, F.lit(EMPTY[kind])).otherwise(F.array_join(texts, "\n---\n")).alias("output")
    return hits.groupBy(*by).agg(output) if by else hits.agg(output)


def answered(spark: SparkSession, find: Callable[[], DataFrame], kind: str) -> DataFrame:
    """One row ``output``: the rendered result of a search, or the text that tells why it failed.

    The search is run, as a failure shows only then; its result is one text.
    """
    try:
        output = rendered(find(), kind).first()["output"]
    except Exception as error:
        output = f"{FAILED}: {str(error).splitlines()[0] if str(error) else type(error).__name__}"
    return spark.createDataFrame([(output,)], "output string")


def search_docs(corpus: DataFrame, query: str, vector: list[float], k: int = 5) -> DataFrame:
    """The best document for a question, with its context from all chunks of ``corpus``."""
    hits = top_k(corpus, vector, k, "id", "vector", ["content_text", "citation_url", "file_path", "chunk_index"])
    return expand_top_document(hits, corpus, query)


def search_issues(corpus: DataFrame, vector: list[float], k: int = 5, repo: str = "", state: str = "") -> DataFrame:
    where = F.lit(True)
    if repo:
        where = where & (F.col("repo_name") == safe_filter_value("repo", repo))
    if state:
        where = where & (F.col("issue_state") == safe_filter_value("state", state))
    return top_k(corpus, vector, k, "id", "vector", ["content_text", "citation_url", "repo_name", "issue_number", "issue_state", "issue_labels"], where)


def search_code(corpus: DataFrame, vector: list[float], k: int = 5, resource_kind: str = "") -> DataFrame:
    where = F.col("resource_kind") == safe_filter_value("resource_kind", resource_kind) if resource_kind else None
    columns = ["content_text", "citation_url", "file_path", "resource_kind", "resource_name", "resource_namespace", "file_type"]
    return top_k(corpus, vector, k, "id", "vector", columns, where)


#: What the older tool says without results and of other tools, and its name.
NO_RESULTS, LEGACY_TOOL = "No relevant results found.", "search_docs"


def tool_result(hits: DataFrame, tool: str = LEGACY_TOOL) -> DataFrame:
    """One row: ``output``, the text that the older tool returns, and ``citations`` in order of rank.

    ``hits`` are ``legacy_results``.  Another tool's name gives a text that says so.
    """
    entry = F.concat(
        F.lit("File: "), F.coalesce("file_path", F.lit("Unknown")), F.lit("\nContent: "), filled(F.col("content_text")), F.lit("\nURL: "), filled(F.col("citation_url")),
        F.lit("\nSimilarity: "), F.format_string("%.3f", F.coalesce("similarity", F.lit(0.0))), F.lit("\n"),
    )
    rows = hits if tool == LEGACY_TOOL else hits.limit(0)
    ordered = F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry"), filled(F.col("citation_url")).alias("url"))))
    empty = F.lit(NO_RESULTS if tool == LEGACY_TOOL else f"Unknown tool: {tool}")
    urls = F.array_distinct(F.filter(F.transform(ordered, lambda x: x["url"]), lambda u: u != ""))
    return rows.agg(F.when(F.count("*") == 0, empty).otherwise(F.array_join(F.transform(ordered, lambda x: x["entry"]), "\n")).alias("output"), urls.alias("citations"))


def legacy_results(hits: DataFrame) -> DataFrame:
    """Results of the older tool: distance and a short snippet."""
    return hits.select("rank", (1 - F.col("score")).alias("similarity"), filled(F.col("file_path")).alias("file_path"),
                       filled(F.col("citation_url")).alias("citation_url"), snippet(filled(F.col("content_text"))).alias("content_text"))


def fit_cells(corpus: DataFrame, vector: str, cells: int, sample_rows: int = 10_000, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of ``cells`` cells, fitted on about ``sample_rows`` rows, twice as many at most.

    The sample is bounded by the parameter and picked by a hash of the vectors, so it
    does not depend on the order of the rows; every row is indexed afterwards.
    """
    rows = corpus.where(F.col(vector).isNotNull())
    total = rows.count()
    if total == 0:
        return np.zeros((1, 1))
    share = min(1_000_000, max(1, 1_000_000 * sample_rows // total))
    picked = rows.select(vector).where(F.pmod(F.xxhash64(vector, F.lit(seed)), F.lit(1_000_000)) < share)
    taken = sorted(picked.limit(2 * sample_rows).collect()) or rows.select(vector).limit(1).collect()
    x = np.array([r[0] for r in taken], np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    centres = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].mean(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    return centres


def default_cells(rows: int) -> int:
    """Twice the square root of the rows, 1024 at most."""
    return max(1, min(1024, rows, round(2 * rows**0.5)))


def pruned_top_k(corpus: DataFrame, queries: DataFrame, k: int, key: str, vector: str, centres: np.ndarray, probes: int) -> tuple[DataFrame, DataFrame]:
    """``query_id, key, score, rank`` from the ``probes`` nearest cells of each query only, and ``query_id, scanned``.

    Every row has the cell of its nearest centre.  Queries are broadcast in groups, as
    in ``batch_top_k``, and meet the rows of the cells that they probe, so that no
    cell is gathered.  The recall depends on ``probes`` and must be measured
    against ``batch_top_k``; ``scanned`` tells how many rows each query met.
    """
    parts = []
    for names, matrix in _query_groups(queries, key, vector, None):
        probed = np.zeros((len(names), len(centres)), bool)
        np.put_along_axis(probed, np.argsort(-(matrix @ centres.T), axis=1, kind="stable")[:, :probes], True, axis=1)
        parts.append(_matched(corpus, key, vector, names, matrix, k, centres, probed))
    scanned = reduce(DataFrame.unionByName, parts).where("scanned is not null").groupBy("query_id").agg(F.sum("scanned").alias("scanned")) if parts else corpus.limit(0).select(F.col(key).alias("query_id"), F.lit(0).cast("long").alias("scanned"))
    return _ranked(parts, corpus, k, key), scanned
