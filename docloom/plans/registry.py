"""All registered queries of the core operators, each with its SQL where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import schema as S
from docloom.functions import cleaning, splitting, text
from docloom.functions.html import html_to_text, markdown_to_html
from docloom.operators import embedding, evaluation, search, store
from docloom.operators.physical import materialize, shared_dir, spread
from docloom.plans import ingest
from docloom.sources import files
from docloom.sources.files import capped_per_repo, is_code, is_doc, nested_comments
from docloom.streaming import chat, sessions

QUESTION = "How does the pipeline runner treat a stale route in a notebook namespace?"
BASE_URL = "https://docs.tidegrid.example/docs"

#: SQL: a class of all white space, and helpers that several queries share.
_WS = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TRIM = rf"regexp_replace(%s, '^{_WS}+|{_WS}+$', '', 'g')"
_QUERY = "(SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0)"
_COSINE = "list_cosine_similarity(embedding::DOUBLE[], q.e)"
_STEMS = "list_distinct(list_transform(list_filter(regexp_extract_all(%s, '[A-Za-z0-9]+'), lambda t: length(t) >= 4), lambda t: lower(t[1:6])))"
#: SQL: how often each letter occurs, as vectors of texts and of the question.
_PROFILE = "list_transform(range(97, 123), lambda letter: CAST(length(%s) - length(replace(replace(%s, chr(CAST(letter AS INT)), ''), chr(CAST(letter - 32 AS INT)), '')) AS DOUBLE))"
_PROFILE_COSINE = f"list_cosine_similarity({_PROFILE}, {_PROFILE})"


def _profile_score(column: str) -> str:
    question = f"'{QUESTION}'"
    return _PROFILE_COSINE % (column, column, question, question)


_HITS = f"""hits AS (
  SELECT c.*, {_profile_score("content_text")} AS score FROM docs_chunks c WHERE regexp_matches(content_text, '[A-Za-z]')
  ORDER BY score DESC, c.id LIMIT 10),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM hits)"""

_REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(make: Callable[[SparkSession, str], DataFrame]):
        _REGISTRY[make.__name__] = (make, sql)
        return make

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: make for name, (make, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTRY.items() if sql}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _long(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def _question_vector(spark: SparkSession, sf: str) -> list[float]:
    """The stored vector 0 stands for the embedded question."""
    return list(table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"])


def _profiled(rows: DataFrame, column: str) -> DataFrame:
    """Every row with the letter profile of its text as vector."""
    return spread(rows).withColumn("vector", embedding.letter_profile(F.col(column)))


def _question_profile(spark: SparkSession) -> list[float]:
    return list(spark.range(1).select(embedding.letter_profile(F.lit(QUESTION))).first()[0])


def _hits(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    columns = ["content_text", "citation_url", "file_path", "chunk_index"]
    return search.top_k(_profiled(table(spark, sf, "docs_chunks"), "content_text"), _question_profile(spark), k, "id", "vector", columns)


# --- search -----------------------------------------------------------------


@query(f"""SELECT vec_id, round({_COSINE}, 6) AS score, CAST(row_number() OVER (ORDER BY {_COSINE} DESC, vec_id) AS BIGINT) AS rank
           FROM embeddings, {_QUERY} q ORDER BY {_COSINE} DESC, vec_id LIMIT 5""")
def knn_top5(spark, sf):
    found = search.top_k(table(spark, sf, "embeddings"), _question_vector(spark, sf), 5, "vec_id", "embedding", [])
    return found.select("vec_id", F.round("score", 6).alias("score"), _long("rank"))


@query(f"""SELECT vec_id, round({_COSINE}, 6) AS score, CAST(row_number() OVER (ORDER BY {_COSINE} DESC, vec_id) AS BIGINT) AS rank
           FROM embeddings, {_QUERY} q WHERE label = 3 ORDER BY {_COSINE} DESC, vec_id LIMIT 10""")
def knn_filtered_label(spark, sf):
    found = search.top_k(table(spark, sf, "embeddings"), _question_vector(spark, sf), 10, "vec_id", "embedding", [], F.col("label") == 3)
    return found.select("vec_id", F.round("score", 6).alias("score"), _long("rank"))


@query("""SELECT query_id, vec_id, round(s, 6) AS score, CAST(r AS BIGINT) AS rank FROM (
            SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s,
                   row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS r
            FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE r <= 5""")
def knn_batch_topk(spark, sf):
    """The query set is stated: every row whose number 100 divides, against all rows."""
    corpus = table(spark, sf, "embeddings")
    found = search.batch_top_k(corpus, corpus.where(F.col("vec_id") % 100 == 0), 5, "vec_id", "embedding")
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), _long("rank"))


def _recall(corpus: DataFrame, key: str, vector: str, probes: float, least: int = 8) -> DataFrame:
    """Recall of the pruned search against the exact one, and the share of the rows that a query met."""
    asked = corpus.where(F.col(key) % 100 == 0)
    rows = corpus.where(F.col(vector).isNotNull()).count()
    centres = search.fit_cells(corpus, vector, search.default_cells(rows))
    exact = search.batch_top_k(corpus, asked, 10, key, vector).select("query_id", key)
    pruned, scanned = search.pruned_top_k(corpus, asked, 10, key, vector, centres, max(least, round(probes * len(centres))))
    met = exact.join(pruned.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    found = met.agg(F.count("*").alias("wanted"), F.count("hit").alias("found"), (F.count("hit") / F.count("*")).alias("recall"))
    return found.crossJoin(scanned.agg((F.avg("scanned") / F.lit(max(rows, 1))).alias("scanned")))  # one row each


@query()
def knn_pruned_recall(spark, sf):
    """The stored vectors point everywhere alike, so most cells must be probed for a recall of 0.9."""
    return _recall(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.6)


@query()
def knn_pruned_chunks(spark, sf):
    """Letter profiles of chunks lie in groups: few of the cells are enough."""
    chunks = _profiled(table(spark, sf, "docs_chunks").where("content_text rlike '[A-Za-z]'"), "content_text")
    return _recall(materialize(chunks.select("id", "vector"), "profiles"), "id", "vector", 0.06)


@query(f"""WITH {_HITS} SELECT CAST(rank AS BIGINT) AS rank, round(1 - score, 6) AS similarity, coalesce(file_path, '') AS file_path, coalesce(citation_url, '') AS citation_url,
           CASE WHEN length(coalesce(content_text, '')) > 400 THEN substr(content_text, 1, 400) || '...' ELSE coalesce(content_text, '') END AS content_text FROM ranked""")
def legacy_search(spark, sf):
    out = search.legacy_results(_hits(spark, sf))
    return out.withColumn("similarity", F.round("similarity", 6)).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_HITS} SELECT string_agg('File: ' || coalesce(file_path, '') || chr(10) || 'Content: ' || CASE WHEN length(coalesce(content_text, '')) > 400 THEN substr(content_text, 1, 400) || '...' ELSE coalesce(content_text, '') END
             || chr(10) || 'URL: ' || coalesce(citation_url, '') || chr(10) || 'Similarity: ' || printf('%.3f', 1 - score) || chr(10), chr(10) ORDER BY rank) AS output,
             (SELECT string_agg(citation_url, ' ' ORDER BY first) FROM (SELECT citation_url, min(rank) AS first FROM ranked WHERE coalesce(citation_url, '') <> '' GROUP BY 1)) AS citations FROM ranked""")
def legacy_tool(spark, sf):
    """Text and citations that the older tool returns together."""
    return search.tool_result(search.legacy_results(_hits(spark, sf))).withColumn("citations", F.array_join("citations", " "))


_OVERLAP = f"""len(list_intersect({_STEMS % f"'{QUESTION}'"}, {_STEMS % "concat_ws(' ', coalesce(citation_url, ''), coalesce(file_path, ''))"}))"""
_BEST = f"""best AS (SELECT *, {_OVERLAP} AS overlap FROM ranked WHERE coalesce(citation_url, '') <> '' OR coalesce(file_path, '') <> ''
            ORDER BY overlap DESC, score DESC, rank LIMIT 1)"""


@query(f"WITH {_HITS}, {_BEST} SELECT id, file_path, CAST(overlap AS BIGINT) AS overlap, round(score, 6) AS score FROM best")
def rerank_top_document(spark, sf):
    best = search.top_document(_hits(spark, sf), QUESTION)
    return best.select("id", "file_path", _long("overlap"), F.round("score", 6).alias("score"))


_CONTEXT = f"""pieces AS (SELECT DISTINCT %(by)s AS doc, chunk_index, {_TRIM % "coalesce(content_text, '')"} AS content FROM docs_chunks),
taken AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY chunk_index, content) AS nth FROM pieces WHERE content <> ''),
roomy AS (SELECT *, 24000 - coalesce(sum(length(content) + 2) OVER (PARTITION BY doc ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM taken WHERE nth <= 20),
addresses AS (SELECT %(by)s AS doc, arg_min(citation_url, (chunk_index, {_TRIM % "content_text"}, citation_url)) AS first_url FROM docs_chunks WHERE {_TRIM % "coalesce(content_text, '')"} <> '' GROUP BY 1),
contexts AS (SELECT doc, string_agg(substr(content, 1, CAST(room AS BIGINT)), chr(10) || chr(10) ORDER BY nth) AS context, count(*) AS n_chunks FROM roomy WHERE room > 0 GROUP BY doc)"""


@query(f"WITH {_CONTEXT % {'by': 'file_unique_id'}} SELECT doc AS file_unique_id, context, n_chunks FROM contexts WHERE doc IS NOT NULL")
def document_contexts(spark, sf):
    """The bounded context of every stored document."""
    chunks = table(spark, sf, "docs_chunks").where("file_unique_id is not null")
    return search.budgeted_context(chunks, ["file_unique_id"]).select("file_unique_id", "context", "n_chunks")


@query(f"""WITH {_HITS}, {_BEST}, {_CONTEXT % {'by': 'file_path'}}
           SELECT '### Result 1 (score: ' || printf('%.4f', score) || ')' || chr(10) || '**Source:** ' || coalesce(CASE WHEN context IS NULL THEN citation_url ELSE first_url END, '') || chr(10) || '**File:** ' || coalesce(file_path, '')
                  || chr(10) || chr(10) || coalesce(context, content_text, '') || chr(10) AS output
           FROM best LEFT JOIN contexts c ON c.doc = file_path LEFT JOIN addresses a ON a.doc = file_path""")
def search_docs(spark, sf):
    found = search.search_docs(_profiled(table(spark, sf, "docs_chunks"), "content_text"), QUESTION, _question_profile(spark), 10)
    return search.rendered(found, "docs")


@query(f"""WITH pool AS (SELECT * FROM issues_data WHERE repo_name = 'kelpstack/lineage' AND issue_state = 'open' AND regexp_matches(body, '[A-Za-z]')),
           hits AS (SELECT pool.*, {_profile_score("body")} AS score FROM pool ORDER BY score DESC, id LIMIT 5),
           ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM hits)
           SELECT coalesce(string_agg('### Result ' || rank || ' (score: ' || printf('%.4f', score) || ')' || chr(10) || '**Source:** ' || coalesce(url, '') || chr(10) || '**Repo:** ' || repo_name
             || CASE WHEN coalesce(issue_number, 0) <> 0 THEN chr(10) || '**Issue:** #' || issue_number ELSE '' END || ' (open)'
             || CASE WHEN coalesce(issue_labels, '') <> '' THEN chr(10) || '**Labels:** ' || issue_labels ELSE '' END
             || chr(10) || chr(10) || coalesce(body, '') || chr(10), chr(10) || '---' || chr(10) ORDER BY rank), 'No issues found for your query.') AS output FROM ranked""")
def search_issues(spark, sf):
    corpus = _profiled(table(spark, sf, "issues_data"), "body").withColumn("content_text", F.col("body")).withColumn("citation_url", F.col("url"))
    found = search.search_issues(corpus, _question_profile(spark), 5, "kelpstack/lineage", "open")
    return search.rendered(found, "issues")


@query()
def search_code(spark, sf):
    """Nearest code chunks of one resource kind, by hashed vectors of all chunks."""
    chunks = ingest.source_chunks(table(spark, sf, "code_data"))
    stored = embedding.embedded(chunks, "content_text", embedding.hashing_provider(64)).withColumnRenamed("embedding", "vector").withColumn("id", F.xxhash64("id", "chunk_index"))
    asked = embedding.hashing_provider(64)()([QUESTION])[0]
    return search.rendered(search.search_code(stored, [float(x) for x in asked], 5, "Notebook"), "code")


# --- cleaning, citations, issue text ----------------------------------------

_FENCE = r"(?:\r?\n|$)"
#: The patterns of each cleaning step, in the dialect of the SQL.
_STEPS_SQL = {
    "template": r"regexp_replace(%s, '(?s)\{\{.*?\}\}', '', 'g')",
    "comment": r"regexp_replace(%s, '(?s)<!--.*?-->', '', 'g')",
    "tag": r"regexp_replace(%s, '<[^>]+>', ' ', 'g')",
    "navigation": r"regexp_replace(%s, '(?i)\b(?:Get Started|Contribute|GenAI|Home|Menu|Navigation)\b', '', 'g')",
    "link_nested": r"regexp_replace(%s, '\[([^\]]+)\]\((?:[^()]|\([^()]*\))*\)', '\1', 'g')",
    "link_plain": r"regexp_replace(%s, '\[([^\]]+)\]\([^)]+\)', '\1', 'g')",
    "url": rf"regexp_replace(%s, 'https?://[^{_WS[1:-1]}]+', '', 'g')",
    "blanks": r"regexp_replace(%s, '[ \t]+', ' ', 'g')",
    "lines": r"regexp_replace(%s, '\n[ \t]*\n(?:[ \t]*\n)+', chr(10) || chr(10), 'g')",
    "flat": rf"regexp_replace(%s, '{_WS}+', ' ', 'g')",
    "strip": _TRIM,
    # Two patterns, since this dialect has no reference to an earlier group.
    "front_page": rf"regexp_replace(%s, '(?s)\A[ \t]*(?:---[ \t]*\r?\n(?:.*?\n)??[ \t]*---[ \t]*(?:\r?\n|\z)|\+\+\+[ \t]*\r?\n(?:.*?\n)??[ \t]*\+\+\+[ \t]*(?:\r?\n|\z))', '')",
}


def _sql_chain(column: str, steps: list[str]) -> str:
    for step in steps:
        column = _STEPS_SQL[step].replace("%s", column)
    return column


_PAGE_SQL = _sql_chain("content", ["front_page", "template", "comment", "tag", "navigation", "link_nested", "url", "blanks", "lines", "strip"])


@query(f"SELECT id, {_sql_chain('content', ['front_page', 'template', 'comment', 'tag', 'navigation', 'link_nested', 'url', 'blanks', 'lines', 'strip'])} AS clean FROM github_data")
def clean_page(spark, sf):
    return table(spark, sf, "github_data").select("id", cleaning.clean_page(F.col("content")).alias("clean"))


#: SQL: front matter between two equal runs of dashes or plus signs, of which the first is
#: taken as long as a later run can match it; this dialect has no reference to an earlier group.
_FLAT_FRONT = rf"""runs AS (SELECT id, content, length(regexp_extract(content, '\A{_WS}*')) AS lead, regexp_extract(content, '\A{_WS}*(-{{3,}}|\+{{3,}})', 1) AS run FROM github_data),
  longest AS (SELECT *, list_max(list_filter(range(3, length(run) + 1), lambda m: contains(substr(content, lead + m + 1), repeat(run[1], CAST(m AS INT))))) AS m FROM runs),
  flat AS (SELECT id, CASE WHEN m IS NULL THEN content ELSE regexp_replace(substr(content, lead + 2 * m + instr(substr(content, lead + m + 1), repeat(run[1], CAST(m AS INT)))), '\A{_WS}+', '') END AS body FROM longest)"""


@query(f"WITH {_FLAT_FRONT} SELECT id, {_sql_chain('body', ['template', 'comment', 'tag', 'navigation', 'url', 'link_plain', 'flat', 'strip'])} AS clean FROM flat")
def clean_flat(spark, sf):
    return table(spark, sf, "github_data").select("id", cleaning.clean_flat(F.col("content")).alias("clean"))


_INCREMENTAL_SQL = _sql_chain(rf"regexp_replace(content, '(?sm)^{_WS}*[+\-]{{3,}}.*?[+\-]{{3,}}{_WS}*', '', 'g')", ["template", "comment", "tag", "navigation", "url", "link_plain", "flat", "strip"])


@query(f"SELECT id, {_INCREMENTAL_SQL} AS clean FROM github_data")
def clean_incremental(spark, sf):
    return table(spark, sf, "github_data").select("id", cleaning.clean_incremental(F.col("content")).alias("clean"))


@query(f"SELECT id, {_STEPS_SQL['front_page'].replace('%s', 'content')} AS body FROM github_data")
def front_matter_strip(spark, sf):
    return table(spark, sf, "github_data").select("id", cleaning.strip_front_matter(F.col("content")).alias("body"))


@query(f"SELECT id, {_sql_chain('content', ['comment', 'tag'])} AS body FROM github_data")
def html_strip_tags(spark, sf):
    return table(spark, sf, "github_data").select("id", cleaning.strip_tags(cleaning.strip_comments(F.col("content"))).alias("body"))


@query("""SELECT id, replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS escaped FROM github_data""")
def html_escaped(spark, sf):
    return table(spark, sf, "github_data").select("id", text.html_escape(F.col("content")).alias("escaped"))


@query()
def html_to_plain(spark, sf):
    pages = table(spark, sf, "github_data").where(F.col("path").endswith(".html"))
    return pages.select("id", html_to_text("content").alias("plain"))


@query()
def comments_as_html(spark, sf):
    rows = table(spark, sf, "issues_data").select("id", F.posexplode("comments").alias("position", "comment"))
    return rows.select("id", "position", markdown_to_html("comment.body").alias("html"))


_DOCS_CITATION = f"""'{BASE_URL}/' || CASE WHEN contains(path, 'content/en/docs') AND list_position(string_split(path, '/'), 'docs') > 0
  THEN regexp_replace(array_to_string(list_slice(string_split(path, '/'), list_position(string_split(path, '/'), 'docs') + 1, len(string_split(path, '/'))), '/'), '([^/.][^/]*)\\.[^./]*$', '\\1')
  ELSE path END"""


@query(f"SELECT id, {_DOCS_CITATION} AS citation_url, 'tidegrid/website:' || path AS file_unique_id FROM github_data")
def docs_citations(spark, sf):
    path = F.col("path")
    return table(spark, sf, "github_data").select(
        "id", text.docs_citation(path, BASE_URL).alias("citation_url"), text.file_unique_id(F.lit("tidegrid/website"), path).alias("file_unique_id")
    )


@query("""SELECT id, substr(coalesce(nullif(citation_url, ''), 'https://github.com/' || repo || '/blob/main/' || path), 1, 1024) AS citation_url, repo || ':' || path AS file_unique_id,
                 substr(content, 1, 2000) AS content_text, substr(file_name, 1, 256) AS file_name FROM code_data""")
def code_fields(spark, sf):
    c = F.col
    return table(spark, sf, "code_data").select(
        "id", F.substring(text.code_citation(c("citation_url"), c("repo"), c("path")), 1, 1024).alias("citation_url"), text.file_unique_id(c("repo"), c("path")).alias("file_unique_id"),
        F.substring("content", 1, 2000).alias("content_text"), F.substring("file_name", 1, 256).alias("file_name"),
    )


@query(r"""SELECT id, regexp_matches(path, '(^|/)(Dockerfile|Makefile|Kustomization)$') OR (contains(file_name, '.') AND lower(string_split(file_name, '.')[-1]) IN ('yaml', 'yml', 'py', 'go', 'json', 'sh', 'ts', 'js', 'md')) AS is_code,
                  ends_with(path, '.md') OR ends_with(path, '.html') AS is_doc FROM code_data""")
def path_kinds(spark, sf):
    return table(spark, sf, "code_data").select("id", is_code(F.col("file_name")).alias("is_code"), is_doc(F.col("path")).alias("is_doc"))


#: The wording of rendered comments, headers and prefixes, here and below.
_COMMENT_SQL = "'**Comment by @' || coalesce(c.author, 'unknown') || '** (' || coalesce(c.created_at, '') || '):' || chr(10) || coalesce(c.body, '')"


@query(f"""SELECT id, '# ' || coalesce(title, '') || chr(10) || chr(10) || '**Repository:** ' || coalesce(repo_name, '') || chr(10) || '**Issue:** #' || coalesce(issue_number, 0)
             || chr(10) || '**URL:** ' || coalesce(url, '') || chr(10) || '**Labels:** ' || coalesce(issue_labels, '') || chr(10) || '**State:** ' || coalesce(issue_state, '')
             || chr(10) || '**Created:** ' || coalesce(created_at, '') || chr(10) || '**Updated:** ' || coalesce(updated_at, '') || chr(10) || chr(10) || coalesce(body, '')
             || coalesce(array_to_string(list_transform(comments, lambda c: chr(10) || chr(10) || '---' || chr(10) || {_COMMENT_SQL}), ''), '') AS markdown FROM issues_data""")
def issue_markdown(spark, sf):
    c = [F.col(n) for n in ("title", "repo_name", "issue_number", "url", "issue_labels", "issue_state", "created_at", "updated_at", "body", "comments")]
    return table(spark, sf, "issues_data").select("id", text.issue_markdown(*c).alias("markdown"))


_META_SQL = f"""meta AS (SELECT id, content,
  (issue_number IS NOT NULL OR coalesce(title, '') <> '' OR coalesce(repo_name, '') <> '' OR coalesce(issue_state, '') <> '') AS s,
  {_TRIM % "coalesce(title, '')"} AS t1, {_TRIM % "regexp_extract(coalesce(content, ''), '(?m)^#\\s+(.+)', 1)"} AS t2,
  {_TRIM % "coalesce(repo_name, '')"} AS r1, {_TRIM % "regexp_extract(coalesce(content, ''), '\\*\\*Repository:\\*\\*\\s*(.+)', 1)"} AS r2,
  coalesce(issue_number, 0) AS n1, coalesce(try_cast(nullif(regexp_extract(coalesce(content, ''), '\\*\\*Issue:\\*\\*\\s*#(\\d+)', 1), '') AS BIGINT), 0) AS n2,
  {_TRIM % "coalesce(issue_state, '')"} AS s1, regexp_extract(coalesce(content, ''), '\\*\\*State:\\*\\*\\s*(\\w+)', 1) AS s2,
  {_TRIM % "coalesce(issue_labels, '')"} AS l1, {_TRIM % "regexp_extract(coalesce(content, ''), '\\*\\*Labels:\\*\\*[ \\t]*(.*)', 1)"} AS l2,
  {_TRIM % "coalesce(url, '')"} AS u1, {_TRIM % "regexp_extract(coalesce(content, ''), '\\*\\*URL:\\*\\*\\s*(.+)', 1)"} AS u2 FROM issues_data),
resolved AS (SELECT id, CASE WHEN s THEN t1 ELSE t2 END AS title, CASE WHEN s THEN r1 ELSE r2 END AS repo_name, CASE WHEN s THEN n1 ELSE n2 END AS issue_number,
  CASE WHEN s THEN s1 ELSE s2 END AS issue_state, CASE WHEN s THEN l1 ELSE l2 END AS issue_labels, CASE WHEN s THEN u1 ELSE u2 END AS citation_url FROM meta)"""


def _issue_meta(df: DataFrame) -> DataFrame:
    c = [F.col(n) for n in ("title", "repo_name", "issue_number", "issue_state", "issue_labels", "url", "content")]
    return df.withColumn("meta", text.issue_metadata(*c))


@query(f"""WITH {_META_SQL} SELECT *, title = '' AND repo_name = '' AND issue_number = 0 AND issue_state = '' AND issue_labels = '' AND citation_url = '' AS is_empty FROM resolved""")
def issue_metadata(spark, sf):
    return _issue_meta(table(spark, sf, "issues_data")).select("id", "meta.*", text.is_empty_metadata(F.col("meta")).alias("is_empty"))


@query(f"""WITH {_META_SQL} SELECT id, '[Issue #' || issue_number || '] ' || title || CASE WHEN repo_name <> '' THEN ' | Repo: ' || repo_name ELSE '' END
             || CASE WHEN issue_state <> '' THEN ' | State: ' || issue_state ELSE '' END || CASE WHEN issue_labels <> '' THEN ' | Labels: ' || issue_labels ELSE '' END
             || chr(10) || chr(10) AS prefix FROM resolved""")
def issue_prefix(spark, sf):
    return _issue_meta(table(spark, sf, "issues_data")).select("id", text.issue_prefix(F.col("meta")).alias("prefix"))


def _bit(column: str, label: str) -> str:
    return f"CASE WHEN coalesce({column}, '') <> '' THEN '**{label}:** ' || {column} END"


_HEAD_SQL = f"""concat_ws(chr(10), CASE WHEN {_TRIM % "coalesce(title, '')"} <> '' THEN '# ' || {_TRIM % "title"} END, {_bit('repo_name', 'Repository')},
  CASE WHEN coalesce(issue_number, 0) <> 0 THEN '**Issue:** #' || issue_number END, {_bit('url', 'URL')}, '**Labels:** ' || issue_labels, {_bit('issue_state', 'State')}, {_bit('created_at', 'Created')}, {_bit('updated_at', 'Updated')})"""
_SEGMENTS_SQL = f"""heads AS (SELECT *, {_HEAD_SQL} AS head FROM issues_data),
  segments AS (SELECT id, content, CASE WHEN body IS NOT NULL
      THEN list_concat([{_TRIM % "CASE WHEN head <> '' AND body <> '' THEN head || chr(10) || chr(10) || body WHEN head <> '' THEN head ELSE body END"}], list_transform(coalesce(comments, []), lambda c: {_TRIM % ("(" + _COMMENT_SQL + ")")}))
      ELSE list_transform(string_split(coalesce(content, ''), chr(10) || chr(10) || '---' || chr(10)), lambda x: {_TRIM % "x"}) END AS parts FROM heads),
  filled AS (SELECT id, content, list_filter(parts, lambda x: x <> '') AS parts FROM segments),
  cut AS (SELECT id, CASE WHEN len(parts) > 0 THEN parts ELSE [coalesce(content, '')] END AS parts FROM filled)"""


@query(f"WITH {_SEGMENTS_SQL} SELECT id, unnest(range(len(parts))) AS segment_no, unnest(parts) AS segment FROM cut")
def issue_segments(spark, sf):
    names = ("title", "repo_name", "issue_number", "url", "issue_labels", "issue_state", "created_at", "updated_at", "body", "comments", "content")
    cut = table(spark, sf, "issues_data").select("id", text.issue_segments(*[F.col(n) for n in names]).alias("segments"))
    return cut.select("id", F.posexplode("segments").alias("segment_no", "segment")).withColumn("segment_no", F.col("segment_no").cast("long"))


@query("""SELECT trim(label) AS label, count(*) AS n, count(DISTINCT repo_name) AS n_repos FROM (
            SELECT repo_name, unnest(string_split(issue_labels, ',')) AS label FROM issues_data) WHERE trim(label) <> '' GROUP BY 1""")
def issue_label_counts(spark, sf):
    labels = table(spark, sf, "issues_data").select("repo_name", F.explode(F.split("issue_labels", ",")).alias("label"))
    return labels.select("repo_name", F.trim("label").alias("label")).where("label <> ''").groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("repo_name").alias("n_repos"))


# --- chunking ---------------------------------------------------------------


@query()
def page_chunks(spark, sf):
    return ingest.page_chunks(table(spark, sf, "github_data"), F.lit("tidegrid/website"), BASE_URL)


@query()
def changed_page_chunks(spark, sf):
    """Chunks as the incremental pipeline makes them, with its own cleaner and size."""
    return ingest.page_chunks(table(spark, sf, "github_data"), F.lit("tidegrid/website"), BASE_URL, cleaning.clean_incremental, ingest.CHANGED_PAGE)


@query()
def thread_chunks(spark, sf):
    return ingest.thread_chunks(table(spark, sf, "issues_data"))


@query()
def source_chunks(spark, sf):
    return ingest.source_chunks(table(spark, sf, "code_data"))


def _facts(chunks: DataFrame, texts: DataFrame, limit: int) -> DataFrame:
    """What holds for the chunks of each text: numbered from 0 without gaps, within the limit, parts of the text.

    ``texts`` have ``id, text, expected``; the text is compared without white space at
    the ends of chunks only.
    """
    joined = texts.join(chunks.select("id", "chunk_index", "content_text"), "id", "left")
    held = F.col("chunk_index").isNotNull()
    return joined.groupBy("id", "expected").agg(
        F.count("chunk_index").alias("n"), F.count_distinct("chunk_index").alias("numbers"), F.max("chunk_index").alias("last"),
        F.coalesce(F.bool_and(F.when(held, F.length("content_text") <= limit)), F.lit(True)).alias("within_limit"),
        F.coalesce(F.bool_and(F.when(held, F.contains("text", "content_text"))), F.lit(True)).alias("contained"),
        F.sum(F.length("content_text")).alias("chars"),
    ).select(
        "id", (F.col("n") > 0).alias("has_chunks"), ((F.col("n") == F.col("numbers")) & (F.coalesce("last", F.lit(-1)) == F.col("n") - 1)).alias("in_order"), "within_limit", "contained",
        ((F.col("n") == 0) | (F.col("chars") >= 0.9 * F.col("expected"))).alias("complete"),
    )


def _page_facts(spark: SparkSession, sf: str, chunks: DataFrame, cleaner: Callable[[Column], Column], limit: int) -> DataFrame:
    texts = table(spark, sf, "github_data").select("id", cleaner(F.col("content")).alias("text"))
    solid = F.length(F.regexp_replace("text", r"(?U)\s+", ""))
    return _facts(chunks, texts.select("id", "text", solid.alias("expected")), limit)


@query(f"SELECT id, coalesce(length({_PAGE_SQL}) >= 50, false) AS has_chunks, true AS in_order, true AS within_limit, true AS contained, true AS complete FROM github_data")
def page_chunk_facts(spark, sf):
    """Page chunks are numbered, short enough and parts of the cleaned page; short pages have none."""
    return _page_facts(spark, sf, page_chunks(spark, sf), cleaning.clean_page, 600)


@query(f"SELECT id, coalesce(length({_INCREMENTAL_SQL}) >= 50, false) AS has_chunks, true AS in_order, true AS within_limit, true AS contained, true AS complete FROM github_data")
def changed_page_chunk_facts(spark, sf):
    return _page_facts(spark, sf, changed_page_chunks(spark, sf), cleaning.clean_incremental, 1200)


@query(rf"""SELECT id, coalesce(length({_TRIM % "content"}) >= 10, false) AS has_chunks, true AS in_order, true AS within_limit, true AS contained FROM code_data
            WHERE NOT regexp_matches(path, '(?i)\.(?:ya?ml|py)$')""")
def source_chunk_facts(spark, sf):
    """Code that is neither YAML nor Python is one text, cut where it is too long."""
    files = table(spark, sf, "code_data").where(~F.col("path").rlike(r"(?i)\.(?:ya?ml|py)$"))
    texts = files.select("id", F.col("content").alias("text"), F.lit(0).alias("expected"))
    return _facts(ingest.source_chunks(files), texts, 1000).drop("complete")


@query(rf"""WITH docs AS (SELECT id, list_filter(list_transform(regexp_split_to_array(regexp_replace(content, '{_WS}+$', ''), '(?m)^---[ \t\r\x{{b}}\x{{c}}]*$'), lambda x: {_TRIM % "x"}), lambda x: length(x) >= 10) AS parts
              FROM code_data WHERE regexp_matches(path, '(?i)\.ya?ml$') AND length(regexp_replace(content, '{_WS}+$', '')) >= 10)
            SELECT id, CAST(len(parts) AS BIGINT) AS n_documents, CAST(list_sum(list_transform(parts, lambda x: length(x))) AS BIGINT) AS chars,
                   CAST(len(list_filter(parts, lambda x: regexp_matches(x, '(?m)^kind:'))) AS BIGINT) AS n_kinds FROM docs WHERE len(parts) > 0""")
def yaml_documents(spark, sf):
    """Documents of each YAML file, whole."""
    files = table(spark, sf, "code_data").where(F.col("path").rlike(r"(?i)\.ya?ml$"))
    chunks = splitting.exploded(files.select("id", splitting.code_chunker(2**31 - 1, 0)(F.when(F.length(F.regexp_replace("content", r"(?U)\s+\z", "")) >= 10, F.regexp_replace("content", r"(?U)\s+\z", "")), "path").alias("chunks")), "chunks", ["id"])
    return chunks.groupBy("id").agg(
        F.count("*").alias("n_documents"), F.sum(F.length("chunk.content").cast("long")).alias("chars"), F.count(F.when(F.col("chunk.content").rlike("(?m)^kind:"), 1)).alias("n_kinds")
    )


@query(f"""WITH {_META_SQL}, prefixes AS (SELECT id, '[Issue #' || issue_number || '] ' || title || CASE WHEN repo_name <> '' THEN ' | Repo: ' || repo_name ELSE '' END
             || CASE WHEN issue_state <> '' THEN ' | State: ' || issue_state ELSE '' END || CASE WHEN issue_labels <> '' THEN ' | Labels: ' || issue_labels ELSE '' END || chr(10) || chr(10) AS prefix FROM resolved),
           {_SEGMENTS_SQL}
           SELECT p.id, true AS in_order, true AS prefixed, true AS within_limit, array_to_string(parts, chr(10) || chr(10)) <> '' AND
             length(array_to_string(parts, chr(10) || chr(10))) <= greatest(100, 1500 - length(prefix)) AS whole FROM prefixes p JOIN cut USING (id)""")
def thread_chunk_facts(spark, sf):
    """Issue chunks are numbered, carry the issue's prefix and fit; short threads are one chunk."""
    issues = _issue_meta(table(spark, sf, "issues_data"))
    names = ("title", "repo_name", "issue_number", "url", "issue_labels", "issue_state", "created_at", "updated_at", "body", "comments", "content")
    joined = F.array_join(text.issue_segments(*[F.col(n) for n in names]), "\n\n")
    facts = issues.select("id", text.issue_prefix(F.col("meta")).alias("prefix"), joined.alias("thread"))
    rows = facts.join(thread_chunks(spark, sf).select("id", "chunk_index", "content_text"), "id")
    room = F.greatest(F.lit(100), 1500 - F.length("prefix"))
    return rows.groupBy("id").agg(
        F.count("*").alias("n"), F.max("chunk_index").alias("last"), F.bool_and(F.startswith("content_text", "prefix")).alias("prefixed"),
        F.bool_and(F.length("content_text") <= F.length("prefix") + room).alias("within_limit"), F.bool_and((F.col("thread") != "") & (F.length("thread") <= room) & (F.col("content_text") == F.concat("prefix", "thread"))).alias("whole"),
    ).select("id", (F.col("last") == F.col("n") - 1).alias("in_order"), "prefixed", "within_limit", "whole")


@query()
def resource_counts(spark, sf):
    chunks = ingest.source_chunks(table(spark, sf, "code_data"))
    return chunks.groupBy("file_type", "resource_kind").agg(F.count("*").alias("n"), F.count_distinct("file_unique_id").alias("n_files"))


@query("""SELECT id, CAST(64 AS BIGINT) AS dim, CASE WHEN regexp_matches(substr(coalesce(content_text, ''), 1, 1000), '[^\\s\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{3000}]') THEN 1::DOUBLE ELSE 0::DOUBLE END AS norm FROM docs_chunks""")
def embedded_chunks(spark, sf):
    """Every stored chunk with a hashed vector; the length of each vector is 1 or 0."""
    rows = embedding.embedded(table(spark, sf, "docs_chunks").select("id", "content_text"), "content_text", embedding.hashing_provider(64), dim=64)
    return rows.select("id", F.size("embedding").cast("long").alias("dim"), F.round(F.sqrt(search.dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"))


@query("""SELECT repo_name, file_path, count(*) AS n_chunks, round(avg(length(content_text)), 4) AS avg_chars, sum(length(content_text)) AS chars, max(chunk_index) AS last_index
          FROM docs_chunks GROUP BY repo_name, file_path""")
def chunk_stats(spark, sf):
    length = F.length("content_text")
    return table(spark, sf, "docs_chunks").groupBy("repo_name", "file_path").agg(
        F.count("*").alias("n_chunks"), F.round(F.avg(length), 4).alias("avg_chars"), F.sum(length.cast("long")).alias("chars"), F.max("chunk_index").alias("last_index")
    )


# --- store ------------------------------------------------------------------

_COLS = "id, file_unique_id, repo_name, file_path, chunk_index, content_text, last_updated"


def _stored_and_late(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Chunks with a load time are stored; those without come in late."""
    rows = table(spark, sf, "docs_chunks").select(*_COLS.split(", "))
    return rows.where("last_updated is not null"), rows.where("last_updated is null")


@query(f"""SELECT {_COLS} FROM docs_chunks d WHERE last_updated IS NULL UNION ALL
           SELECT {_COLS} FROM docs_chunks d WHERE last_updated IS NOT NULL AND NOT EXISTS (SELECT 1 FROM docs_chunks n WHERE n.last_updated IS NULL AND n.file_unique_id = d.file_unique_id)""")
def upsert_by_file(spark, sf):
    stored, late = _stored_and_late(spark, sf)
    return store.replaced(stored, late, ["file_unique_id"]).select(*_COLS.split(", "))


@query(f"""SELECT {_COLS} FROM docs_chunks d WHERE last_updated IS NULL UNION ALL
           SELECT {_COLS} FROM docs_chunks d WHERE last_updated IS NOT NULL AND NOT EXISTS (SELECT 1 FROM docs_chunks n WHERE n.last_updated IS NULL AND n.repo_name = d.repo_name AND n.file_path = d.file_path)""")
def upsert_by_path(spark, sf):
    stored, late = _stored_and_late(spark, sf)
    return store.replaced(stored, late, ["repo_name", "file_path"]).select(*_COLS.split(", "))


@query("""SELECT id, file_unique_id, file_path FROM docs_chunks WHERE file_path IS NULL OR file_path NOT IN (
            SELECT path FROM github_data WHERE path IS NOT NULL GROUP BY path HAVING count(*) > 1)""")
def delete_changed(spark, sf):
    """Stored chunks without those of pages that were fetched again."""
    again = table(spark, sf, "github_data").where("path is not null").groupBy(F.col("path").alias("file_path")).count().where("count > 1")
    return store.deleted(table(spark, sf, "docs_chunks").select("id", "file_unique_id", "file_path"), again, ["file_path"])


@query("""SELECT file_unique_id, chunk_index, id, last_updated FROM docs_chunks
          QUALIFY row_number() OVER (PARTITION BY file_unique_id, chunk_index ORDER BY last_updated DESC NULLS LAST, id DESC) = 1""")
def latest_chunks(spark, sf):
    rows = table(spark, sf, "docs_chunks").select("file_unique_id", "chunk_index", "id", "last_updated")
    return store.latest(rows, ["file_unique_id", "chunk_index"], [F.coalesce("last_updated", F.lit(-(2**62))), F.col("id")])


@query("""SELECT path FROM (SELECT path FROM github_data UNION SELECT file_path FROM docs_chunks) WHERE ends_with(path, '.md') OR ends_with(path, '.html')""")
def changed_files_union(spark, sf):
    paths = table(spark, sf, "github_data").select("path").unionByName(table(spark, sf, "docs_chunks").select(F.col("file_path").alias("path")))
    return paths.where(is_doc(F.col("path"))).distinct()


@query("""SELECT repo_name, count(DISTINCT file_path) AS n_files, min(file_path) AS first_file, max(file_path) AS last_file FROM docs_chunks GROUP BY repo_name""")
def files_by_repo(spark, sf):
    """Files of each repository: distinct paths first, so that a large one is no single task."""
    distinct = table(spark, sf, "docs_chunks").select("repo_name", "file_path").distinct()
    return distinct.groupBy("repo_name").agg(F.count("file_path").alias("n_files"), F.min("file_path").alias("first_file"), F.max("file_path").alias("last_file"))


@query("SELECT DISTINCT repo_name, file_path FROM docs_chunks WHERE file_path IS NOT NULL")
def distinct_keys(spark, sf):
    return table(spark, sf, "docs_chunks").where("file_path is not null").select("repo_name", "file_path").distinct()


@query("""SELECT 'docs_chunks' AS collection, count(*) AS n FROM docs_chunks UNION ALL SELECT 'issues_data', count(*) FROM issues_data
          UNION ALL SELECT 'code_data', count(*) FROM code_data UNION ALL SELECT 'github_data', count(*) FROM github_data""")
def entity_counts(spark, sf):
    parts = [table(spark, sf, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("collection"), "n") for n in ("docs_chunks", "issues_data", "code_data", "github_data")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""SELECT id, repo_name, issue_number FROM issues_data WHERE repo_name IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY repo_name ORDER BY issue_number, id) <= 25""")
def capped_issues(spark, sf):
    """The limit of records of each repository is the operator itself."""
    issues = table(spark, sf, "issues_data").where("repo_name is not null").select("id", "repo_name", "issue_number")
    return capped_per_repo(issues, "repo_name", [F.col("issue_number").asc_nulls_last(), F.col("id")], 25)


@query("""SELECT repo_name, issue_number, id, issue_state, updated_at FROM issues_data WHERE repo_name IS NOT NULL AND issue_number IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY repo_name, issue_number ORDER BY id DESC) = 1""")
def latest_issues(spark, sf):
    rows = table(spark, sf, "issues_data").where("repo_name is not null and issue_number is not null")
    return store.latest(rows.select("repo_name", "issue_number", "id", "issue_state", "updated_at"), ["repo_name", "issue_number"], [F.col("id")])


# --- evaluation -------------------------------------------------------------


@query("""WITH want AS (SELECT DISTINCT repo_name, citation_url FROM docs_chunks WHERE citation_url LIKE 'http%' AND repo_name IS NOT NULL),
           shown AS (SELECT DISTINCT repo_name, citation_url, 1 AS hit FROM docs_chunks WHERE citation_url <> '' AND last_updated IS NOT NULL)
           SELECT repo_name, count(*) AS n_expected, count(*) - count(hit) AS n_missing, count(*) = count(hit) AS passed FROM want LEFT JOIN shown USING (repo_name, citation_url) GROUP BY repo_name""")
def gate1_score(spark, sf):
    """Does what each repository's dated chunks cite cover all that it should cite?"""
    chunks = table(spark, sf, "docs_chunks").where("repo_name is not null")
    wanted = chunks.where("citation_url like 'http%'").select("repo_name", "citation_url")
    shown = chunks.where("citation_url <> '' and last_updated is not null").select("repo_name", "citation_url")
    return evaluation.coverage(wanted, shown, "repo_name", "citation_url")


@query(r"""WITH a AS (SELECT id, coalesce(body, '') AS answer, url, coalesce(len(comments), 0) > 0 AS fired FROM issues_data),
           u AS (SELECT *, list_distinct(list_concat(regexp_extract_all(answer, '\[[^\]]*\]\((https?://[^)\s]+)\)', 1),
                   list_transform(regexp_extract_all(answer, 'https?://[^\s)\]>"'']+'), lambda x: regexp_replace(x, '[.,;:)]+$', '')))) AS cited FROM a)
           SELECT id, CAST(len(cited) AS BIGINT) AS n_cited, CAST(len(list_filter(cited, lambda x: url IS NULL OR x <> url)) AS BIGINT) AS n_invented,
                  fired AND len(list_filter(cited, lambda x: url IS NULL OR x <> url)) = 0 AND contains(answer, '.') AND NOT contains(answer, 'password') AS passed FROM u""")
def gate2_score(spark, sf):
    """Bodies as answers: only the issue's own address may be cited."""
    scored = _answers_scored(spark, sf)
    return scored.select("id", F.size("cited_urls").cast("long").alias("n_cited"), F.size("invented_urls").cast("long").alias("n_invented"), "passed")


def _answers_scored(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf, "issues_data").select(
        "id", c("body").alias("answer"), (F.coalesce(F.size("comments"), F.lit(0)) > 0).alias("tool_fired"), F.array_compact(F.array("url")).alias("allowed_urls"),
        F.array(F.lit(".")).alias("must_appear_in_answer"), F.array(F.lit("password")).alias("forbidden_in_answer"),
    )
    return evaluation.answer_gate(rows)


# --- threads, chats, events -------------------------------------------------


def _flat_comments(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "issues_data").select("id", F.posexplode("comments").alias("position", "c"))
    return rows.select("id", "position", "c.author", "c.created_at", "c.body")


@query("""SELECT id, CAST(len(comments) AS BIGINT) AS n_comments, array_to_string(list_transform(comments, lambda c: coalesce(c.author, 'unknown')), ',') AS authors FROM issues_data WHERE len(comments) > 0""")
def comments_nested(spark, sf):
    nested = nested_comments(_flat_comments(spark, sf), ["id"])
    return nested.select("id", F.size("comments").cast("long").alias("n_comments"), F.array_join(F.transform("comments", lambda c: c["author"]), ",").alias("authors"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Threads as chats: the body is the user's turn, comments answer."""
    issues = table(spark, sf, "issues_data")
    first = issues.select("id", F.lit(0).alias("turn"), F.lit("user").alias("role"), F.col("body").alias("content"))
    return first.unionByName(_flat_comments(spark, sf).select("id", (F.col("position") + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("body").alias("content")))


@query("""SELECT id, 'User: ' || coalesce(body, '') || coalesce(array_to_string(list_transform(comments, lambda c: chr(10) || chr(10) || 'Assistant: ' || coalesce(c.body, '')), ''), '') AS transcript,
                 CAST(1 + coalesce(len(comments), 0) AS BIGINT) AS n_turns FROM issues_data""")
def transcripts(spark, sf):
    return chat.transcripts(_turns(spark, sf), ["id"], "turn", "role", "content")


@query(r"""SELECT id, array_to_string(list_slice(regexp_split_to_array(trim(body, ' '), '[ \t\n\x0b\f\r]+'), 1, 3), ' ') AS name FROM issues_data""")
def chat_names(spark, sf):
    return chat.chat_names(_turns(spark, sf), ["id"], "turn", "role", "content")


@query("""SELECT file_unique_id, string_agg(citation_url, ' ' ORDER BY first) AS citations FROM (
            SELECT file_unique_id, citation_url, min((chunk_index, citation_url)) AS first FROM docs_chunks WHERE citation_url <> '' GROUP BY 1, 2) GROUP BY 1""")
def citations_ordered(spark, sf):
    """Distinct addresses of each document in order of first appearance."""
    return chat.ordered_citations(table(spark, sf, "docs_chunks"), ["file_unique_id"], "chunk_index", "citation_url").withColumn("citations", F.array_join("citations", " "))


@query("""SELECT date_trunc('minute', ts) AS minute, count(*) AS requests, least(count(*), 60) AS accepted, count(*) - least(count(*), 60) AS rejected FROM events GROUP BY 1""")
def rate_limit_global(spark, sf):
    return sessions.global_limit(table(spark, sf, "events"), "ts", "event_id")


@query("""SELECT date_trunc('minute', ts) AS minute, user_id, count(*) AS requests, least(count(*), 10) AS accepted FROM events GROUP BY 1, 2""")
def rate_limit_per_user(spark, sf):
    return sessions.client_limit(table(spark, sf, "events"), "ts", "user_id")


@query("""WITH m AS (SELECT *, max(CASE WHEN event_type = 'view' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS minted_at FROM events)
          SELECT event_id, user_id, coalesce(epoch_us(ts) - epoch_us(minted_at) < 1800000000, false) AS valid,
                 coalesce(epoch_us(ts) - epoch_us(minted_at) BETWEEN 1740000000 AND 1799999999, false) AS refresh FROM m""")
def session_expiry(spark, sf):
    out = sessions.minted(table(spark, sf, "events"), "ts", "user_id", F.col("event_type") == "view")
    return out.select("event_id", "user_id", "valid", F.coalesce("refresh", F.lit(False)).alias("refresh"))


def _event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the lines of one event stream for each user."""
    lines = F.array(F.lit(": ping"), F.concat(F.lit("data: "), F.col("event_type")), F.concat(F.lit("data: "), F.col("props")), F.lit(""))
    rows = table(spark, sf, "events").select("user_id", "event_id", F.posexplode(lines).alias("p", "line"))
    return rows.withColumn("line_no", F.col("event_id") * 4 + F.col("p"))


@query("""SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS frame, event_type || chr(10) || props AS data FROM events""")
def sse_frames(spark, sf):
    return chat.frames(_event_lines(spark, sf), "user_id", "line_no", "line")


@query("""SELECT user_id, CAST(day(ts) AS BIGINT) AS call, max_by(event_type, event_id) FILTER (value > 20) AS name, string_agg(props, '' ORDER BY event_id) AS arguments, count(*) AS n_fragments FROM events GROUP BY 1, 2""")
def tool_call_fold(spark, sf):
    deltas = table(spark, sf, "events").withColumn("call", F.dayofmonth("ts").cast("long")).withColumn("name", F.when(F.col("value") > 20, F.col("event_type")))
    return chat.tool_calls(deltas, ["user_id", "call"], "event_id", "name", "props")


@query("""SELECT event_type, count(*) AS n, round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS avg_k, round(sum(value), 2) AS total FROM events GROUP BY 1""")
def event_props(spark, sf):
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(k), 6).alias("avg_k"), F.round(F.sum("value"), 2).alias("total"))


@query("""SELECT event_id, '$.k' AS path, json_extract_string(props, '$.k') AS value FROM events""")
def event_leaves(spark, sf):
    return chat.json_leaves(table(spark, sf, "events"), ["event_id"], "props")


@query("""SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def stream_hourly(spark, sf):
    """The same counts by a stream over the event table, run until it is drained."""
    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    base = f"{shared_dir(spark)}/docloom/stream-{uuid.uuid4().hex}"
    done = sessions.drained(sessions.windowed_stream(stream, "ts", ["event_type"]), f"{base}/out", f"{base}/state", "update", ["start", "event_type"])
    return done.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 2).alias("total"))


# --- generic queries over the star schema -----------------------------------


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
          FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf):
    rows = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n")
    )


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem
          JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def nation_revenue(spark, sf):
    t = lambda n: table(spark, sf, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


@query(f"SELECT 'tidegrid/website' AS repo_name, count(DISTINCT path) AS n_files, 2::BIGINT AS oldest, true AS replaced FROM github_data WHERE length({_PAGE_SQL}) >= 50")
def store_round_trip(spark, sf):
    """Chunks through a stored collection, written twice; the second write replaces all of them."""
    chunks = ingest.page_chunks(table(spark, sf, "github_data"), F.lit("tidegrid/website"), BASE_URL).drop("id")
    collection = store.Collection(spark, f"{shared_dir(spark)}/docloom/store-{uuid.uuid4().hex}", S.CollectionSpec("docs", S.DOCS.strings, S.DOCS.longs, dim=64))
    rows = materialize(chunks, "chunks")
    ingest.store_pages(collection, rows, embedding.hashing_provider(64), 1)
    again = ingest.store_pages(collection, rows, embedding.hashing_provider(64), 2)
    replaced = again["before"] == again["deleted"] == again["inserted"] == again["after"]
    return collection.read().groupBy("repo_name").agg(F.count_distinct("file_path").alias("n_files"), F.min("last_updated").alias("oldest"), F.lit(replaced).alias("replaced"))


@query("""WITH n AS (SELECT count(*) AS n_all, count(last_updated) AS stored, count(*) - count(last_updated) AS late FROM docs_chunks),
          u AS (SELECT count(*) AS hit FROM docs_chunks d WHERE last_updated IS NOT NULL AND EXISTS (SELECT 1 FROM docs_chunks l WHERE l.last_updated IS NULL AND l.file_unique_id = d.file_unique_id)),
          r AS (SELECT count(*) FILTER (repo_name = first) AS one FROM docs_chunks, (SELECT min(repo_name) AS first FROM docs_chunks))
          SELECT 'create' AS step, 0 AS before, 0 AS deleted, 0 AS inserted, 0 AS after
          UNION ALL SELECT 'overwrite', 0, 0, stored, stored FROM n
          UNION ALL SELECT 'upsert', stored, hit, late, stored - hit + late FROM n, u
          UNION ALL SELECT 'append', stored - hit + late, 0, late, stored - hit + 2 * late FROM n, u
          UNION ALL SELECT 'rebuild', stored - hit + 2 * late, stored - hit + 2 * late, n_all, n_all FROM n, u
          UNION ALL SELECT 'delete', n_all, one, 0, n_all - one FROM n, r""")
def store_totals(spark, sf):
    """What each step of a collection's life deletes and inserts."""
    rows = _profiled(table(spark, sf, "docs_chunks"), "content_text").withColumn("vector", F.coalesce("vector", F.array(*[F.lit(0.0)] * 26)))
    spec = S.CollectionSpec("docs", S.DOCS.strings, S.DOCS.longs, dim=26)
    stored, late, every = (S.fit_to(r, spec, 1) for r in (rows.where("last_updated is not null"), rows.where("last_updated is null"), rows))
    collection = store.Collection(spark, f"{shared_dir(spark)}/docloom/store-{uuid.uuid4().hex}", spec)
    collection.create()
    steps = {"create": {"before": 0, "deleted": 0, "inserted": 0, "after": collection.count()}, "overwrite": collection.overwrite(stored), "upsert": collection.upsert(late, ["file_unique_id"])}
    steps |= {"append": collection.append(late), "rebuild": collection.overwrite(every)}
    steps["delete"] = collection.delete(rows.agg(F.min("repo_name").alias("repo_name")), ["repo_name"])
    return spark.createDataFrame([(k, v["before"], v["deleted"], v["inserted"], v["after"]) for k, v in steps.items()], "step string, before long, deleted long, inserted long, after long")


@query("SELECT path, content, file_name FROM github_data")
def stage_lines(spark, sf):
    """A stage written as JSON lines and read again."""
    path = f"{shared_dir(spark)}/docloom/stage-{uuid.uuid4().hex}"
    store.written_lines(table(spark, sf, "github_data").select("path", "content", "file_name"), path)
    return files.stage(spark, path, "docs").select("path", "content", "file_name")


# --- sources ----------------------------------------------------------------


@query("""SELECT 'issues/tools/' || issue_number AS path, 'issue-tools-' || issue_number || '.md' AS file_name, title, 'tidegrid/tools' AS repo_name, issue_number, issue_state, coalesce(issue_labels, '') AS issue_labels,
                 substr(created_at, 1, 10) AS created_at, substr(updated_at, 1, 10) AS updated_at, coalesce(body, '') AS body, url FROM issues_data WHERE issue_number % 7 <> 0""")
def api_issue_records(spark, sf):
    """Records from payloads of an issue service; every seventh number is a pull request."""
    c = F.col
    labels = F.transform(F.split("issue_labels", ", "), lambda x: F.struct(x.alias("name")))
    raw = table(spark, sf, "issues_data").where("issue_number is not null").select(
        c("issue_number").alias("number"), "title", "body", c("issue_state").alias("state"), c("url").alias("html_url"), "created_at", "updated_at", labels.alias("labels"),
        F.when(c("issue_number") % 7 == 0, F.lit("{}")).alias("pull_request"),
    )
    return files.api_issues(raw, "tidegrid/tools").drop("comments")


@query("SELECT path, file_name, content, citation_url FROM code_data WHERE content IS NOT NULL")
def api_file_contents(spark, sf):
    """Files of a contents listing, from base64."""
    listing = table(spark, sf, "code_data").select("path", F.col("file_name").alias("name"), F.lit("file").alias("type"), F.base64(F.col("content").cast("binary")).alias("content"), F.col("citation_url").alias("html_url"))
    return files.api_contents(listing)


@query("""SELECT file_path AS path, count(*) FILTER (chunk_index = 0 OR last_updated IS NOT NULL) = 0 AS removed FROM docs_chunks
          WHERE (ends_with(file_path, '.md') OR ends_with(file_path, '.html')) AND (chunk_index = 0 OR last_updated IS NOT NULL OR last_updated IS NULL) GROUP BY 1""")
def webhook_paths(spark, sf):
    """Chunks as commits: first ones add, dated ones modify, the others remove their file."""
    one = lambda test: F.array_compact(F.array(F.when(test, F.col("file_path"))))
    added, modified = F.col("chunk_index") == 0, F.col("last_updated").isNotNull()
    return files.webhook_changes(table(spark, sf, "docs_chunks").select(one(added).alias("added"), one(modified).alias("modified"), one(~added & ~modified).alias("removed")))


# --- fields of requests -----------------------------------------------------


@query("""SELECT id, CASE WHEN length(regexp_replace(citation_url, '^https?://', '')) > 60 THEN substr(regexp_replace(citation_url, '^https?://', ''), 1, 57) || '...' ELSE regexp_replace(citation_url, '^https?://', '') END AS shown,
                 substr(sha256(file_unique_id), 1, 16) AS key_id, rtrim(replace(replace(to_base64(CAST(file_path AS BLOB)), '+', '-'), '/', '_'), '=') AS coded FROM docs_chunks""")
def links_and_keys(spark, sf):
    return table(spark, sf, "docs_chunks").select("id", text.link_text(F.col("citation_url")).alias("shown"), text.key_id(F.col("file_unique_id")).alias("key_id"), text.base64url(F.col("file_path")).alias("coded"))


@query("SELECT id, repo_name AS iss, file_path AS sub, id AS iat, id + 1800 AS exp FROM docs_chunks")
def token_fields(spark, sf):
    """Claims of tokens made from the stored chunks."""
    claims = F.to_json(F.struct(F.col("repo_name").alias("iss"), F.col("file_path").alias("sub"), F.col("id").alias("iat"), (F.col("id") + 1800).alias("exp")))
    token = F.concat(F.lit("e30."), text.base64url(claims.cast("binary")), F.lit(".x"))
    return table(spark, sf, "docs_chunks").select("id", text.token_claims(token).alias("c")).select("id", "c.*")


@query("""SELECT id, coalesce(title, '') AS query, coalesce(CAST(issue_number AS INT), 5) AS top_k, body AS message, coalesce(issue_state, 'none') AS plain, issue_labels AS last_data,
                 coalesce(nullif(trim(issue_state, ' '), ''), nullif(trim(issue_labels, ' '), ''), nullif(trim(title, ' '), '')) AS setting,
                 coalesce(nullif(trim(coalesce(body, ''), ' '), ''), trim(array_to_string(list_transform(coalesce(comments, []), lambda c: c.body), ''), ' ')) AS answer FROM issues_data""")
def request_fields(spark, sf):
    """What requests and responses say, read from JSON and event texts made from issues."""
    c = F.col
    frames = F.concat(F.lit(": ping\ndata: first\n\ndata: "), F.regexp_replace(c("issue_labels"), "\n", " "), F.lit("\n\n"))
    parts = F.transform(F.coalesce("comments", F.array().cast("array<struct<author:string,created_at:string,body:string>>")), lambda x: x["body"])
    arguments = text.tool_arguments(F.to_json(F.struct(c("title").alias("query"), c("issue_number").alias("top_k"))))
    return table(spark, sf, "issues_data").select(
        "id", arguments["query"].alias("query"), arguments["top_k"].alias("top_k"), F.when(c("body").isNotNull(), text.incoming_message(F.to_json(F.struct(c("body").alias("message"))))).alias("message"),
        text.incoming_message(F.coalesce("issue_state", F.lit("none"))).alias("plain"), text.last_event_data(frames).alias("last_data"),
        text.first_token(c("issue_state"), c("issue_labels"), c("title")).alias("setting"), text.chosen_answer(c("body"), parts).alias("answer"),
    )


@query("""SELECT user_id, CAST(day(ts) AS BIGINT) AS day, coalesce(max_by(event_type, event_id) FILTER (value >= 60), string_agg(event_type, '' ORDER BY event_id) FILTER (value < 20), '') AS answer,
                 max(event_id) FILTER (event_type = 'view') AS last_done FROM events GROUP BY 1, 2""")
def assembled_answers(spark, sf):
    """Events as parts of answers: large values are final parts, small ones partial; a view ends a turn."""
    parts = table(spark, sf, "events").withColumn("day", F.dayofmonth("ts").cast("long")).withColumn("kind", F.when(F.col("event_type") == "view", "done"))
    answers = chat.assembled(parts, ["user_id", "day"], "event_id", "event_type", F.col("value") < 20, F.col("value") >= 60)
    return answers.join(chat.turn_ends(parts, ["user_id", "day"], "event_id", "kind"), ["user_id", "day"], "left")


@query("SELECT id, 1::BIGINT AS position, title AS content, issue_state = 'closed' AS finished FROM issues_data WHERE title IS NOT NULL AND issue_state IS NOT NULL")
def completion_deltas(spark, sf):
    """Titles as pieces of streamed completions; closed issues end theirs."""
    reason = F.when(F.col("issue_state") == "closed", "stop")
    choice = F.struct(F.lit(0).alias("index"), reason.alias("finish_reason"), F.struct(F.col("title").alias("content")).alias("delta"))
    frames = table(spark, sf, "issues_data").where("title is not null and issue_state is not null").select("id", F.lit(1).cast("long").alias("frame"), F.to_json(F.struct(F.array(choice).alias("choices"))).alias("data"))
    return chat.deltas(frames, "id", "frame", "data").select("id", "position", "content", "finished")


# --- golden rows ------------------------------------------------------------


@query("SELECT 'q' || id AS id, 'search_issues' AS tool, coalesce(nullif(issue_labels, ''), title) AS query, 10 AS top_k FROM issues_data")
def golden_requests(spark, sf):
    """Issues as golden rows: labels, where there are any, are what is asked."""
    golden = table(spark, sf, "issues_data").select(F.concat(F.lit("q"), "id").alias("id"), F.col("title").alias("query"), F.nullif("issue_labels", F.lit("")).alias("retrieval_query"), F.lit("search_issues").alias("tool"))
    return evaluation.retrieval_requests(golden, ["search_docs", "search_issues", "search_code"])


@query("""WITH hits AS (SELECT repo_name, citation_url, row_number() OVER (PARTITION BY repo_name ORDER BY id) AS rank FROM docs_chunks WHERE repo_name IS NOT NULL),
          shown AS (SELECT repo_name, coalesce(list_distinct(list(citation_url) FILTER (rank <= 5 AND regexp_matches(citation_url, '^https?://\\S+$'))), []) AS urls FROM hits GROUP BY 1),
          want AS (SELECT repo_name, list_distinct([min(citation_url), arg_min(citation_url, id)]) AS urls FROM docs_chunks WHERE citation_url LIKE 'http%' AND repo_name IS NOT NULL GROUP BY 1)
          SELECT repo_name AS id, CAST(len(shown.urls) AS BIGINT) AS n_sources, array_to_string(list_sort(list_filter(want.urls, lambda u: NOT list_contains(shown.urls, u))), ' ') AS missing,
                 len(list_filter(want.urls, lambda u: NOT list_contains(shown.urls, u))) = 0 AS passed FROM want JOIN shown USING (repo_name)""")
def gate1_rendered(spark, sf):
    """The retrieval gate on rendered results: do the first chunks of a repository cite what they should?"""
    chunks = table(spark, sf, "docs_chunks").where("repo_name is not null")
    first = capped_per_repo(chunks, "repo_name", [F.col("id")], 5)
    hits = first.withColumn("rank", F.row_number().over(Window.partitionBy("repo_name").orderBy("id"))).withColumn("score", 1 / F.col("rank"))
    output = search.rendered(hits, "docs", ["repo_name"])
    wanted = chunks.where("citation_url like 'http%'").groupBy("repo_name").agg(F.array_distinct(F.array(F.min("citation_url"), F.min_by("citation_url", "id"))).alias("expected_source_urls"))
    golden = wanted.join(output, "repo_name").withColumn("must_appear_in_answer", F.array().cast("array<string>"))
    scored = evaluation.retrieval_gate(golden)
    return scored.select(F.col("repo_name").alias("id"), F.size("source_urls").cast("long").alias("n_sources"), F.array_join("missing_sources", " ").alias("missing"), "passed")


@query(r"""WITH a AS (SELECT id, coalesce(body, '') AS answer, url, coalesce(len(comments), 0) > 0 AS fired, coalesce(regexp_matches(url, '^https?://\S+$'), false) AND coalesce(issue_state, '') <> 'closed' AS retrieved FROM issues_data),
           u AS (SELECT *, list_distinct(list_concat(regexp_extract_all(answer, '\[[^\]]*\]\((https?://[^)\s]+)\)', 1),
                   list_transform(regexp_extract_all(answer, 'https?://[^\s)\]>"'']+'), lambda x: regexp_replace(x, '[.,;:)]+$', '')))) AS cited FROM a),
           s AS (SELECT id, retrieved, retrieved AND fired AND len(list_filter(cited, lambda x: url IS NULL OR x <> url)) = 0 AND contains(answer, '.') AND NOT contains(answer, 'password') AS passed FROM u)
           SELECT *, CASE WHEN NOT retrieved THEN 'blocked' WHEN passed THEN 'passed' ELSE 'failed' END AS status FROM s""")
def gate_status(spark, sf):
    """Both gates in order: an answer counts only if retrieval found the issue (closed ones are not shown)."""
    issues = table(spark, sf, "issues_data")
    shown = issues.withColumn("rank", F.lit(1)).withColumn("score", F.lit(1.0)).withColumn("content_text", F.lit("")).withColumn("citation_url", F.when(F.coalesce("issue_state", F.lit("")) != "closed", F.col("url")))
    first = evaluation.retrieval_gate(
        shown.select("id", search.issue_entry().alias("output"), F.array(F.coalesce("url", F.lit("?"))).alias("expected_source_urls"), F.array().cast("array<string>").alias("must_appear_in_answer"))
    )
    return evaluation.gated(first, _answers_scored(spark, sf))


# --- streams ----------------------------------------------------------------


@query("""SELECT CAST(user_id AS VARCHAR) AS stream_id, CAST(day(ts) AS INT) AS call_index, coalesce(max_by(event_type, event_id) FILTER (value > 20), '') AS name, string_agg(props, '' ORDER BY event_id) AS arguments FROM events GROUP BY 1, 2""")
def stream_tool_calls(spark, sf):
    """Calls folded by a stateful stream: one row when the last fragment of a call has come."""
    last = F.max("event_id").over(Window.partitionBy("user_id", F.dayofmonth("ts")))
    fragments = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("stream_id"), F.dayofmonth("ts").alias("call_index"), F.col("event_id").alias("position"), F.when(F.col("value") > 20, F.col("event_type")).alias("name"),
        F.col("props").alias("fragment"), (F.col("event_id") == last).alias("finished"),
    )
    stored = materialize(fragments, "fragments")
    source, base, name = stored.inputFiles()[0].rsplit("/", 1)[0], f"{shared_dir(spark)}/docloom/stream-{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return sessions.drained(chat.folded_calls(spark.readStream.schema(stored.schema).parquet(source)), f"{base}/out", f"{base}/state")
    finally:
        spark.conf.set(name, before)
