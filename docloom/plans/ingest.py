"""Pipelines from raw files and issues to stored chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import schema as S
from docloom.functions import splitting, text
from docloom.functions.cleaning import clean_page
from docloom.operators.embedding import EMBED_CHARS, PAGE_EMBED_CHARS, Provider, embedded
from docloom.operators.physical import materialize, spread
from docloom.operators.store import Collection

#: Chunk sizes and overlaps of each corpus, and shortest contents.
PAGE, THREAD, SOURCE, CHANGED_PAGE = (600, 60), (1500, 150), (1000, 100), (1200, 100)
SHORTEST_PAGE, SHORTEST_SOURCE = 50, 10


def page_chunks(files: DataFrame, repo: Column, base_url: str, cleaner: Callable[[Column], Column] = clean_page, size: tuple[int, int] = PAGE, scan: bool = True) -> DataFrame:
    """Docs chunks: cleaned, cut, numbered from 0 in each file, with citation.

    Files without content, or with less than 50 characters after cleaning, give
    none.  ``files`` have ``path, file_name, content`` (and ``id``, which is kept,
    to tell files fetched twice apart).  Nothing is shuffled but a scan of a few
    small files; ``scan`` tells that ``files`` is such a scan.
    """
    keep = ["id"] if "id" in files.columns else []
    # The length is tested in the argument: a filter would move below the cleaning
    # and clean twice.
    cleaned = (spread(files) if scan else files).withColumn("_clean", cleaner(F.col("content")))
    long = F.when(F.length("_clean") >= SHORTEST_PAGE, F.col("_clean"))
    cut = cleaned.select(
        *keep, text.file_unique_id(repo, F.col("path")).alias("file_unique_id"), repo.alias("repo_name"), F.col("path").alias("file_path"), "file_name",
        F.substring(text.docs_citation(F.col("path"), base_url), 1, S.CITATION_CHARS).alias("citation_url"), splitting.text_chunker(*size)(long).alias("chunks"),
    )
    out = splitting.exploded(cut, "chunks", [*keep, "file_unique_id", "repo_name", "file_path", "file_name", "citation_url"])
    return out.withColumn("content_text", F.substring("chunk", 1, S.CONTENT_CHARS)).drop("chunk")


def thread_chunks(issues: DataFrame, size: tuple[int, int] = THREAD) -> DataFrame:
    """Issue chunks: each with the issue's metadata before it; comments stay whole if they fit."""
    c = F.col
    meta = text.issue_metadata(c("title"), c("repo_name"), c("issue_number"), c("issue_state"), c("issue_labels"), c("url"), c("content"))
    segments = text.issue_segments(
        c("title"), c("repo_name"), c("issue_number"), c("url"), c("issue_labels"), c("issue_state"), c("created_at"), c("updated_at"), c("body"), c("comments"), c("content")
    )
    keep = ["id"] if "id" in issues.columns else []
    prepared = spread(issues).select(*keep, meta.alias("meta"), segments.alias("segments"), "content")
    cut = prepared.select(*keep, "meta", splitting.segment_chunker(*size)("segments", text.issue_prefix(c("meta")), "content").alias("chunks"))
    out = splitting.exploded(cut, "chunks", [*keep, "meta"])
    number = c("meta.issue_number")
    return out.select(
        *keep, F.concat(c("meta.repo_name"), F.lit(":issues/"), number.cast("string")).alias("file_unique_id"), c("meta.repo_name").alias("repo_name"), number.alias("issue_number"),
        c("meta.issue_state").alias("issue_state"), c("meta.issue_labels").alias("issue_labels"), F.substring(c("meta.citation_url"), 1, S.CITATION_CHARS).alias("citation_url"),
        "chunk_index", F.substring("chunk", 1, S.CONTENT_CHARS).alias("content_text"), F.lit("issue").alias("source_type"),
    )


def source_chunks(files: DataFrame, size: tuple[int, int] = SOURCE) -> DataFrame:
    """Code chunks by kind of file, with the resource or definition that they hold."""
    c = F.col
    keep = ["id"] if "id" in files.columns else []
    content = F.regexp_replace("content", r"(?U)\s+\z", "")
    long = F.when(F.length("_content") >= SHORTEST_SOURCE, F.col("_content"))
    cut = spread(files).withColumn("_content", content).select(
        *keep, text.file_unique_id(c("repo"), c("path")).alias("file_unique_id"), c("repo").alias("repo_name"), c("path").alias("file_path"), "file_name",
        F.substring(text.code_citation(c("citation_url"), c("repo"), c("path")), 1, S.CITATION_CHARS).alias("citation_url"), splitting.code_chunker(*size)(long, "path").alias("chunks"),
    )
    out = splitting.exploded(cut, "chunks", [*keep, "file_unique_id", "repo_name", "file_path", "file_name", "citation_url"])
    limits = {"resource_kind": S.KIND_CHARS, "resource_name": S.NAME_CHARS, "resource_namespace": S.NAME_CHARS, "file_type": S.TYPE_CHARS}
    meta = [F.substring(c("chunk")[n], 1, k).alias(n) for n, k in limits.items()]
    return out.select(*[x for x in out.columns if x != "chunk"], F.substring(c("chunk.content"), 1, S.CONTENT_CHARS).alias("content_text"), *meta)


def store_pages(collection: Collection, chunks: DataFrame, provider: Callable[[], Provider], run_epoch: int, sync: bool = False) -> dict[str, int]:
    """Embed and store page chunks; a page's chunks are replaced by repository and path.

    Returns how many chunks there were, were deleted, inserted, and are.
    """
    rows = S.fit_to(embedded(chunks, "content_text", provider, PAGE_EMBED_CHARS, dim=collection.spec.dim), collection.spec, run_epoch)
    if sync:
        return collection.sync(rows, ["repo_name", "file_path"])
    return collection.upsert(rows, ["repo_name", "file_path"])


def store_chunks(collection: Collection, chunks: DataFrame, provider: Callable[[], Provider], run_epoch: int) -> dict[str, int]:
    """Embed and store issue or code chunks; replaced by ``file_unique_id``."""
    rows = S.fit_to(embedded(chunks, "content_text", provider, EMBED_CHARS, dim=collection.spec.dim), collection.spec, run_epoch)
    return collection.upsert(rows, ["file_unique_id"])


def update_changed(collection: Collection, changed: DataFrame, files: DataFrame, repo: str, base_url: str, provider: Callable[[], Provider], run_epoch: int) -> dict[str, int]:
    """Bring a collection up to date with changed and removed paths, in one commit.

    ``changed`` has ``path``; a path that ``files`` no longer has only loses its
    chunks.
    """
    found = spread(files).join(changed.select("path").distinct(), "path", "left_semi")
    chunks = page_chunks(found, F.lit(repo), base_url, size=CHANGED_PAGE, scan=False)
    rows = S.fit_to(embedded(chunks, "content_text", provider, PAGE_EMBED_CHARS, dim=collection.spec.dim), collection.spec, run_epoch)
    gone = changed.select(F.lit(repo).alias("repo_name"), F.col("path").alias("file_path")).distinct()
    return collection.change(gone, ["repo_name", "file_path"], materialize(rows, "changed"))


def follow_changes(changes: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str):
    """A stream of changed paths, applied batch by batch; returns the running query."""
    return changes.writeStream.foreachBatch(lambda rows, _: apply(rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
