"""Readers of documentation, code and issue dumps, and of change lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.html import decoded_content, html_to_text
from docloom.functions.text import day, label_list
from docloom.schema import API_ISSUE, GOLDEN, ISSUE_RECORD, RAW_CODE, RAW_DOC

#: What counts as code.
CODE_EXTENSIONS = ("yaml", "yml", "py", "go", "json", "sh", "ts", "js", "md")
CODE_NAMES = ("Dockerfile", "Makefile", "Kustomization")


def is_doc(path: Column) -> Column:
    return path.endswith(".md") | path.endswith(".html")


def is_code(name: Column, extensions: tuple[str, ...] = CODE_EXTENSIONS) -> Column:
    wanted = [e.lstrip(".") for e in extensions]
    extension = F.lower(F.element_at(F.split(name, r"\."), -1))
    return (name.contains(".") & extension.isin(wanted)) | name.isin(*CODE_NAMES)


def is_repository(repo: Column) -> Column:
    return repo.contains("/")


def _tree(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(root).select("value", F.col("_metadata.file_path").alias("full"))
    base = root.rstrip("/").split("://", 1)[-1]
    path = F.url_decode(F.replace(F.substring_index("full", f"{base.rsplit('/', 1)[-1]}/", -1), F.lit("+"), F.lit("%2B")))
    return files.select(path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("file_name"), F.col("value").alias("content"))


def docs_tree(spark: SparkSession, root: str) -> DataFrame:
    """All ``.md`` and ``.html`` files below a folder; HTML as its visible text."""
    files = _tree(spark, root).where(is_doc(F.col("file_name")))
    content = F.when(F.col("file_name").endswith(".html"), html_to_text("content")).otherwise(F.col("content"))
    return files.select("path", content.alias("content"), "file_name")


def code_tree(spark: SparkSession, root: str, repo: str, extensions: tuple[str, ...] = CODE_EXTENSIONS) -> DataFrame:
    files = _tree(spark, root).where(is_code(F.col("file_name"), extensions))
    return files.select("path", "content", "file_name", F.lit(repo).alias("repo"), F.lit(None).cast("string").alias("citation_url"))


def api_contents(listing: DataFrame) -> DataFrame:
    """Files of a contents API listing: base64 decoded, undecodable ones left out."""
    text = decoded_content(F.col("content"))
    return listing.where("type = 'file' or type is null").select("path", F.col("name").alias("file_name"), text.alias("content"), F.col("html_url").alias("citation_url")).where("content is not null")


def changed_paths(spark: SparkSession, changed: str) -> DataFrame:
    """``path`` of each changed document named in a JSON array; bad JSON gives none."""
    one = spark.range(1).select(F.explode(F.coalesce(F.from_json(F.lit(changed), "array<string>"), F.array().cast("array<string>"))).alias("path"))
    return one.where(F.col("path").isNotNull() & is_doc(F.col("path"))).distinct()


def webhook_changes(commits: DataFrame) -> DataFrame:
    """``path`` and ``removed`` of the documents that commits name, each once.

    A path that was removed and is also added or modified counts as present.
    """
    kinds = [("added", False), ("modified", False), ("removed", True)]
    out = None
    for name, gone in kinds:
        part = commits.select(F.explode(name).alias("path"), F.lit(gone).alias("removed"))
        out = part if out is None else out.unionByName(part)
    return out.where(is_doc(F.col("path"))).groupBy("path").agg(F.bool_and("removed").alias("removed"))


def scans(repos: str, directories: str, spark: SparkSession) -> DataFrame:
    """Every repository with every directory of two comma lists; bad names left out."""
    parts = lambda text, name: F.explode(F.filter(F.transform(F.split(F.lit(text), ","), lambda x: F.trim(x)), lambda x: x != "")).alias(name)
    one = spark.range(1)
    return one.select(parts(repos, "repo")).where(is_repository(F.col("repo"))).select("repo", parts(directories, "directory"))


def capped_per_repo(issues: DataFrame, repo: str, order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` records of each repository, counted after other filters."""
    window = Window.partitionBy(repo).orderBy(*order)
    return issues.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= cap).drop("_n")


def api_issues(raw: DataFrame, repo: str, comments: DataFrame | None = None) -> DataFrame:
    """Issue records from API payloads; pull requests left out, comments in order."""
    issues = raw.where("pull_request is null")
    short = repo.split("/")[-1]
    out = issues.select(
        F.lit(f"issues/{short}/").alias("head"), F.col("number").alias("issue_number"), "title", F.lit(repo).alias("repo_name"), F.col("state").alias("issue_state"),
        label_list(F.coalesce("labels", F.array())).alias("issue_labels"), day(F.col("created_at")).alias("created_at"), day(F.col("updated_at")).alias("updated_at"),
        F.coalesce("body", F.lit("")).alias("body"), F.col("html_url").alias("url"),
    )
    out = out.withColumn("path", F.concat("head", F.col("issue_number").cast("string"))).withColumn("file_name", F.concat(F.lit(f"issue-{short}-"), F.col("issue_number").cast("string"), F.lit(".md"))).drop("head")
    if comments is None:
        return out.withColumn("comments", F.array().cast("array<struct<author:string,created_at:string,body:string>>"))
    return out.join(nested_comments(comments, ["issue_number"]), "issue_number", "left").withColumn("comments", F.coalesce("comments", F.array().cast("array<struct<author:string,created_at:string,body:string>>")))


def nested_comments(comments: DataFrame, keys: list[str], order: str = "position") -> DataFrame:
    """One array of comments for each key, in order; authors default to unknown."""
    item = F.struct(order, F.coalesce("author", F.lit("unknown")).alias("author"), "created_at", F.coalesce("body", F.lit("")).alias("body"))
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["author"].alias("author"), x["created_at"].alias("created_at"), x["body"].alias("body")))
    return comments.groupBy(*keys).agg(ordered.alias("comments"))


def stage(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON lines of an earlier stage; fields that are missing become NULL."""
    return spark.read.schema({"docs": RAW_DOC, "code": RAW_CODE, "issues": ISSUE_RECORD, "api_issues": API_ISSUE}[kind]).json(path)


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.sql import types as T

    whole = T.StructType([T.StructField("queries", T.ArrayType(GOLDEN))])
    return spark.read.schema(whole).option("multiLine", "true").json(path).select(F.inline("queries"))
