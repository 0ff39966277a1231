"""Column functions over paths, addresses, issues, search text and chat text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(value: Column) -> Column:
    """NULL as the empty string."""
    return F.coalesce(value, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def file_unique_id(repo: Column, path: Column) -> Column:
    return F.concat(repo, F.lit(":"), path)


def without_extension(path: Column) -> Column:
    """Without the last extension of the last segment; leading dots are no extension."""
    return F.regexp_replace(path, r"([^/.][^/]*)\.[^./]*$", "$1")


def docs_citation(path: Column, base_url: str, marker: str = "content/en/docs") -> Column:
    """Page address: what follows the first ``docs`` segment, without extension.

    Paths outside ``marker``, or without a segment ``docs``, keep their whole path.
    """
    parts = F.split(path, "/")
    at = F.array_position(parts, F.lit("docs"))
    tail = F.array_join(F.slice(parts, (at + 1).cast("int"), F.greatest(F.size(parts), F.lit(1))), "/")
    page = F.when(path.contains(marker) & (at > 0), without_extension(tail)).otherwise(path)
    return F.concat(F.lit(base_url.rstrip("/") + "/"), page)


def code_citation(citation: Column, repo: Column, path: Column, host: str = "https://github.com") -> Column:
    return F.coalesce(F.nullif(citation, F.lit("")), F.concat(F.lit(host + "/"), repo, F.lit("/blob/main/"), path))


def label_list(labels: Column) -> Column:
    return F.array_join(F.transform(labels, lambda x: x["name"]), ", ")


def day(timestamp: Column) -> Column:
    return F.substring(timestamp, 1, 10)


#: Fixed values, from here to ``issue_segments``: how issues are worded, and the patterns that read it.
def comment_block(comment: Column) -> Column:
    return F.concat(
        F.lit("**Comment by @"), F.coalesce(comment["author"], F.lit("unknown")), F.lit("** ("), filled(comment["created_at"]), F.lit("):\n"), filled(comment["body"])
    )


def issue_markdown(title, repo, number, url, labels, state, created, updated, body, comments) -> Column:
    """The readable form of an issue: header block, body, then its comments."""
    head = F.concat(
        F.lit("# "), filled(title), F.lit("\n\n**Repository:** "), filled(repo), F.lit("\n**Issue:** #"), F.coalesce(number, F.lit(0)).cast("string"),
        F.lit("\n**URL:** "), filled(url), F.lit("\n**Labels:** "), filled(labels), F.lit("\n**State:** "), filled(state),
        F.lit("\n**Created:** "), filled(created), F.lit("\n**Updated:** "), filled(updated), F.lit("\n\n"), filled(body),
    )
    tail = F.array_join(F.transform(F.coalesce(comments, F.array()), lambda c: F.concat(F.lit("\n\n---\n"), comment_block(c))), "")
    return F.concat(head, tail)


def _found(content: Column, pattern: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(content, pattern, 1), r"(?U)\A\s+|\s+\z", ""))


def parsed_issue(content: Column) -> Column:
    """Metadata read from an issue's readable form; missing parts empty or 0."""
    text = filled(content)
    number = F.regexp_extract(text, r"(?d)\*\*Issue:\*\*\s*#(\d+)", 1)
    return F.struct(
        _found(text, r"(?md)^#\s+(.+)").alias("title"),
        _found(text, r"(?d)\*\*Repository:\*\*\s*(.+)").alias("repo_name"),
        F.coalesce(F.expr("bigint(null)"), F.when(number != "", number.cast("long")), F.lit(0)).alias("issue_number"),
        _found(text, r"(?d)\*\*State:\*\*\s*(\w+)").alias("issue_state"),
        _found(text, r"(?d)\*\*Labels:\*\*[ \t]*(.*)").alias("issue_labels"),
        _found(text, r"(?d)\*\*URL:\*\*\s*(.+)").alias("citation_url"),
    )


def has_structure(number: Column, title: Column, repo: Column, state: Column) -> Column:
    return number.isNotNull() | (filled(title) != "") | (filled(repo) != "") | (filled(state) != "")


def issue_metadata(title, repo, number, state, labels, url, content) -> Column:
    """Structured fields where there are any, else what the text says."""
    clean = lambda c: F.regexp_replace(filled(c), r"(?U)\A\s+|\s+\z", "")
    structured = F.struct(
        clean(title).alias("title"), clean(repo).alias("repo_name"), F.coalesce(number.cast("long"), F.lit(0)).alias("issue_number"),
        clean(state).alias("issue_state"), clean(labels).alias("issue_labels"), clean(url).alias("citation_url"),
    )
    return F.when(has_structure(number, title, repo, state), structured).otherwise(parsed_issue(content))


def is_empty_metadata(meta: Column) -> Column:
    texts = [meta[n] == "" for n in ("title", "repo_name", "issue_state", "issue_labels", "citation_url")]
    out = meta["issue_number"] == 0
    for t in texts:
        out = out & t
    return out


def issue_prefix(meta: Column) -> Column:
    """What each chunk of an issue begins with; empty parts are left out."""
    part = lambda name, label: F.when(meta[name] != "", F.concat(F.lit(label), meta[name]))
    first = F.concat(F.lit("[Issue #"), meta["issue_number"].cast("string"), F.lit("] "), meta["title"])
    parts = F.concat_ws(" | ", first, part("repo_name", "Repo: "), part("issue_state", "State: "), part("issue_labels", "Labels: "))
    return F.concat(parts, F.lit("\n\n"))


def issue_segments(title, repo, number, url, labels, state, created, updated, body, comments, content) -> Column:
    """Header with body, then each comment; old records are cut at their rules."""
    strip = lambda c: F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")
    bit = lambda c, label: F.when(filled(c) != "", F.concat(F.lit(label), c))
    head = F.concat_ws(
        "\n", F.when(strip(filled(title)) != "", F.concat(F.lit("# "), strip(title))), bit(repo, "**Repository:** "),
        F.when(F.coalesce(number, F.lit(0)) != 0, F.concat(F.lit("**Issue:** #"), number.cast("string"))), bit(url, "**URL:** "),
        F.when(labels.isNotNull(), F.concat(F.lit("**Labels:** "), labels)), bit(state, "**State:** "), bit(created, "**Created:** "), bit(updated, "**Updated:** "),
    )
    first = let(head, lambda h: F.when((h != "") & (body != ""), F.concat(h, F.lit("\n\n"), body)).when(h != "", h).otherwise(body))
    structured = F.concat(F.array(strip(first)), F.transform(F.coalesce(comments, F.array()), lambda c: strip(comment_block(c))))
    old = F.transform(F.split(filled(content), "\n\n---\n"), strip)
    kept = F.filter(F.when(body.isNotNull(), structured).otherwise(old), lambda s: s != "")
    return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(filled(content))))


def stems(value: Column) -> Column:
    """The set of lower-cased six-character beginnings of words of four or more."""
    words = F.regexp_extract_all(filled(value), F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= 4), lambda w: F.lower(F.substring(w, 1, 6))))


def snippet(text: Column, limit: int = 400) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def source_urls(output: Column) -> Column:
    """Addresses of the Source lines of a rendered result, each once."""
    return F.array_distinct(F.regexp_extract_all(output, F.lit(r"(?md)^\*\*Source:\*\*\s+(https?://\S+)\s*$"), F.lit(1)))


def answer_urls(answer: Column) -> Column:
    """Targets of markdown links, then bare addresses without closing punctuation."""
    linked = F.regexp_extract_all(answer, F.lit(r"\[[^\]]*\]\((https?://[^)\s]+)\)"), F.lit(1))
    bare = F.regexp_extract_all(answer, F.lit(r"https?://[^\s)\]>\"']+"), F.lit(0))
    return F.array_union(linked, F.transform(bare, lambda u: F.regexp_replace(u, r"[.,;:)]+$", "")))


def html_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def chat_name(first_message: Column, words: int = 3) -> Column:
    return F.array_join(F.slice(F.split(F.trim(first_message), r"\s+"), 1, words), " ")


def link_text(url: Column, limit: int = 60) -> Column:
    bare = F.regexp_replace(url, r"^https?://", "")
    return F.when(F.length(bare) > limit, F.concat(F.substring(bare, 1, limit - 3), F.lit("..."))).otherwise(bare)


def key_id(public_key: Column) -> Column:
    return F.substring(F.sha2(public_key, 256), 1, 16)


def base64url(value: Column) -> Column:
    """Base64 for addresses: without padding, and without the line ends of long values."""
    return F.regexp_replace(F.translate(F.base64(value), "+/\r\n", "-_"), "=+$", "")


def token_claims(token: Column) -> Column:
    """Claims of a signed token, read without checking its signature."""
    middle = F.translate(F.element_at(F.split(token, r"\."), 2), "-_", "+/")
    padded = F.rpad(middle, (F.ceil(F.length(middle) / 4) * 4).cast("int"), "=")
    return F.from_json(F.decode(F.unbase64(padded), "UTF-8"), "iss string, sub string, iat bigint, exp bigint")


def chosen_answer(final: Column, parts: Column) -> Column:
    """The final text where there is one, else the streamed parts put together."""
    return F.coalesce(F.nullif(F.trim(final), F.lit("")), F.trim(F.array_join(parts, "")))


def incoming_message(raw: Column) -> Column:
    return F.coalesce(F.get_json_object(raw, "$.message"), raw)


def tool_arguments(raw: Column, top_k: int = 5) -> Column:
    parsed = F.from_json(raw, "query string, top_k int")
    return F.struct(filled(parsed["query"]).alias("query"), F.coalesce(parsed["top_k"], F.lit(top_k)).alias("top_k"))


def last_event_data(response: Column) -> Column:
    """The payload of the last data line of an event stream, or the text itself."""
    data = F.filter(F.split(response, "\r?\n"), lambda x: x.startswith("data:"))
    return F.when(F.size(data) > 0, F.trim(F.substring(F.element_at(data, -1), 6, 2**31 - 1))).otherwise(response)


def first_token(*values: Column) -> Column:
    """The first of several settings that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])
