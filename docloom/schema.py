"""Record types of the pipelines and the contracts of stored collections."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _s(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


COMMENT = T.StructType(_s("author", "created_at", "body"))
RAW_DOC = T.StructType(_s("path", "content", "file_name"))
RAW_CODE = T.StructType(_s("path", "content", "file_name", "repo", "citation_url"))
ISSUE_RECORD = T.StructType(
    _s("path", "content", "file_name", "url", "title", "repo_name") + [T.StructField("issue_number", T.LongType())]
    + _s("issue_state", "issue_labels", "created_at", "updated_at", "body") + [T.StructField("comments", T.ArrayType(COMMENT))]
)
API_ISSUE = T.StructType(
    [T.StructField("number", T.LongType()), *_s("title", "body", "state", "html_url", "created_at", "updated_at"),
     T.StructField("labels", T.ArrayType(T.StructType(_s("name")))), T.StructField("comments", T.LongType()),
     T.StructField("user", T.StructType(_s("login"))), T.StructField("pull_request", T.StringType())]
)
CODE_CHUNK = T.StructType(_s("content", "resource_kind", "resource_name", "resource_namespace", "file_type"))
GOLDEN = T.StructType(
    _s("id", "query", "retrieval_query", "tool", "collection")
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("expected_source_urls", "must_appear_in_answer", "forbidden_in_answer")]
)

#: Longest stored strings, in characters.
CITATION_CHARS, CONTENT_CHARS, KIND_CHARS, NAME_CHARS, TYPE_CHARS = 1024, 2000, 128, 256, 64

_KEYS = [("file_unique_id", 512), ("repo_name", 256)]
_FILE = [("file_path", 512), ("file_name", 256)]
_TEXT = [("citation_url", CITATION_CHARS), ("content_text", CONTENT_CHARS)]


@dataclass(frozen=True)
class CollectionSpec:
    """Columns, version, vector dimension and string limits of one collection."""

    name: str
    strings: tuple[tuple[str, int], ...]
    longs: tuple[str, ...]
    version: int = 1
    dim: int = 768

    @property
    def schema(self) -> T.StructType:
        fields = [T.StructField("id", T.LongType(), False)] + _s(*(n for n, _ in self.strings))
        fields += [T.StructField(n, T.LongType()) for n in self.longs]
        return T.StructType([*fields, T.StructField("vector", T.ArrayType(T.FloatType(), False)), T.StructField("last_updated", T.LongType())])

    @property
    def description(self) -> str:
        return f"{self.name} (v={self.version})"

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "version": self.version, "dim": self.dim, "strings": self.strings, "longs": self.longs})

    @staticmethod
    def from_json(text: str) -> CollectionSpec:
        d = json.loads(text)
        return CollectionSpec(d["name"], tuple((n, k) for n, k in d["strings"]), tuple(d["longs"]), d["version"], d["dim"])


DOCS = CollectionSpec("docs", tuple(_KEYS + _FILE + _TEXT), ("chunk_index",))
ISSUES = CollectionSpec("issues", tuple(_KEYS + _TEXT + [("issue_state", 32), ("issue_labels", 1024), ("source_type", 64)]), ("chunk_index", "issue_number"))
CODE = CollectionSpec(
    "code",
    tuple(_KEYS + _FILE + _TEXT + [("resource_kind", KIND_CHARS), ("resource_name", NAME_CHARS), ("resource_namespace", NAME_CHARS), ("file_type", TYPE_CHARS)]),
    ("chunk_index",),
)


def described_version(description: str) -> int | None:
    """The version tag of a collection's description; None if it has none."""
    found = re.search(r"\(v=(\d+)\)", description or "")
    return int(found[1]) if found else None


def check_collection(spec: CollectionSpec, schema: T.StructType, description: str = "", vector_dim: int | None = None) -> None:
    """Raise if a stored table cannot take rows of ``spec``.

    An untagged description is accepted if the columns fit; ``last_updated`` may
    be missing in old tables; versions are compared as whole numbers.
    """
    version = described_version(description)
    if version is not None and version != spec.version:
        raise RuntimeError(f"collection {spec.name} has version {version}, not {spec.version}")
    want = {f.name: f.dataType for f in spec.schema if f.name not in ("id", "last_updated")}
    have = {f.name: f.dataType for f in schema}
    missing = sorted(set(want) - set(have))
    if missing:
        raise RuntimeError(f"collection {spec.name} lacks the columns {missing}")
    wrong = sorted(n for n, kind in want.items() if kind.simpleString() != have[n].simpleString())
    if wrong:
        raise RuntimeError(f"collection {spec.name} has other types in {wrong}")
    if vector_dim is not None and vector_dim != spec.dim:
        raise RuntimeError(f"collection {spec.name}: vector_dim={vector_dim}, expected {spec.dim}")


def row_id(*keys: str) -> Column:
    """A surrogate key that is the same in every run."""
    return F.xxhash64(*keys)


def fit_to(df: DataFrame, spec: CollectionSpec, run_epoch: int, target: T.StructType | None = None) -> DataFrame:
    """Rows shaped for storage: limits cut, missing texts empty, one time stamp.

    With ``target``, the schema of an existing table, columns which that table
    lacks are left out.
    """
    cut = [F.substring(F.coalesce(F.col(n) if n in df.columns else F.lit(None).cast("string"), F.lit("")), 1, k).alias(n) for n, k in spec.strings]
    longs = [F.col(n).cast("long").alias(n) for n in spec.longs]
    vector = F.col("embedding") if "embedding" in df.columns else F.col("vector")
    out = df.select(
        row_id("file_unique_id", "chunk_index").alias("id"), *cut, *longs, vector.cast("array<float>").alias("vector"), F.lit(run_epoch).cast("long").alias("last_updated")
    )
    return out if target is None else out.select(*[c for c in out.columns if c in target.names])
