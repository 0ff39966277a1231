"""Versioned chunk tables: replace by key, delete, append, and their checks.

Parquet tables cannot be changed in place.  The files of a collection lie in folders
``data/repo_name=<name>/commit=<id>`` and never change; a commit is one small file
that names the folders that make up the table, created once and never overwritten.
The highest commit counts, so readers see the old or the new table, never a mixture;
of two writers that made the same commit one fails; and a change writes only the
repositories that it touches.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.physical import materialize, sized_broadcast
from docloom.schema import CollectionSpec, check_collection

BROADCAST_KEYS = 500_000


def replaced(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` without the keys of ``incoming``, plus ``incoming``.

    All old chunks of an incoming key go, so replaying an update changes nothing.
    Keys that are NULL match nothing and only add.
    """
    return stored.join(incoming.select(*keys).distinct(), keys, "left_anti").select(*incoming.columns).unionByName(incoming)


def deleted(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(gone.select(*keys).distinct(), keys, "left_anti")


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key, the first by ``order``; partially aggregated."""
    packed = F.struct(*[c for c in rows.columns])
    best = rows.groupBy(*keys).agg(F.max_by(packed, F.struct(*order)).alias("best"))
    return best.select("best.*")


def violations(rows: DataFrame, spec: CollectionSpec) -> DataFrame:
    """``rows`` that the collection cannot hold, with ``reason``.

    Reasons are a missing key, a text above its limit, and a vector of another
    dimension; the first that applies is told.
    """
    reasons = [F.when(F.col(n).isNull(), F.lit(f"{n} is missing")) for n, _ in spec.strings[:2]]
    reasons += [F.when(F.length(n) > k, F.lit(f"{n} exceeds {k} characters")) for n, k in spec.strings]
    reasons += [F.when(F.col("vector").isNull() | (F.size("vector") != spec.dim), F.lit(f"vector has not {spec.dim} numbers"))]
    return rows.withColumn("reason", F.coalesce(*reasons)).where("reason is not null")


def written_lines(rows: DataFrame, path: str) -> None:
    """Write a stage as JSON lines; all letters stay as they are, and NULL fields are kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").option("encoding", "UTF-8").json(path)


class CommitConflict(RuntimeError):
    """Another writer made this commit first."""


class Collection:
    """A chunk table in a folder, with its spec and version beside it."""

    def __init__(self, spark: SparkSession, path: str, spec: CollectionSpec):
        self.spark, self.path, self.spec = spark, path.rstrip("/"), spec

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[str]:
        """Names of the commits, latest first."""
        path, files = self._path()
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path)]
        return sorted((n for n in names if n.startswith("_commit-")), reverse=True)

    def _commit_named(self, name: str) -> dict:
        """A commit; empty while it is still being written."""
        path, files = self._path(name)
        stream = files.open(path)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return {}

    def _latest(self) -> dict | None:
        """The latest whole commit: before one that is still being written the one before counts."""
        return next((commit for commit in map(self._commit_named, self._commits()) if commit), None)

    def _publish(self, commit: dict) -> None:
        path, files = self._path(f"_commit-{commit['number']:010d}.json")
        try:
            out = files.create(path, False)  # fails if it is there
        except Exception as error:
            raise CommitConflict(f"commit {commit['number']} of {self.path} was made by another writer") from error
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()

    def _written(self, rows: DataFrame, new: bool = True) -> dict[str | None, list[str]]:
        """Write rows to folders of their own: folders by repository; ``new`` rows are checked first."""
        bad = [] if not new else violations(rows, self.spec).groupBy("reason").agg(F.count("*").alias("n"), F.min("file_unique_id").alias("first")).orderBy("reason").collect()  # one row a reason
        if bad:
            raise RuntimeError("; ".join(f"{r['n']} rows: {r['reason']} (first: {r['first']})" for r in bad))
        name = uuid.uuid4().hex
        columns = [c for c in self.spec.schema.names if c in rows.columns]
        rows.select(*columns, F.lit(name).alias("commit")).write.mode("append").partitionBy("repo_name", "commit").parquet(f"{self.path}/data")
        path, files = self._path(f"data/repo_name=*/commit={name}")
        found = files.globStatus(path) or []
        out: dict[str | None, list[str]] = {}
        for status in found:
            folder = status.getPath().getParent().getName()
            value = unquote(folder.split("=", 1)[1])
            out[None if value == "__HIVE_DEFAULT_PARTITION__" else value] = [f"{folder}/commit={name}"]
        return out

    def _commit(self, before: dict | None, live: list[tuple[str | None, list[str]]], deleted: int, inserted: int) -> dict[str, int]:
        had = before["rows"] if before else 0
        self._publish(
            {"number": (before["number"] if before else 0) + 1, "description": self.spec.description, "spec": json.loads(self.spec.to_json()),
             "live": [x for x in live if x[1]], "rows": had - deleted + inserted}
        )
        return {"before": had, "deleted": deleted, "inserted": inserted, "after": had - deleted + inserted}

    def exists(self) -> bool:
        return self._latest() is not None

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.spec.schema)
        # Values such as numeric repository names stay texts with a given schema.
        reader = self.spark.read.schema(self.spec.schema).option("basePath", f"{self.path}/data")
        return reader.parquet(*[f"{self.path}/data/{f}" for f in folders]).select(*self.spec.schema.names)

    def read(self, columns: list[str] | None = None, where: Column | None = None, limit: int | None = None) -> DataFrame:
        """The stored rows; columns, filter and limit apply in the scan."""
        now = self._latest()
        rows = self._read([f for _, folders in now["live"] for f in folders] if now else [])
        rows = rows if where is None else rows.where(where)
        rows = rows if columns is None else rows.select(*columns)
        return rows if limit is None else rows.limit(limit)

    def count(self) -> int:
        now = self._latest()
        return now["rows"] if now else 0

    def check(self) -> None:
        now = self._latest()
        if now is not None:
            check_collection(self.spec, self.read().schema, now["description"], now["spec"]["dim"])

    def create(self) -> None:
        if not self.exists():
            self._commit(None, [], 0, 0)

    def overwrite(self, rows: DataFrame) -> dict[str, int]:
        now, rows = self._latest(), materialize(rows, "incoming")
        return self._commit(now, list(self._written(rows).items()), now["rows"] if now else 0, rows.count())

    def append(self, rows: DataFrame) -> dict[str, int]:
        self.check()
        now, rows = self._latest(), materialize(rows, "incoming")
        live = dict(now["live"]) if now else {}
        for repo, folders in self._written(rows).items():
            live[repo] = live.get(repo, []) + folders
        return self._commit(now, list(live.items()), 0, rows.count())

    def change(self, gone: DataFrame, keys: list[str], rows: DataFrame | None = None, scope: str | None = None) -> dict[str, int]:
        """Delete the keys of ``gone`` and add ``rows`` in one commit; returns the totals.

        Only repositories that may hold these keys, and those of ``rows``, are
        written.  With ``scope`` all stored rows of the scopes of ``gone`` go.
        """
        self.check()
        now = self._latest()
        live = dict(now["live"]) if now else {}
        keys = [scope] if scope else keys
        lost = materialize(gone.select(*keys).distinct(), "gone")
        if "repo_name" in keys:
            repos = [r[0] for r in lost.select("repo_name").distinct().collect()]  # as many as repositories
            touched = [r for r in live if r in set(repos)]
        else:
            touched = self._holding(live, lost, keys)
        stored = self._read([f for r in touched for f in live[r]])
        kept = deleted(stored, sized_broadcast(lost, BROADCAST_KEYS), keys)
        n_deleted = stored.join(sized_broadcast(lost, BROADCAST_KEYS), keys, "left_semi").count() if touched else 0
        if not n_deleted:
            kept, touched = None, []
        added = self._written(rows) if rows is not None else {}
        rest = self._written(kept, new=False) if kept is not None else {}
        for repo in touched:
            live[repo] = rest.get(repo, [])
        for repo, folders in added.items():
            live[repo] = live.get(repo, []) + folders
        return self._commit(now, list(live.items()), n_deleted, rows.count() if rows is not None else 0)

    def _holding(self, live: dict[str | None, list[str]], lost: DataFrame, keys: list[str]) -> list[str | None]:
        """The repositories that hold some of these keys; reads the key columns only."""
        stored = self._read([f for folders in live.values() for f in folders])
        held = stored.select("repo_name", *keys).join(sized_broadcast(lost, BROADCAST_KEYS), keys, "left_semi")
        return [r[0] for r in held.select("repo_name").distinct().collect()]  # as many as repositories

    def upsert(self, rows: DataFrame, keys: list[str]) -> dict[str, int]:
        rows = materialize(rows, "incoming")
        return self.change(rows, keys, rows)

    def delete(self, gone: DataFrame, keys: list[str]) -> dict[str, int]:
        return self.change(gone, keys)

    def sync(self, rows: DataFrame, keys: list[str], scope: str = "repo_name") -> dict[str, int]:
        """Upsert that also removes stored keys which the scanned scopes no longer have."""
        rows = materialize(rows, "incoming")
        return self.change(rows, keys, rows, scope)

    def compact(self, most: int = 8) -> int:
        """Write repositories of more than ``most`` folders anew, into one each; returns how many there were."""
        now = self._latest()
        live = dict(now["live"]) if now else {}
        many = [repo for repo, folders in live.items() if len(folders) > most]
        if many:
            written = self._written(self._read([f for repo in many for f in live[repo]]), new=False)
            self._commit(now, list((live | {repo: written.get(repo, []) for repo in many}).items()), 0, 0)
        return len(many)

    def vacuum(self, keep: int = 2) -> int:
        """Delete the commits before the last ``keep`` and the folders that only they name; returns how many folders.

        Readers of those commits fail, so none may be running.
        """
        names = self._commits()
        kept = {f for name in names[:keep] for _, folders in self._commit_named(name).get("live", []) for f in folders}
        old = {f for name in names[keep:] for _, folders in self._commit_named(name).get("live", []) for f in folders} - kept
        for name in [f"data/{f}" for f in sorted(old)] + names[keep:]:
            path, files = self._path(name)
            files.delete(path, True)
        return len(old)
