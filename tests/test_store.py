import pytest
from pyspark.sql import functions as F

from docloom import schema as S
from docloom.operators import embedding, store
from docloom.plans import ingest

SPEC = S.CollectionSpec("docs", S.DOCS.strings, S.DOCS.longs, dim=8)


def chunks(spark, paths, words="alpha beta"):
    rows = [(f"o/r:{p}", "o/r", p, p, "u", i, f"{words} {p} {i}") for p in paths for i in range(3)]
    return spark.createDataFrame(rows, "file_unique_id string, repo_name string, file_path string, file_name string, citation_url string, chunk_index long, content_text string")


def contents(collection):
    return sorted((r["file_path"], r["chunk_index"], r["content_text"]) for r in collection.read().collect())


def test_upsert_replaces_and_repeats(spark, tmp_path):
    collection = store.Collection(spark, str(tmp_path / "c"), SPEC)
    assert collection.read().count() == 0 and not collection.exists()
    make = embedding.hashing_provider(8)
    ingest.store_pages(collection, chunks(spark, ["a.md", "b.md"]), make, 1)
    once = contents(collection)
    ingest.store_pages(collection, chunks(spark, ["a.md", "b.md"]), make, 1)
    assert contents(collection) == once and len(once) == 6
    ingest.store_pages(collection, chunks(spark, ["b.md"], "new"), make, 2)
    assert {c[2].split()[0] for c in contents(collection) if c[0] == "b.md"} == {"new"}
    collection.delete(spark.createDataFrame([("o/r", "a.md")], "repo_name string, file_path string"), ["repo_name", "file_path"])
    assert {c[0] for c in contents(collection)} == {"b.md"}
    ingest.store_pages(collection, chunks(spark, ["c.md"]), make, 3, sync=True)
    assert {c[0] for c in contents(collection)} == {"c.md"}
    assert {r[0] for r in collection.read().select(F.size("vector")).collect()} == {8}


def test_changed_and_removed_paths(spark, tmp_path):
    collection = store.Collection(spark, str(tmp_path / "c"), SPEC)
    make = embedding.hashing_provider(8)
    ingest.store_pages(collection, chunks(spark, ["a.md", "b.md", "c.md"]), make, 1)
    files = spark.createDataFrame([("a.md", "a.md", "fresh " * 40)], "path string, file_name string, content string")
    changed = spark.createDataFrame([("a.md",), ("b.md",)], "path string")
    ingest.update_changed(collection, changed, files, "o/r", "https://d.example", make, 2)
    found = contents(collection)
    assert {c[0] for c in found} == {"a.md", "c.md"} and all("fresh" in c[2] for c in found if c[0] == "a.md")


def test_dimension_and_version_checks(spark, tmp_path):
    collection = store.Collection(spark, str(tmp_path / "c"), SPEC)
    with pytest.raises(Exception, match="expected 8"):
        ingest.store_pages(collection, chunks(spark, ["a.md"]), embedding.hashing_provider(4), 1)
    with pytest.raises(RuntimeError, match="vector_dim=4"):
        S.check_collection(SPEC, SPEC.schema, "docs", 4)
    with pytest.raises(RuntimeError, match="version 10"):
        S.check_collection(SPEC, SPEC.schema, "docs (v=10)")
    S.check_collection(SPEC, SPEC.schema, "docs, untagged", 8)
    with pytest.raises(RuntimeError, match="lacks"):
        S.check_collection(S.CODE, SPEC.schema)


def test_limits_and_old_tables(spark):
    rows = chunks(spark, ["a.md"]).withColumn("citation_url", F.repeat(F.lit("u"), 2000)).withColumn("embedding", F.array(*[F.lit(0.5)] * 8))
    fitted = S.fit_to(rows, SPEC, 5)
    assert fitted.agg(F.max(F.length("citation_url"))).first()[0] == 1024
    old = type(SPEC.schema)([f for f in SPEC.schema if f.name != "last_updated"])
    assert "last_updated" not in S.fit_to(rows, SPEC, 5, old).columns


def test_provider_must_answer_each_text(spark):
    def short():
        import numpy as np

        return lambda texts: np.zeros((1, 4), np.float32)

    with pytest.raises(Exception, match="1 vectors for 3 texts"):
        embedding.embedded(chunks(spark, ["a.md"]).coalesce(1), "content_text", short).collect()


def test_null_keys_match_nothing(spark):
    a = spark.createDataFrame([(None, 1), ("k", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 3), ("k", 4)], "k string, v int")
    assert sorted(r["v"] for r in store.replaced(a, b, ["k"]).collect()) == [1, 3, 4]


def test_totals_and_untouched_repositories(spark, tmp_path):
    collection = store.Collection(spark, str(tmp_path / "c"), SPEC)
    make = embedding.hashing_provider(8)
    rows = lambda repo, paths: S.fit_to(embedding.embedded(chunks(spark, paths).withColumn("repo_name", F.lit(repo)), "content_text", make), SPEC, 1)
    keys = ["repo_name", "file_path"]
    assert collection.upsert(rows("o/r", ["a", "b"]), keys) == {"before": 0, "deleted": 0, "inserted": 6, "after": 6}
    assert collection.upsert(rows("p/ü #1=%", ["a", "c"]), keys) == {"before": 6, "deleted": 0, "inserted": 6, "after": 12}
    before = dict(collection._latest()["live"])
    assert collection.upsert(rows("o/r", ["b", "d"]), keys) == {"before": 12, "deleted": 3, "inserted": 6, "after": 15}
    after = dict(collection._latest()["live"])
    assert before["p/ü #1=%"] == after["p/ü #1=%"] and before["o/r"] != after["o/r"]
    assert collection.append(rows("o/r", ["e"])) == {"before": 15, "deleted": 0, "inserted": 3, "after": 18}
    gone = spark.createDataFrame([("o/r:a",), ("none",)], "file_unique_id string")
    assert collection.delete(gone, ["file_unique_id"]) == {"before": 18, "deleted": 6, "inserted": 0, "after": 12}
    assert collection.count() == collection.read().count() == 12
    assert collection.read(["file_path"], F.col("repo_name") == "p/ü #1=%", 2).count() == 2
    assert {r["repo_name"] for r in collection.read().select("repo_name").distinct().collect()} == {"o/r", "p/ü #1=%"}
    assert collection.overwrite(rows("o/r", ["z"])) == {"before": 12, "deleted": 12, "inserted": 3, "after": 3}


def test_commits_are_atomic(spark, tmp_path):
    a, b = (store.Collection(spark, str(tmp_path / "c"), SPEC) for _ in range(2))
    a.create()
    a.create()
    make = embedding.hashing_provider(8)
    ingest.store_pages(a, chunks(spark, ["a.md"]), make, 1)
    seen = contents(b)
    # A reader between the steps of a commit sees the table before it.
    (tmp_path / "c" / "_commit-0000000003.json").write_text('{"number": 3, "li')
    assert contents(b) == seen and b.count() == 3
    with pytest.raises(store.CommitConflict):
        ingest.store_pages(a, chunks(spark, ["b.md"]), make, 1)
    assert contents(b) == seen


def test_rows_that_do_not_fit_are_told(spark, tmp_path):
    collection = store.Collection(spark, str(tmp_path / "c"), SPEC)
    rows = S.fit_to(embedding.embedded(chunks(spark, ["a", "b"]), "content_text", embedding.hashing_provider(8)), SPEC, 1)
    long = rows.withColumn("file_name", F.repeat("file_name", 300)).where("file_path = 'b'")
    with pytest.raises(RuntimeError, match=r"3 rows: file_name exceeds 256 characters \(first: o/r:b\)"):
        collection.append(rows.where("file_path = 'a'").unionByName(long))
    with pytest.raises(RuntimeError, match="vector has not 8 numbers"):
        collection.append(rows.withColumn("vector", F.slice("vector", 1, 7)))
    assert not collection.exists()


def test_lines_of_a_stage(spark, tmp_path):
    from docloom.sources import files

    rows = spark.createDataFrame([("p", "zwölf 界\n\"q\"", "f"), ("q", None, "g")], "path string, content string, file_name string")
    store.written_lines(rows, str(tmp_path / "s"))
    text = "".join(p.read_text() for p in (tmp_path / "s").glob("*.json"))
    assert "zwölf 界" in text and '"content":null' in text
    assert sorted(map(tuple, files.stage(spark, str(tmp_path / "s"), "docs").collect())) == sorted(map(tuple, rows.collect()))


def test_http_provider(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["inputs"]
            body = json.dumps([[float(len(t)), 1.0] for t in texts]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rows = embedding.embedded(chunks(spark, ["a.md"] * 5), "content_text", embedding.http_provider(f"http://127.0.0.1:{server.server_port}"), dim=2).collect()
        assert all(r["embedding"] == [float(len(r["content_text"])), 1.0] for r in rows) and len(rows) == 15
    finally:
        server.shutdown()


def test_broadcasts_are_sized(spark):
    from docloom.operators import physical

    small = spark.createDataFrame([(1, "a" * 50, ["x" * 20], [1, 2])], "i int, t string, a array<string>, n array<int>")
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(physical.sized_broadcast(small, 1)) and "broadcast" not in plan(physical.sized_broadcast(small, 0))
    assert "broadcast" not in plan(physical.sized_broadcast(small, 10, max_bytes=100))
    kept = physical.materialize(small, "t")
    assert kept.count() == 1 and physical.release(spark) >= 1 and physical.release(spark) == 0


def test_compaction_and_old_files(spark, tmp_path):
    collection = store.Collection(spark, str(tmp_path / "c"), SPEC)
    make = embedding.hashing_provider(8)
    for n in range(4):
        rows = S.fit_to(embedding.embedded(chunks(spark, [f"f{n}"]), "content_text", make), SPEC, n)
        collection.append(rows)
    seen = contents(collection)
    assert collection.compact(most=4) == 0 and collection.compact(most=3) == 1
    assert contents(collection) == seen and [len(f) for _, f in collection._latest()["live"]] == [1]
    assert collection.vacuum(keep=1) == 4 and contents(collection) == seen and collection.count() == 12
    assert collection.vacuum(keep=1) == 0 and len(collection._commits()) == 1
