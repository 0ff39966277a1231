import base64
import json

from pyspark.sql import functions as F

from docloom.sources import files


def test_trees(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "a b").mkdir(parents=True)
    (root / "a b" / "x.md").write_text("# é")
    (root / "y.html").write_text("<p>hi <b>you</b></p>")
    (root / "z.txt").write_text("no")
    (root / "Dockerfile").write_text("FROM x")
    (root / "k.YAML").write_text("kind: A")
    docs = {r["path"]: r["content"] for r in files.docs_tree(spark, str(root)).collect()}
    assert docs == {"a b/x.md": "# é", "y.html": "hi you"}
    assert {r["path"] for r in files.code_tree(spark, str(root), "o/r").collect()} == {"Dockerfile", "k.YAML", "a b/x.md"}


def test_change_lists(spark):
    assert sorted(r["path"] for r in files.changed_paths(spark, '["a.md", "b.txt", "a.md", "c.html"]').collect()) == ["a.md", "c.html"]
    assert files.changed_paths(spark, "not json").count() == 0
    commits = spark.createDataFrame([(["a.md"], ["b.md"], ["c.md", "d.md"]), ([], ["d.md"], ["x.txt"])], "added array<string>, modified array<string>, removed array<string>")
    assert {r["path"]: r["removed"] for r in files.webhook_changes(commits).collect()} == {"a.md": False, "b.md": False, "c.md": True, "d.md": False}


def test_scan_list(spark):
    found = files.scans("o/a, bad ,o/b", "x, y", spark)
    assert sorted(tuple(r) for r in found.collect()) == [("o/a", "x"), ("o/a", "y"), ("o/b", "x"), ("o/b", "y")]


def test_api_issues(spark, tmp_path):
    payload = [
        {"number": 1, "title": "t", "body": None, "state": "open", "html_url": "u", "created_at": "2024-01-02T03:04:05Z", "updated_at": "2024-01-03T00:00:00Z", "labels": [{"name": "a"}, {"name": "b"}], "comments": 2, "user": {"login": "x"}},
        {"number": 2, "title": "pr", "pull_request": {"url": "p"}, "labels": []},
    ]
    (tmp_path / "i.json").write_text("\n".join(map(json.dumps, payload)))
    raw = files.stage(spark, str(tmp_path / "i.json"), "api_issues")
    comments = spark.createDataFrame([(1, 2, None, "2024-01-05", "second"), (1, 1, "y", "2024-01-04", "first")], "issue_number long, position int, author string, created_at string, body string")
    found = files.api_issues(raw, "o/r", comments).collect()
    assert len(found) == 1
    row = found[0]
    assert (row["path"], row["file_name"], row["issue_labels"], row["created_at"], row["body"]) == ("issues/r/1", "issue-r-1.md", "a, b", "2024-01-02", "")
    assert [(c["author"], c["body"]) for c in row["comments"]] == [("y", "first"), ("unknown", "second")]


def test_contents_listing(spark):
    rows = [("file", "a.py", "p/a.py", "u", base64.b64encode(b"x = 1").decode()), ("file", "b.bin", "p/b.bin", "u", base64.b64encode(b"\xff").decode()), ("dir", "d", "d", "u", None)]
    found = files.api_contents(spark.createDataFrame(rows, "type string, name string, path string, html_url string, content string"))
    assert [(r["path"], r["content"]) for r in found.collect()] == [("p/a.py", "x = 1")]


def test_cap_counts_after_filters(spark):
    df = spark.createDataFrame([("r", i) for i in range(5)] + [("s", 9)], "repo string, n int")
    assert sorted(tuple(r) for r in files.capped_per_repo(df, "repo", [F.col("n")], 2).collect()) == [("r", 0), ("r", 1), ("s", 9)]
