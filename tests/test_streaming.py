import datetime as dt

from pyspark.sql import functions as F

from docloom.streaming import chat, sessions


def test_frames(spark):
    text = [": hi", "event: m", "data: a", "data: b", "", "data: [DONE]", "", "data: last"]
    lines = spark.createDataFrame([("s", i, line) for i, line in enumerate(text)], "s string, n int, line string")
    assert [r["data"] for r in chat.frames(lines, "s", "n", "line").orderBy("frame").collect()] == ["a\nb", "last"]


def test_tool_calls_batch_and_stream(spark, tmp_path):
    rows = [("s", 0, 1, "search", '{"q', False), ("s", 0, 2, "", '": 1}', True), ("s", 1, 3, "other", "{}", True), ("t", 0, 1, "open", "x", False)]
    schema = "stream_id string, call_index int, position long, name string, fragment string, finished boolean"
    batch = spark.createDataFrame(rows, schema)
    found = {(r["stream_id"], r["call_index"]): (r["name"], r["arguments"]) for r in chat.tool_calls(batch, ["stream_id", "call_index"], "position", "name", "fragment").collect()}
    assert found[("s", 0)] == ("search", '{"q": 1}')
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    folded = sessions.drained(chat.folded_calls(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    streamed = {(r["stream_id"], r["call_index"]): (r["name"], r["arguments"]) for r in folded.collect()}
    assert streamed == {k: v for k, v in found.items() if k[0] == "s"}


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    done = sessions.drained(sessions.windowed_stream(stream, "ts", ["event_type"]), str(tmp_path / "o"), str(tmp_path / "s"), "update", ["start", "event_type"])
    batch = sessions.windowed_stream(events, "ts", ["event_type"])
    pick = lambda d: sorted((r["start"], r["event_type"], r["n"], round(r["total"], 4)) for r in d.collect())
    assert pick(done) == pick(batch)


def test_sessions_end_absolutely(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(0, 0, "login"), (1, 1000, "x"), (2, 1750, "x"), (3, 1799, "x"), (4, 1800, "x"), (5, -5, "x")]
    df = spark.createDataFrame([(i, t0 + dt.timedelta(seconds=s), "u", k) for i, s, k in rows], "id int, ts timestamp, user string, kind string")
    found = {r["id"]: (r["valid"], r["refresh"]) for r in sessions.minted(df, "ts", "user", F.col("kind") == "login").collect()}
    assert found == {0: (True, False), 1: (True, False), 2: (True, True), 3: (True, True), 4: (False, False), 5: (False, False)}


def test_accepted_requests(spark):
    rows = [(i, dt.datetime(2024, 1, 1, 0, 0, i), "u") for i in range(12)] + [(50, dt.datetime(2024, 1, 1, 0, 1), "u")]
    df = spark.createDataFrame(rows, "id int, ts timestamp, user string")
    assert sessions.accepted_requests(df, "ts", "id", "user").count() == 11
    assert sorted((r["requests"], r["accepted"]) for r in sessions.client_limit(df, "ts", "user").collect()) == [(1, 1), (12, 10)]


def test_answers_and_turns(spark):
    rows = [("c", 1, "par", True, False), ("c", 2, "tial", True, False), ("c", 3, "whole", False, True), ("d", 1, "only", True, False)]
    df = spark.createDataFrame(rows, "c string, seq int, text string, partial boolean, final boolean")
    found = {r["c"]: r["answer"] for r in chat.assembled(df, ["c"], "seq", "text", F.col("partial"), F.col("final")).collect()}
    assert found == {"c": "whole", "d": "only"}
    events = spark.createDataFrame([("t", 1, "done"), ("t", 4, "done"), ("t", 2, "citations")], "turn string, seq int, type string")
    assert chat.turn_ends(events, ["turn"], "seq", "type").first()["last_done"] == 4
    dup = spark.createDataFrame([(1, "e1", dt.datetime(2024, 1, 1)), (2, "e1", dt.datetime(2024, 1, 1))], "n int, k string, ts timestamp")
    assert sessions.deduplicated_stream(dup, "ts", ["k"]).isStreaming is False


def test_citations_keep_their_order(spark):
    rows = [("s", 3, "b"), ("s", 1, "b"), ("s", 2, "a"), ("s", 4, ""), ("s", 5, None)]
    df = spark.createDataFrame(rows, "s string, rank int, url string")
    assert chat.ordered_citations(df, ["s"], "rank", "url").first()["citations"] == ["b", "a"]


def test_deltas_to_calls(spark):
    data = [
        '{"choices": [{"index": 0, "delta": {"content": "Hel"}}]}', '{"choices": [{"index": 0, "delta": {"content": "lo"}}]}', "not json",
        '{"choices": [{"index": 0, "delta": {"tool_calls": [{"index": 0, "function": {"name": "search", "arguments": "{\\"q"}}]}}]}',
        '{"choices": [{"index": 0, "finish_reason": "tool_calls", "delta": {"tool_calls": [{"index": 0, "function": {"arguments": "\\": 1}"}}]}}]}',
    ]
    framed = spark.createDataFrame([("s", i, d) for i, d in enumerate(data)], "s string, frame int, data string")
    pieces = chat.deltas(framed, "s", "frame", "data")
    calls = chat.tool_calls(pieces.where("call_index is not null"), ["s", "call_index"], "position", "name", "fragment").collect()
    assert [(r["name"], r["arguments"]) for r in calls] == [("search", '{"q": 1}')]
    texts = pieces.where("content is not null").orderBy("position").collect()
    assert "".join(r["content"] for r in texts) == "Hello"
    assert pieces.where("finished").count() == 1


def test_json_leaves(spark):
    rows = [(1, '{"a": {"name": "kb.search_docs", "args": [1, "x"]}, "b": null}'), (2, "broken {"), (3, None), (4, '"top"')]
    leaves = chat.json_leaves(spark.createDataFrame(rows, "id int, j string"), ["id"], "j")
    found = sorted((r["id"], r["path"], r["value"]) for r in leaves.where("value is not null").collect())
    assert found == [(1, "$.a.args[0]", "1"), (1, "$.a.args[1]", "x"), (1, "$.a.name", "kb.search_docs"), (4, "$", "top")]
    assert [r["id"] for r in chat.tools_called(leaves, ["id"], "search_docs").collect()] == [1]
    deep = spark.createDataFrame([(1, '{"a":' * 60 + '[1.50, true, {"toolName": "t"}]' + "}" * 60)], "id int, j string")
    found = sorted((r["path"].count(".a"), r["path"][-9:], r["value"]) for r in chat.json_leaves(deep, ["id"], "j").collect())
    assert found == [(60, ".a.a.a[0]", "1.50"), (60, ".a.a.a[1]", "true"), (60, ".toolName", "t")]
    assert chat.tools_called(chat.json_leaves(deep, ["id"], "j"), ["id"], "t").count() == 1
