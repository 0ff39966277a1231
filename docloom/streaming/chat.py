"""Chat and agent event streams: frames, tool-call fragments, turns, histories."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import types as T

from docloom.functions.text import chat_name


def frames(lines: DataFrame, stream: str, number: str, line: str) -> DataFrame:
    """``stream, frame, data``: the payload of each frame of an event stream.

    Frames end at blank lines, and at the end; the data lines of a frame are
    joined by line ends; comment lines and ``[DONE]`` are left out.
    """
    ordered = Window.partitionBy(stream).orderBy(number)
    text = F.regexp_replace(F.col(line), "\r$", "")
    grouped = lines.withColumn("_text", text).withColumn("frame", F.sum((F.col("_text") == "").cast("int")).over(ordered))
    data = grouped.where(F.col("_text").startswith("data:")).withColumn("_data", F.regexp_replace("_text", "^data: ?", ""))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(number, "_data"))), lambda x: x["_data"])
    return data.groupBy(stream, "frame").agg(F.array_join(parts, "\n").alias("data")).where("data <> '[DONE]'")


def tool_calls(deltas: DataFrame, by: list[str], position: str, name: str, fragment: str) -> DataFrame:
    """One row for each call: its last name that is not empty, its fragments joined."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(position, F.coalesce(F.col(fragment), F.lit("")).alias("f")))), lambda x: x["f"])
    named = F.max_by(F.nullif(F.col(name), F.lit("")), F.when(F.coalesce(F.col(name), F.lit("")) != "", F.col(position)))
    return deltas.groupBy(*by).agg(named.alias("name"), F.array_join(parts, "").alias("arguments"), F.count("*").alias("n_fragments"))


class _Fold(StatefulProcessor):
    """Joins fragments of each call until its last one came."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())])
        self.call = handle.getValueState("call", schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        name, arguments = self.call.get() if self.call.exists() else ("", "")
        done = False
        for batch in rows:
            for row in batch.sort_values("position").itertuples():
                name, arguments = row.name or name, arguments + (row.fragment or "")
                done = done or bool(row.finished)
        if done:
            self.call.clear()
            yield pd.DataFrame({"stream_id": [key[0]], "call_index": [key[1]], "name": [name], "arguments": [arguments]})
        else:
            self.call.update((name, arguments))

    def close(self) -> None:
        pass


def folded_calls(deltas: DataFrame) -> DataFrame:
    """Streaming form of ``tool_calls``: a row when a call's last fragment came.

    ``deltas`` have ``stream_id, call_index, position, name, fragment, finished``.
    The state lives in the session's state store provider.
    """
    out = "stream_id string, call_index int, name string, arguments string"
    return deltas.groupBy("stream_id", "call_index").transformWithStateInPandas(_Fold(), outputStructType=out, outputMode="Append", timeMode="None")


def turn_ends(events: DataFrame, turn: list[str], seq: str, kind: str) -> DataFrame:
    """Where each turn ends: at its last ``done``, since nested turns end first."""
    return events.where(F.col(kind) == "done").groupBy(*turn).agg(F.max(seq).alias("last_done"))


def assembled(parts: DataFrame, by: list[str], seq: str, text: str, partial: Column, final: Column) -> DataFrame:
    """The text of each answer: its last final part, else its partial parts joined."""
    shown = F.transform(F.array_sort(F.collect_list(F.when(partial, F.struct(seq, F.col(text).alias("t"))))), lambda x: x["t"])
    return parts.groupBy(*by).agg(F.coalesce(F.max_by(F.col(text), F.when(final & (F.coalesce(F.col(text), F.lit("")) != ""), F.col(seq))), F.array_join(shown, "")).alias("answer"))


def transcripts(turns: DataFrame, chat: list[str], turn: str, role: str, content: str) -> DataFrame:
    """One text for each chat: its turns in order, with roles."""
    line = F.concat(F.initcap(role), F.lit(": "), F.coalesce(F.col(content), F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(turn, line.alias("l")))), lambda x: x["l"])
    return turns.groupBy(*chat).agg(F.array_join(ordered, "\n\n").alias("transcript"), F.count("*").alias("n_turns"))


def chat_names(turns: DataFrame, chat: list[str], turn: str, role: str, content: str) -> DataFrame:
    """The first words of each chat's first message by a user."""
    first = F.min_by(F.when(F.col(role) == "user", F.col(content)), F.when(F.col(role) == "user", F.col(turn)))
    return turns.groupBy(*chat).agg(chat_name(first).alias("name"))


def ordered_citations(hits: DataFrame, by: list[str], rank: str, url: str) -> DataFrame:
    """Distinct addresses in order of first appearance."""
    urls = F.transform(F.array_sort(F.collect_list(F.struct(rank, url))), lambda x: x[url])
    return hits.where(F.coalesce(F.col(url), F.lit("")) != "").groupBy(*by).agg(F.array_distinct(urls).alias("citations"))


#: What a streamed completion sends in one frame.
DELTA = (
    "choices array<struct<index:int,finish_reason:string,delta:struct<content:string,"
    "tool_calls:array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>>>>"
)


def deltas(framed: DataFrame, stream: str, frame: str, data: str) -> DataFrame:
    """Pieces of streamed completions: one row for each text or tool-call piece.

    ``stream, position, content, call_index, name, fragment, finished``; frames
    that are not JSON are left out.
    """
    parsed = framed.withColumn("_d", F.from_json(data, DELTA)).where("_d.choices is not null")
    choice = parsed.select(stream, F.col(frame).alias("position"), F.explode("_d.choices").alias("c"))
    finished = F.col("c.finish_reason").isNotNull()
    texts = choice.where("c.delta.content is not null or c.delta.tool_calls is null").select(
        stream, "position", F.col("c.delta.content").alias("content"), F.lit(None).cast("int").alias("call_index"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("fragment"), finished.alias("finished"),
    )
    calls = choice.where("c.delta.tool_calls is not null").select(stream, "position", finished.alias("finished"), F.explode("c.delta.tool_calls").alias("t"))
    return texts.unionByName(
        calls.select(
            stream, "position", F.lit(None).cast("string").alias("content"), F.col("t.index").alias("call_index"), F.col("t.function.name").alias("name"),
            F.col("t.function.arguments").alias("fragment"), "finished",
        )
    )


def json_leaves(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``keys, path, value``: the leaves of JSON texts, however deep.

    Texts are walked where they lie, in Arrow batches; texts that are not JSON have
    no leaves, and neither have texts nested so deep (thousands of levels) that the
    parser refuses them.  Of repeated names in one object the last counts; numbers
    stay as they are written.
    """
    import json

    taken = df.select(*keys, F.col(column).alias("_json"))
    schema = T.StructType([*taken.schema.fields[:-1], T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])

    def leaves(text: str | None) -> Iterator[tuple[str, str | None]]:
        try:
            todo = [("$", json.loads(text, parse_float=str, parse_int=str, parse_constant=str))] if text else []
        except (ValueError, RecursionError):
            return
        while todo:
            path, value = todo.pop()
            if isinstance(value, dict):
                todo += [(f"{path}.{k}", v) for k, v in reversed(value.items())]
            elif isinstance(value, list):
                todo += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(value)))]
            else:
                yield path, value if isinstance(value, str) else None if value is None else json.dumps(value)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows, paths, values = [], [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for path, value in leaves(text):
                    rows.append(i), paths.append(path), values.append(value)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns[:-1]), pa.array(paths, pa.string()), pa.array(values, pa.string())], names=schema.names)

    return taken.mapInArrow(batches, schema)


#: Fields that name a tool.
TOOL_FIELDS = ("name", "toolName", "tool_name")


def tools_called(leaves: DataFrame, keys: list[str], tool: str) -> DataFrame:
    """Keys of the events in which some leaf that names a tool is the tool (or ends in it)."""
    field = F.element_at(F.split("path", r"\."), -1)
    named = leaves.where(field.isin(*TOOL_FIELDS) & ((F.col("value") == tool) | F.col("value").endswith(f".{tool}") | F.col("value").endswith(f"/{tool}")))
    return named.select(*keys).distinct()
