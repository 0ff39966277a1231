"""Sessions and request limits over event tables, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.store import latest

#: Session lifetime and refresh margin in seconds, requests a minute.
SESSION_SECONDS, REFRESH_SECONDS, GLOBAL_LIMIT, CLIENT_LIMIT = 1800, 60, 60, 10


def minute(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def global_limit(events: DataFrame, ts: str, key: str, limit: int = GLOBAL_LIMIT) -> DataFrame:
    """Requests of each minute, and how many the common budget accepts.

    The minute is counted from partial sums; no window over all events is sorted.
    """
    counted = events.groupBy(minute(F.col(ts)).alias("minute")).agg(F.count(key).alias("requests"))
    return counted.withColumn("accepted", F.least("requests", F.lit(limit))).withColumn("rejected", F.col("requests") - F.col("accepted"))


def client_limit(events: DataFrame, ts: str, client: str, limit: int = CLIENT_LIMIT) -> DataFrame:
    counted = events.groupBy(minute(F.col(ts)).alias("minute"), client).agg(F.count("*").alias("requests"))
    return counted.withColumn("accepted", F.least("requests", F.lit(limit)))


def accepted_requests(events: DataFrame, ts: str, key: str, client: str, limit: int = CLIENT_LIMIT) -> DataFrame:
    """The requests that fit into each client's minute, in order of time."""
    window = Window.partitionBy(client, minute(F.col(ts))).orderBy(ts, key)
    return events.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= limit).drop("_n")


def minted(events: DataFrame, ts: str, client: str, login: Column) -> DataFrame:
    """Each event with the latest login of its client before it, and whether it holds.

    A session ends a fixed time after its login, however active it is; clients
    refresh it a margin before.  Events before any login have no session.
    """
    window = Window.partitionBy(client).orderBy(ts).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    mint = F.last(F.when(login, F.col(ts)), ignorenulls=True).over(window)
    age = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("minted_at").cast("timestamp"))
    out = events.withColumn("minted_at", mint).withColumn("age_us", age)
    out = out.withColumn("valid", F.coalesce(F.col("age_us") < SESSION_SECONDS * 1_000_000, F.lit(False)))
    return out.withColumn("refresh", F.col("valid") & (F.col("age_us") >= (SESSION_SECONDS - REFRESH_SECONDS) * 1_000_000))


def windowed_stream(events: DataFrame, ts: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window; works on streams and on tables.

    ``ts`` without time zone is read as UTC, since watermarks need a time stamp.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    grouped = timed.groupBy(F.window(ts, width).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def deduplicated_stream(events: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there into a Parquet table, and read that.

    With mode ``update`` each batch writes the rows that it changed beside the others,
    under its number, and the latest row of each of ``keys`` counts; a batch that is
    repeated after a failure replaces its own rows.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "update":

        def write(rows: DataFrame, number: int) -> None:
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

        writer.foreachBatch(write).start().awaitTermination()
        schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
        return latest(spark.read.schema(schema).parquet(path), keys or [], [F.col("batch")]).drop("batch")
    writer.format("parquet").option("path", path).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
