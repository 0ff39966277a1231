"""Helpers for physical decisions that the optimizer cannot take alone.

``materialize`` cuts lineage with a Parquet table in the folder that all
executors share, and ``sized_broadcast`` broadcasts only what was measured.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a missing setting is an error, since a folder of one machine would
    not survive the loss of that machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    base = tempfile.mkdtemp(prefix="docloom-")
    spark.sparkContext.setCheckpointDir(base)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Unlike a cached or locally checkpointed DataFrame the table survives the
    loss of executors, and its size is known to the planner.  It stays until
    ``release`` is called, as results that are read later may need it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of the tables that this process materialized.
_TABLES: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete the tables that this process materialized; returns how many.

    Results that still read from them can no longer be computed.
    """
    jvm, gone = spark._jvm, len(_TABLES)
    for text in _TABLES:
        path = jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _TABLES.clear()
    return gone


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan, in enough partitions for its cores before costly Python work.

    A table of one small file would keep one core busy.  Scans that already have
    half as many partitions as there are cores stay as they are, so that nothing
    large is ever shuffled for this.  Only for scans: counting the partitions of a
    join would run its stages.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


#: A broadcast table has at most so many bytes, as estimated from its rows.
BROADCAST_BYTES = 64 << 20


def row_bytes(schema: T.StructType) -> Column:
    """About how many bytes a row takes in memory."""
    out = F.lit(16).cast("long")
    for field in schema:
        kind, c = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            out = out + 16 + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(kind, T.ArrayType):
            each = F.transform(c, lambda x: F.octet_length(x).cast("long") + 16) if isinstance(kind.elementType, (T.StringType, T.BinaryType)) else F.transform(c, lambda x: F.lit(16).cast("long"))
            out = out + 24 + F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0).cast("long"))), F.lit(0))
        else:
            out = out + 8
    return out


def sized_broadcast(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` if it has at most ``max_rows`` rows and about ``max_bytes`` bytes, else ``df``.

    ``df`` should be materialized, as it is read once for this.  Beyond the bounds
    the planner is free to shuffle both sides.
    """
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(row_bytes(df.schema)), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df
