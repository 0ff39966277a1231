"""Filling containers of fixed capacity with items of varying length.

The plan is made over the histogram of lengths, not over the items: at most
``capacity`` different lengths exist, whatever the number of items.  Best fit in
falling length order over these counts gives *slots*, runs of equal containers
with room for equal items.  Then each item gets its rank among the items of its
length, and takes the slot of that rank.

What reaches the driver or is broadcast is bounded by the capacities: a row for
each length of each, and one for each ``ITEMS_PER_PART`` items.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.physical import materialize, sized_broadcast

#: A length that more items share is ranked in several parts of about so many, so
#: that a length of a third of all items is not ranked in one task.
ITEMS_PER_PART = 1_000_000
BROADCAST_ROWS = 200_000


def plan_slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first container, items in each container) by best fit.

    A slot of length L holds the items of ranks from its first rank up to the
    next slot's; item r lies in container ``first + (r - first rank) // each``.
    The number of slots depends on the capacity, not on the number of items.
    """
    room: dict[int, list[list[int]]] = {}  # room left -> [first container, containers]
    sizes: list[int] = []  # its keys, sorted
    slots, opened = [], 0

    def keep(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                bisect.insort(sizes, left)
            room[left].append([first, n])

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                size = sizes[at]
                first, n = room[size].pop()
                if not room[size]:
                    del room[size], sizes[at]
            else:
                size, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = size // length
            used = min(n, -(-left // each))
            keep(size, first + used, n - used)
            slots.append((length, rank, first, each))
            full, rest = divmod(min(left, used * each), each)
            keep(size - each * length, first, full)
            if rest:
                keep(size - rest * length, first + full, 1)
            rank += full * each + rest
            left -= full * each + rest
    return slots


class Plan:
    """The slots of one capacity as arrays that find the container of each rank."""

    def __init__(self, capacity: int, counts: dict[int, int]):
        self.capacity, self.scale = capacity, max(counts.values(), default=0) + 1
        slots = sorted(plan_slots(counts, capacity))
        self.starts = np.array([length * self.scale + rank for length, rank, _, _ in slots], np.int64)
        self.ranks, self.firsts, self.each = (np.array([s[i] for s in slots], np.int64) for i in (1, 2, 3))

    def containers(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.starts, length * self.scale + rank, "right") - 1
        return self.firsts[at] + (rank - self.ranks[at]) // self.each[at]


def packed(items: DataFrame, key: str, size: str, capacities: list[int], items_per_part: int) -> DataFrame:
    """Containers of all items for each capacity, with the key as ``key``.

    An item above the capacity is split into full parts and a rest (``part_no``
    from 0, ``start`` its offset); no other item is split.  Items of size 0 or
    NULL take no room and get container 0; negative sizes count as 0.  Repeated
    rows are items of their own.  ``container_id`` counts from 0 without gaps
    (an input of empty items only has container 0).  Extra columns are not read.

    Items that fit the smallest capacity are ranked once for all capacities; parts
    and larger items of a capacity take the ranks after them.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("each capacity must be at least 1")
    capacities, zero = sorted(set(capacities)), F.lit(0).cast("long")
    whole = F.greatest(F.coalesce(F.col(size).cast("long"), zero), zero)
    rows = items.select(F.col(key).alias("key"), whole.alias("n"))
    small = rows.where(F.col("n").between(1, capacities[0])).select(F.lit(0).cast("long").alias("capacity"), "key", zero.alias("part_no"), F.col("n").alias("length"))
    each_capacity = F.explode(F.array(*[F.lit(c).cast("long") for c in capacities])).alias("capacity")
    large = (
        rows.where(F.col("n") > capacities[0]).select(each_capacity, "key", "n")
        .select("capacity", "key", "n", F.explode(F.sequence(zero, F.expr("(n - 1) div capacity"))).alias("part_no"))
        .select("capacity", "key", "part_no", F.least(F.col("n") - F.col("part_no") * F.col("capacity"), F.col("capacity")).alias("length"))
    )
    parts = small.unionByName(large)
    counted = materialize(parts.groupBy("capacity", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {(r["capacity"], r["length"]): r["n"] for r in counted.collect()}  # bounded by the capacities
    plans = [Plan(capacity, {n: histogram.get((0, n), 0) + histogram.get((capacity, n), 0) for c, n in histogram if c in (0, capacity)}) for capacity in capacities]

    spark = items.sparkSession
    split = [(c, n, -(-count // items_per_part), histogram.get((0, n), 0) if c else 0) for (c, n), count in histogram.items()]
    pieces = F.broadcast(spark.createDataFrame(split, "capacity long, length long, pieces long, after long"))  # as many rows as the histogram
    placed = parts.join(pieces, ["capacity", "length"]).withColumn("piece", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("key", "part_no"), F.col("pieces"))).otherwise(0))
    group = ["capacity", "length", "piece"]
    if any(n > 1 for _, _, n, _ in split):
        before = Window.partitionBy("capacity", "length").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        sizes = materialize(placed.where("pieces > 1").groupBy(*group).agg(F.count("*").alias("n")), "pieces")
        offsets = sized_broadcast(materialize(sizes.select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "offsets"), BROADCAST_ROWS)
        placed = placed.join(offsets, group, "left").withColumn("after", F.col("after") + F.coalesce("before", F.lit(0)))
    within = Window.partitionBy(*group).orderBy("key", "part_no")
    ranked = placed.select(*group, "key", "part_no", "after", F.row_number().over(within).alias("r")).withColumn("rank", F.col("after") + F.col("r") - 1)
    of = F.when(F.col("capacity") == 0, F.array(*[F.lit(c).cast("long") for c in capacities])).otherwise(F.array("capacity"))
    asked = ranked.select(F.explode(of).alias("capacity"), "key", "part_no", "length", "rank")

    @F.pandas_udf("long")
    def container(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for capacity, length, rank in batches:
            of, out = capacity.to_numpy(), np.zeros(len(length), np.int64)
            for plan in plans:
                some = of == plan.capacity
                if some.any():
                    out[some] = plan.containers(length.to_numpy()[some], rank.to_numpy()[some])
            yield pd.Series(out)

    start = (F.col("part_no") * F.col("capacity")).alias("start")
    full = asked.select("capacity", "key", "part_no", start, "length", container("capacity", "length", "rank").alias("container_id"))
    empty = rows.where("n = 0").select(each_capacity, "key", zero.alias("part_no"), zero.alias("start"), zero.alias("length"), zero.alias("container_id"))
    return full.unionByName(empty)


def pack_all(items: DataFrame, key: str, size: str, capacities: list[int], items_per_part: int = ITEMS_PER_PART) -> DataFrame:
    """``packed`` as ``capacity, key, part_no, start, length, container_id``."""
    return packed(items, key, size, capacities, items_per_part).withColumnRenamed("key", key)


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``packed`` for one capacity: ``key, part_no, start, length, container_id``."""
    return packed(items, key, size, [capacity], ITEMS_PER_PART).drop("capacity").withColumnRenamed("key", key)
