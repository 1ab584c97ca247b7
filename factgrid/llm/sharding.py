"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has points (virtual nodes) on a ring of 2^60 places; a key belongs to the arc that ends at the next point
clockwise, and so to that point's shard. Each shard has a capacity. Round by round, keys that have no shard yet ask the next
different shard clockwise; a shard takes them in the order of their arcs around the ring, within an arc by place, until it is
full. So a key leaves its own shard only where that is full, and no shard goes over its capacity.

All keys of an arc ask the same shards in the same order. So the rounds need the number of keys of each arc only, which is
bounded by shards x points whatever the data; each key then needs its rank in its arc, which comes from counts of narrow
ranges of the ring and a window within each range.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

RING_BITS = 60
#: Most points of a ring: the plan is a table of at most points x shards rows on the driver.
MOST_POINTS = 1 << 14
#: Rows that a window over a narrow range of the ring gets, about; equal keys above EXPANDED are expanded in blocks.
RANGE_ROWS, EXPANDED = 2000, 1000


@dataclass(frozen=True)
class Ring:
    """points: places in ascending order; owners: the shard of each; orders: for each arc the shards clockwise from its end."""

    points: list[int]
    owners: list[int]
    orders: list[list[int]]


def place_of(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def ring(shards: int, virtual_nodes: int) -> Ring:
    if shards < 1 or virtual_nodes < 1 or shards * virtual_nodes > MOST_POINTS:
        raise ValueError(f"shards and virtual nodes must be at least 1, and their product at most {MOST_POINTS}")
    marks = sorted((place_of(f"shard-{s}-node-{v}"), s) for s in range(shards) for v in range(virtual_nodes))
    owners = [s for _, s in marks]
    orders: list[list[int]] = []
    order = list(dict.fromkeys(owners))
    for owner in reversed(owners):  # an arc further back asks its own point's shard first, then as the arc after it
        order = [owner, *(s for s in order if s != owner)]
        orders.append(order)
    return Ring([p for p, _ in marks], owners, orders[::-1])


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Without slack the rows are shared out evenly, the first shards taking one more; else (1 + slack) times the mean, rounded up."""
    if slack < 0:
        raise ValueError("slack is negative")
    if slack:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def plan(ring_: Ring, counts: dict[int, int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): which ranks of each arc go where."""
    at = {arc: 0 for arc in counts}
    used = [0] * len(capacity)
    out = []
    for turn in range(len(capacity)):
        for arc in sorted(counts):
            left = counts[arc] - at[arc]
            shard = ring_.orders[arc][turn]
            take = min(left, capacity[shard] - used[shard])
            if take > 0:
                out.append((arc, at[arc], at[arc] + take, shard, used[shard]))
                at[arc] += take
                used[shard] += take
    return out


def place_column(key: Column) -> Column:
    """The place of a key on the ring: the first 60 bits of its md5."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def constants(values: list[int], kind: str) -> Column:
    """An array that the plan holds as one constant, not as one expression a value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def passed(circle: Ring, place: Column) -> Column:
    """How many points lie before a place: looked up by its first bits, then among the few points of that cell."""
    bits = max(1, len(circle.points).bit_length())
    before = [bisect.bisect_left(circle.points, c << (RING_BITS - bits)) for c in range((1 << bits) + 1)]
    table, points = constants(before, "int"), constants(circle.points, "long")
    cell = F.shiftright(place, RING_BITS - bits).cast("int")
    first, end = table[cell], table[cell + 1]
    return first + F.size(F.filter(F.slice(points, first + 1, end - first), lambda p: p < place))


def assign_shards(docs: DataFrame, shards: int = 8, virtual_nodes: int = 64, slack: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: the key (named as in docs), size, text_crc32, arc, home (the shard of its arc), shard, slot.

    size is the text's UTF-8 bytes plus 1, text_crc32 the unsigned crc32 of its UTF-8 bytes; a null text counts as an empty
    one, a null key as the key 'null'. slot counts the rows of each shard from 0 without gaps. Rows with equal keys are
    ordered by size and crc32; rows equal in all three share the slots that follow one another. An empty table gives an
    empty result. Other columns are not read: join on the key to move whole rows.
    """
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(content).cast("long") + 1).alias("size"), F.crc32(content).alias("crc"))
    same = rows.groupBy("key", "size", "crc").agg(F.count(F.lit(1)).alias("n"))  # partial sums first: a hot key is one row a task
    circle = ring(shards, virtual_nodes)
    spark = docs.sparkSession
    same = same.withColumn("place", place_column(F.coalesce(F.col("key").cast("string"), F.lit("null")))).withColumn("passed", passed(circle, F.col("place")))
    same = stored(same, "places")  # texts are read once
    total = same.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # a range is a power of two of places, so about RANGE_ROWS rows of distinct keys, however many there are
    bits = max(0, math.ceil(math.log2(max(1, total / RANGE_ROWS))))
    # places after the last point belong to the first arc, and come before all others of it
    last = F.col("passed") == len(circle.points)
    placed = same.withColumns({"arc": F.when(last, 0).otherwise(F.col("passed")), "range": F.shiftright("place", RING_BITS - bits) + F.when(last, F.lit(0)).otherwise(F.lit(1 << bits))}).drop("passed")
    ranges = placed.groupBy("arc", "range").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("arc").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = ranges.select("arc", "range", before.alias("base"))
    counts = {r["arc"]: r["n"] for r in ranges.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # one row a point
    pieces = plan(circle, counts, capacities(total, shards, slack))
    within = Window.partitionBy("arc", "range").orderBy("place", F.col("key").asc_nulls_first(), "size", "crc")
    inside = F.coalesce(F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = placed.withColumn("inside", inside).join(bases, ["arc", "range"]).withColumn("rank", F.col("base") + F.col("inside"))
    # equal rows have ranks that follow one another; many of them are dealt out in blocks before they become rows
    few, many = first.where(F.col("n") <= EXPANDED), first.where(F.col("n") > EXPANDED)
    few = few.select("key", "size", "crc", "arc", F.explode(F.sequence(F.col("rank"), F.col("rank") + F.col("n") - 1)).alias("rank"))
    blocks = many.select("key", "size", "crc", "arc", F.explode(F.sequence(F.col("rank"), F.col("rank") + F.col("n") - 1, F.lit(EXPANDED))).alias("from"), (F.col("rank") + F.col("n") - 1).alias("last")).repartition("from")
    blocks = blocks.select("key", "size", "crc", "arc", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + EXPANDED - 1, F.col("last")))).alias("rank"))
    table = spark.createDataFrame(pieces, "arc int, first long, end long, shard int, slot long").groupBy("arc").agg(F.collect_list(F.struct("first", "end", "shard", "slot")).alias("pieces"))
    found = few.unionByName(blocks).join(F.broadcast(table), "arc")  # at most points x shards pieces
    piece = F.filter("pieces", lambda p: (p["first"] <= F.col("rank")) & (F.col("rank") < p["end"]))[0]
    owners = constants(circle.owners, "int")
    return found.withColumn("piece", piece).select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "arc", owners[F.col("arc")].alias("home"), F.col("piece.shard").alias("shard"), (F.col("piece.slot") + F.col("rank") - F.col("piece.first")).alias("slot")
    )
