"""Joins of ranges with the ranges around them, without a key or within keys.

An outer range lies in the one or two cells of a grid whose width is the next power of two above its length; an inner range is
looked up at its start, once for each width that occurs. So only ranges of like length and place meet, however many there are of
one key. Cells with many inner ranges are dealt to several tasks, with the few outer ranges copied to each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that are dealt to several tasks, at most; beyond that, more rows stay together.
MOST_HOT = 1 << 16


def _width(start: Column, end: Column) -> Column:
    """Bits of the length: 2 to this power is above it."""
    return F.length(F.bin((end - start).cast("long")))


def contained(inner: DataFrame, outer: DataFrame, by: list[str] | None = None, start: str = "start", end: str = "end", outer_start: str = "outer_start", outer_end: str = "outer_end", task_rows: int = 500_000) -> DataFrame:
    """All pairs of a range and one around it (start >= outer_start, end <= outer_end) of the same `by`: the columns of both.

    Bounds are whole numbers, of any sign; for times take unix_micros. Rows with a null bound or key, and ranges that end before
    they start, have no partner. Repeated rows give repeated pairs (equal inner rows stay in one task). Columns other than `by` must have names of their own.
    """
    by = by or []
    outer = outer.where(F.col(outer_end) >= F.col(outer_start)).withColumn("__width", _width(F.col(outer_start), F.col(outer_end)))
    cell = lambda at: F.expr(f"shiftright(cast({at} as bigint), __width)")
    outer = outer.withColumn("__cell", F.explode(F.array_distinct(F.array(cell(f"`{outer_start}`"), cell(f"`{outer_end}`")))))
    widths = sorted(r[0] for r in outer.select("__width").distinct().collect())  # at most 64
    if not widths:
        widths = [0]
    inner = inner.where(F.col(end) >= F.col(start)).withColumn("__width", F.explode(F.array(*map(F.lit, widths)))).withColumn("__cell", cell(f"`{start}`"))
    key = [*by, "__width", "__cell"]
    counts = inner.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    total, most = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.max("__n"), F.lit(0))).first()
    limit = max(task_rows, total // MOST_HOT)
    if most > limit:
        own = [F.col(f"`{f.name}`") for f in inner.schema.fields if "map<" not in f.dataType.simpleString()]
        hot = F.broadcast(counts.where(F.col("__n") > limit).select(*key, F.ceil(F.col("__n") / limit).cast("int").alias("__parts")))  # at most total / limit
        inner = inner.join(hot, key, "left").withColumn("__part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*own), F.col("__parts")).cast("int"))).drop("__parts")
        outer = outer.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
        key = [*key, "__part"]
    pairs = inner.join(outer, key).where((F.col(start) >= F.col(outer_start)) & (F.col(end) <= F.col(outer_end)))
    return pairs.drop("__width", "__cell", "__part")
