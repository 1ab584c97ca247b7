"""As-of join: each row with the last row of the other side at or before its place.

Both sides are united and ordered by place, and the last value that isn't null runs along. A key with many rows is split into
blocks of places, so no key is one task: the blocks' bounds are percentiles of the key's places, and each block starts with a row
that holds the last value of the blocks before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of all split keys together at most; beyond that, blocks hold more rows. Their bounds are sent to all tasks (8 bytes each).
MOST_BLOCKS = 1 << 16
#: Bounds are searched in steps of so many first.
STEP = 32


def _block(at: Column, bounds: Column) -> Column:
    """How many of the ascending bounds are below the place; 0 where there are none."""
    coarse = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.size(bounds) / STEP).cast("int"))), lambda i: F.get(bounds, (i - 1) * STEP)), lambda b: b < at))
    begin = F.greatest(coarse - 1, F.lit(0)) * STEP
    return F.when(bounds.isNull() | at.isNull(), F.lit(0)).otherwise(begin + F.size(F.filter(F.slice(bounds, begin + 1, F.lit(STEP)), lambda b: b < at)))


def _split_keys(rows: DataFrame, keys: list[str], block_rows: int) -> DataFrame | None:
    """(keys, __bounds) of the keys with more rows than a block; None if there are none."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total, most = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.max("__n"), F.lit(0))).first()
    limit = max(block_rows, 2 * total // MOST_BLOCKS)
    if most <= limit:
        return None
    parts = math.ceil(most / limit)
    heavy = counts.where(F.col("__n") > limit).select(*[F.col(k).alias(f"{k}h") for k in keys], "__n")  # at most total / limit rows
    same = [F.col(k).eqNullSafe(F.col(f"{k}h")) for k in keys]
    within = rows.join(F.broadcast(heavy), same).where("__at is not null")
    bounds = within.groupBy(*keys).agg(F.first("__n").alias("__n"), F.percentile_approx("__at", [i / parts for i in range(1, parts)], max(10_000, 10 * parts)).alias("__b"))
    step = F.floor(F.lit(parts) / F.ceil(F.col("__n") / limit)).cast("int")  # smaller keys take every step-th bound
    return bounds.select(*keys, F.array_distinct(F.filter("__b", lambda _, i: (i + 1) % step == 0)).alias("__bounds")).where(F.size("__bounds") > 0)


def asof_join(left: DataFrame, right: DataFrame, at: str, right_at: str, values: list[str], by: list[str] | None = None, tie: list[str] | None = None, strict: bool = False, block_rows: int | None = 1_000_000) -> DataFrame:
    """left with the columns `values` of the last row of right with the same `by` and right_at <= at (strict: < at); null where
    there is none. Of rows of right at one place, the last by `tie` counts.

    Places are numbers, dates or times. Rows of left with a null key or place get nulls, those of right are ignored; repeated rows
    of left stay. Without `by`, all rows are one key. block_rows None says that no
    key needs to be split (as where a key is one text), and saves a pass that counts. Values' names must not be among left's columns. Either side may be empty.
    """
    by, tie = by or [], tie or []
    keys = [f"__k{i}" for i in range(len(by))] or ["__k0"]
    side = lambda df: [F.col(c).alias(k) for k, c in zip(keys, by, strict=True)] if by else [F.lit(0).alias("__k0")]
    kept = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    value, ties = F.struct(*values), F.struct(F.lit(0), *tie)
    have = right.where(F.col(right_at).isNotNull()).dropna(subset=by or None, how="any") if by else right.where(F.col(right_at).isNotNull())
    have = have.select(*side(right), F.col(right_at).alias("__at"), F.lit(1 if strict else 0).alias("__side"), ties.alias("__tie"), value.alias("__value"))
    types = {f.name: f.dataType for f in have.schema.fields}
    null = lambda c: F.lit(None).cast(types[c]).alias(c)
    asked = left.select(*side(left), F.col(at).alias("__at"), F.lit(0 if strict else 1).alias("__side"), null("__tie"), null("__value"), kept.alias("__left"))
    left_type = asked.schema["__left"].dataType
    have = have.withColumn("__left", F.lit(None).cast(left_type))
    rows = asked.unionByName(have)
    bounds = None if block_rows is None else _split_keys(rows.select(*keys, "__at"), keys, block_rows)
    if bounds is None:
        rows = rows.withColumn("__block", F.lit(0))
    else:
        known = F.broadcast(bounds.select(*[F.col(k).alias(f"{k}b") for k in keys], "__bounds"))  # at most MOST_BLOCKS bounds
        put = lambda df: df.join(known, [F.col(k).eqNullSafe(F.col(f"{k}b")) for k in keys], "left").withColumn("__block", _block(F.col("__at"), F.col("__bounds")))
        rows = put(rows).select(*keys, "__at", "__side", "__tie", "__value", "__left", "__block")
        # the last value of each block, carried into the blocks behind it
        tails = put(have).where("__bounds is not null").groupBy(*keys, "__block").agg(F.max_by("__value", F.struct("__at", "__tie")).alias("__value"))
        blocks = bounds.select(*keys, F.explode(F.sequence(F.lit(0), F.size("__bounds"))).alias("__block"))
        before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        carried = blocks.join(tails, [*keys, "__block"], "left").select(*keys, "__block", F.last("__value", ignorenulls=True).over(before).alias("__value")).where("__value is not null")
        carried = carried.select(*keys, F.lit(None).cast(types["__at"]).alias("__at"), F.lit(-1).alias("__side"), null("__tie"), "__value", F.lit(None).cast(left_type).alias("__left"), "__block")
        rows = rows.unionByName(carried)
    running = Window.partitionBy(*keys, "__block").orderBy(F.col("__at").asc_nulls_first(), "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("__value", F.last("__value", ignorenulls=True).over(running)).where("__left is not null")
    return found.select(*[F.col(f"__left.`{c}`").alias(c) for c in left.columns], *[F.col(f"__value.`{c}`").alias(c) for c in values])
