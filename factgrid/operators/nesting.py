"""Ranges that nest, as elements or syntax nodes do: what lies around what, without pairs of ranges.

Ranges are opened and closed along their place, as by a stack machine; the depth is the running sum of opens and closes, and the
innermost range around a place is the last one that was opened at the present depth. So work is one sort of a key's ranges.
A key is one text (a page, a file), which one task can hold; all keys are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of events at one place: what ends there, what starts there or is asked, and the end of what is empty there.
CLOSE, OPEN, LAST = 0, 1, 2


def _events(inner: DataFrame, outer: DataFrame, key: list[str], id: str, start: str, end: str, carried: Column, asked: Column) -> DataFrame:
    """Opens and closes of outer (with what it carries) and asks of inner (with its row), by key, and __depth, the number of
    ranges of outer that are open behind each."""
    keys = [F.col(k) for k in key]
    outer = outer.where(F.col(end) >= F.col(start))
    none = lambda c, df: F.lit(None).cast(df.select(c.alias("x")).schema["x"].dataType)
    opens = outer.select(*keys, F.col(start).cast("long").alias("__at"), F.lit(OPEN).alias("__kind"), (-F.col(end)).cast("long").alias("__end"), F.col(id).alias("__id"), carried.alias("__outer"), none(asked, inner).alias("__inner"), F.lit(1).alias("__step"))
    closes = outer.select(*keys, F.col(end).cast("long").alias("__at"), F.lit(CLOSE).alias("__kind"), (-F.col(start)).cast("long").alias("__end"), F.col(id).alias("__id"), none(carried, outer).alias("__outer"), none(asked, inner).alias("__inner"), F.lit(-1).alias("__step"))
    asks = inner.select(*keys, F.col(start).cast("long").alias("__at"), F.lit(OPEN).alias("__kind"), (-F.col(end)).cast("long").alias("__end"), F.col(id).alias("__id"), none(carried, outer).alias("__outer"), asked.alias("__inner"), F.lit(0).alias("__step"))
    return opens.unionByName(closes).unionByName(asks)


def _order() -> list[Column]:
    """By place; ends first, but for ranges that start and end there; of starts the longest first, and opens before asks."""
    empty = (F.col("__kind") == CLOSE) & (-F.col("__end") == F.col("__at"))
    return [F.col("__at"), F.when(empty, LAST).otherwise(F.col("__kind")), F.col("__end"), F.when(F.col("__step") == 0, 1).otherwise(0), F.col("__id")]


def around(inner: DataFrame, outer: DataFrame, key: list[str], id: str = "node_id", start: str = "start", end: str = "end", carry: list[str] | None = None, strict: bool = True) -> DataFrame:
    """inner with `depth`, the number of ranges of outer that lie around it, and `outer_<c>` for the id, the bounds and each
    carried column of the innermost of them (null where there is none).

    Ranges of outer nest: two of one key lie apart, or one within the other. A range of the same bounds counts as around, unless
    it has the same id (strict). Rows of inner with a null key or place get depth 0. An empty range that lies where one ends and
    another starts is taken as in the one that starts. Repeated rows of inner stay.
    """
    carry = list(dict.fromkeys([id, start, end, *(carry or [])]))
    own = F.struct(*[F.col(f"`{c}`") for c in inner.columns])
    out = F.struct(*[F.col(f"`{c}`") for c in carry])
    known = inner.dropna(subset=[*key, start, end])
    events = _events(known, outer.dropna(subset=[*key, start, end]), key, id, start, end, out, own)
    along = Window.partitionBy(*key).orderBy(*_order()).rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("__depth", F.sum("__step").over(along)).where(F.col("__step") >= 0)
    opens = events.where("__step = 1")
    # each open with the one around it: the last that was opened one level further out
    level = Window.partitionBy(*key, "__level").orderBy(*_order(), "__ask").rowsBetween(Window.unboundedPreceding, 0)
    place = [*key, "__at", "__kind", "__end", "__id", "__step"]
    given = opens.select(*place, F.col("__depth").alias("__level"), F.lit(0).alias("__ask"), F.col("__outer").alias("__found"), F.lit(None).cast(opens.schema["__outer"].dataType).alias("__outer"), F.col("__depth"))
    asked = opens.select(*place, (F.col("__depth") - 1).alias("__level"), F.lit(1).alias("__ask"), F.lit(None).cast(opens.schema["__outer"].dataType).alias("__found"), "__outer", "__depth")
    nested = given.unionByName(asked).withColumn("__parent", F.last("__found", ignorenulls=True).over(level)).where("__ask = 1").select(*place, "__outer", "__parent", "__depth")
    given = nested.select(*place, F.col("__depth").alias("__level"), F.lit(0).alias("__ask"), F.struct("__outer", "__parent").alias("__found"), F.lit(None).cast(events.schema["__inner"].dataType).alias("__inner"))
    asks = events.where("__step = 0").select(*place, F.col("__depth").alias("__level"), F.lit(1).alias("__ask"), F.lit(None).cast(given.schema["__found"].dataType).alias("__found"), "__inner")
    met = given.unionByName(asks).withColumn("__found", F.last("__found", ignorenulls=True).over(level)).where("__ask = 1")
    # the innermost one is the row itself, or one of its bounds that was opened behind it
    same = F.col(f"__found.__outer.`{id}`").eqNullSafe(F.col(f"__inner.`{id}`")) if strict else F.lit(False)
    best = F.when(F.col("__level") == 0, None).when(same, F.col("__found.__parent")).otherwise(F.col("__found.__outer"))
    met = met.withColumn("__best", best)
    found = met.select(*[F.col(f"__inner.`{c}`").alias(c) for c in inner.columns], F.col("__level").alias("depth"), *[F.col(f"__best.`{c}`").alias(f"outer_{c}") for c in carry])
    if strict:  # rows that are themselves in outer are open when they ask
        itself = outer.dropna(subset=[*key, start, end]).where(F.col(end) >= F.col(start)).select(*key, id, F.lit(1).alias("__self")).distinct()
        found = found.join(itself, [*key, id], "left").withColumn("depth", F.col("depth") - F.coalesce("__self", F.lit(0))).select(*found.columns)
    lost = inner.where(" or ".join(f"`{c}` is null" for c in dict.fromkeys([*key, start, end])))
    kinds = {f.name: f.dataType for f in found.schema.fields}
    return found.unionByName(lost.select(*inner.columns, *[(F.lit(0) if c == "depth" else F.lit(None)).cast(kinds[c]).alias(c) for c in found.columns if c not in inner.columns]))


def held(outer: DataFrame, inner: DataFrame, key: list[str], id: str = "node_id", start: str = "start", end: str = "end", strict: bool = True) -> DataFrame:
    """outer with `inside`, the number of ranges of inner that lie in it; strict: without itself.

    Counts run along the places: what was asked by the end of a range less what was by its start. Ranges of inner and outer nest,
    as in around().
    """
    nothing = F.lit(0)
    events = _events(inner.dropna(subset=[*key, start, end]), outer.dropna(subset=[*key, start, end]), key, id, start, end, nothing, nothing)
    along = Window.partitionBy(*key).orderBy(*_order()).rowsBetween(Window.unboundedPreceding, 0)
    seen = events.withColumn("__n", F.sum(F.when(F.col("__step") == 0, 1).otherwise(0)).over(along)).where("__step <> 0")
    counts = seen.groupBy(*key, F.col("__id").alias(id)).agg(F.sum(F.col("__n") * -F.col("__step")).alias("inside"))
    if strict:
        itself = inner.select(*key, id, F.lit(1).alias("__self")).distinct()
        counts = counts.join(itself, [*key, id], "left").select(*key, id, (F.col("inside") - F.coalesce("__self", F.lit(0))).alias("inside"))
    return outer.join(counts, [*key, id], "left").select(*outer.columns, F.coalesce("inside", F.lit(0)).cast("long").alias("inside"))
