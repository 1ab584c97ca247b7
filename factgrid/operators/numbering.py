"""Row numbers over a whole table without a single task, and writes that count what they write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .graph import cut

#: Bits of a row's place within its partition in Spark's increasing ids.
PLACE_BITS = 33


def numbered(rows: DataFrame, order: list[Column | str], name: str = "number", by: list[str] | None = None) -> DataFrame:
    """rows with their number (from 1) in the order, as row_number() over all of them would give; with `by`, within each group.

    The first pass deals rows to ranges of the order and sorts each; the second adds to a row's place in its range the rows of the
    ranges before it, which are counted once: as many counts as ranges reach the driver. No range holds more than its share, and
    no group is one task. Rows that are equal in the order are numbered in any way, so end it with what tells rows apart; nulls
    come where the order puts them, first by default. by must name the order's first columns' groups: it is sorted before it.
    """
    by = by or []
    order = [*[F.col(c).asc_nulls_first() for c in by], *[F.col(c) if isinstance(c, str) else c for c in order]]
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = dealt.withColumn("__at", F.monotonically_increasing_id())
    counts = placed.groupBy(F.shiftright("__at", PLACE_BITS).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a range
    before, total = {}, 0
    for part, n in sorted(map(tuple, counts)):
        before[part] = total
        total += n
    first = F.array(*[F.lit(before.get(p, 0)).cast("long") for p in range(max(before, default=0) + 1)])
    number = F.get(first, F.shiftright("__at", PLACE_BITS).cast("int")) + F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1
    out = placed.withColumn(name, number).drop("__at")
    if not by:
        return out
    starts = out.groupBy(*by).agg(F.min(name).alias("__first"))
    keys = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    starts = starts.select(*[F.col(c).alias(f"__{c}") for c in by], "__first")
    return out.join(starts, keys).withColumn(name, F.col(name) - F.col("__first") + 1).select(*rows.columns, name)


def written(rows: DataFrame, path: str, severity: str = "severity", failing: str = "error") -> dict[str, int]:
    """Writes findings as Parquet and returns the number of rows, those of each severity seen among errors and warnings, and the
    exit status (1 if any fails), all counted by the write itself: the rows aren't read again."""
    seen = Observation("written")
    count = lambda what: F.count_if(F.col(severity) == what)
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), count("error").alias("errors"), count("warning").alias("warnings"), F.count_if(F.col(severity) == failing).alias("failing")).write.parquet(path)
    got = seen.get
    return {"rows": got["rows"], "errors": got["errors"], "warnings": got["warnings"], "status": int(got["failing"] > 0)}
