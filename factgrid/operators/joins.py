"""Join shapes that the rules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def longest_prefix(rows: DataFrame, path: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """rows with the columns of the longest prefix (by whole segments) of the path, null where none fits.

    Every distinct path is expanded into its own prefixes, as many as it has segments, and joined by equality: no comparison of
    all rows with all prefixes, whatever the number of either. rows must not have columns __prefix and __best.
    """
    parts = F.split(F.col(path), "/")
    own = rows.select(path).where(F.col(path).isNotNull()).distinct()
    each = own.select(path, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("__prefix"))
    found = each.join(prefixes.withColumnRenamed(prefix, "__prefix"), "__prefix")
    best = found.groupBy(path).agg(F.max_by(F.struct(F.col("__prefix").alias(prefix), *[c for c in prefixes.columns if c != prefix]), F.length("__prefix")).alias("__best"))
    return rows.join(best, path, "left").select(*rows.columns, "__best.*")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left without a partner."""
    return left.join(right, keys, "left_anti")


def first_per(rows: DataFrame, keys: list[str], order: list[Column | str], number: int = 1) -> DataFrame:
    """The number-th row of each key in the order; a witness of each pair, or the second of its kind."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == number).drop("__n")


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other: side (`missing` in right, `extra` in right) and the row."""
    return left.exceptAll(right).withColumn("side", F.lit("missing")).unionByName(right.exceptAll(left).withColumn("side", F.lit("extra")))


def saturation(edges: DataFrame, source: str, target: str, what: str, above: int) -> DataFrame:
    """Pairs with more distinct `what` than the bound."""
    return edges.groupBy(source, target).agg(F.count_distinct(what).alias("n")).where(F.col("n") > above)


def fan_out(edges: DataFrame, nodes: DataFrame, node: str, source: str, target: str) -> DataFrame:
    """Distinct targets of each node, 0 for nodes without edges."""
    counts = edges.groupBy(source).agg(F.count_distinct(target).alias("n")).withColumnRenamed(source, node)
    return nodes.select(node).distinct().join(counts, node, "left").select(node, F.coalesce("n", F.lit(0)).alias("n"))
