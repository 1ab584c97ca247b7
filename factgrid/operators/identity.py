"""Identities behind chains of aliases: each name points to one other, and what it is in the end is found by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut


def identities(aliases: DataFrame) -> DataFrame:
    """(alias, identity, ring) of the table (alias, target): identity is where the chain of an alias ends.

    A chain that runs into a ring ends at the ring's least name, and ring is true for it. An alias with several targets follows
    the least; an alias of itself ends there. Rows with a null name are ignored; names that are no alias aren't listed. Every
    round doubles the steps of all pointers, so a chain of n aliases takes about log2(n) rounds, and one row an alias is kept.
    """
    given = aliases.where("alias is not null and target is not null and alias <> target").groupBy("alias").agg(F.min("target").alias("to"))
    selves = aliases.where("alias = target").select("alias").distinct().join(given, "alias", "left_anti").select("alias", F.col("alias").alias("identity"), F.lit(False).alias("ring"))

    def jumped(state: DataFrame) -> DataFrame:
        ahead = state.select(F.col("alias").alias("to"), F.col("to").alias("far"), F.col("least").alias("__least"))
        return cut(state.join(ahead, "to", "left").select("alias", F.coalesce("far", "to").alias("to"), F.least("least", "__least").alias("least"), F.col("far").isNotNull().alias("moves")))

    # least: of the aliases that the pointer has passed, its own included
    state = cut(given.select("alias", "to", F.col("alias").alias("least"), F.lit(True).alias("moves")))
    left = state.count()
    while left:
        state = jumped(state)
        before, left = left, state.where("moves").count()
        if left == before:  # none came to an end: what is left leads into rings
            break
    out = selves.unionByName(state.where("not moves").select("alias", F.col("to").alias("identity"), F.lit(False).alias("ring")))
    if left:
        moving = state.where("moves")
        for _ in range(left.bit_length()):  # until pointers have passed as many names as are left: they are within the rings, and all round them
            moving = jumped(moving)
        around = moving.select(F.col("alias").alias("to"), F.col("least").alias("identity"))
        out = out.unionByName(moving.join(around, "to").select("alias", "identity", F.lit(True).alias("ring")))
    return out


def fold(rows: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """rows with the identities (as identities() gives them) in place of the names in the columns; other names stay."""
    for c in columns:
        known = found.select(F.col("alias").alias("__alias"), F.col("identity").alias("__identity"))
        rows = rows.join(known, F.col(c) == F.col("__alias"), "left").withColumn(c, F.coalesce("__identity", c)).drop("__alias", "__identity")
    return rows
