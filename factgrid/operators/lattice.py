"""Fixpoints of values that merge: what each node gathers from all it leads to, without pairs of nodes.

A node's value has one part for each column: a set that grows, a flag that can only fall or rise, a least or a largest value. In
each round only what is new in a node's value goes to the nodes that lead to it, and only nodes whose value it changes hand
on anything in the next. Values can't grow without end, so rounds end in rings, too, after the longest way that something new takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: How two values of a part merge.
UNION, AND, OR, MIN, MAX = "union", "and", "or", "min", "max"
_PARTIAL = {AND: F.bool_and, OR: F.bool_or, MIN: F.min, MAX: F.max}


def _both(kind: str, old: Column, new: Column) -> Column:
    """The merge of two values; null is the value that changes nothing."""
    if kind == UNION:
        empty = F.array().cast("array<string>")
        return F.array_sort(F.array_union(F.coalesce(old, empty), F.coalesce(new, empty)))
    if kind in (AND, OR):
        return F.coalesce((old & new) if kind == AND else (old | new), old, new)
    return F.least(old, new) if kind == MIN else F.greatest(old, new)


def _gathered(moved: DataFrame, merge: dict[str, str]) -> DataFrame:
    """One row a node of what came to it; elements of sets are made distinct before they meet, so a node that many lead to isn't
    sent the same element again by each task."""
    plain = {c: k for c, k in merge.items() if k != UNION}
    out = moved.groupBy("node").agg(F.count(F.lit(1)).alias("__n"), *[_PARTIAL[k](c).alias(c) for c, k in plain.items()])
    for c in (c for c, k in merge.items() if k == UNION):
        sets = moved.select("node", F.explode(c).alias("x")).distinct().groupBy("node").agg(F.collect_set("x").alias(c))
        out = out.join(sets, "node", "left")
    return out.drop("__n")


def fixpoint(edges: DataFrame, values: DataFrame, merge: dict[str, str]) -> DataFrame:
    """(node, *merge): each node's own value merged with those of all nodes that the edges (a takes from b) lead to.

    merge names the parts of values and how they merge: `union` (array of strings, the result sorted), `and`, `or` (flags), `min`,
    `max`. Nodes are those of values and of edges; a node of edges alone has nulls and empty sets of its own. Rows of one node are
    merged first. Null nodes and elements, repeated and self edges make no difference. Either table may be empty.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    edges = cut(edges)
    own = _gathered(values.where("node is not null").select("node", *[F.filter(c, lambda x: x.isNotNull()).alias(c) if k == UNION else F.col(c) for c, k in merge.items()]), merge)
    everyone = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    state = cut(own.join(everyone, "node", "full_outer").select("node", *[_both(k, F.col(c), F.lit(None)).alias(c) if k == UNION else F.col(c) for c, k in merge.items()]))
    fresh = state
    while True:
        moved = fresh.withColumnRenamed("node", "b").join(edges, "b").select(F.col("a").alias("node"), *merge)
        came = _gathered(moved, merge).select("node", *[F.col(c).alias(f"__{c}") for c in merge])
        met = state.join(came, "node", "left").select("node", *merge, *[_both(k, F.col(c), F.col(f"__{c}")).alias(f"__{c}") for c, k in merge.items()])
        changed = F.lit(False)
        for c in merge:
            changed = changed | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
        met = cut(met.withColumn("__changed", changed))
        new = met.where("__changed")
        state = met.select("node", *[F.col(f"__{c}").alias(c) for c in merge])
        if new.isEmpty():
            return state
        fresh = new.select("node", *[(F.array_except(f"__{c}", c) if k == UNION else F.col(f"__{c}")).alias(c) for c, k in merge.items()])


def reach_within(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(start, node, depth) of what each start reaches in at most so many steps, by one recursive query.

    Every way of at most that length is a row on its way, and more rows than spark.sql.cteRecursionRowLimit are an error, so it is
    meant for small bounds and few ways; graph.bounded_reach keeps one row for each node that a start meets, with a job for each step.
    """
    spark = edges.sparkSession
    edges.createOrReplaceTempView("__reach_edges")
    starts.createOrReplaceTempView("__reach_starts")
    return spark.sql(f"""
        WITH RECURSIVE way(start, node, depth) MAX RECURSION LEVEL {most + 1} AS (
          SELECT node, node, 0 FROM (SELECT DISTINCT node FROM __reach_starts WHERE node IS NOT NULL)
          UNION ALL SELECT way.start, e.b, way.depth + 1 FROM way JOIN __reach_edges e ON e.a = way.node WHERE way.depth < {most} AND e.b IS NOT NULL
        ) SELECT start, node, min(depth) AS depth FROM way GROUP BY start, node""")
