"""Depth-first traces: what each start reaches, in the order of a recursion that visits a node once, with the chain to it.

The edges that a start can meet within the bound are gathered breadth first, by joins, for all starts at a time; each start's own
edges then go to one task, which walks them in order with a stack of its own. Starts are spread over tasks. Memory of a walk is
that of one start's reach within the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import cut


def _walk(start: object, targets: dict, most: int) -> Iterator[tuple]:
    """(node, parent, depth, chain, truncated) in the order of the visits."""
    visited = {start}
    yield start, None, 0, [start], most == 0 and bool(targets.get(start))
    stack = [(start, iter(targets.get(start, ()) if most else ()))]
    while stack:
        node, rest = stack[-1]
        for b in rest:
            if b not in visited:
                break
        else:
            stack.pop()
            continue
        visited.add(b)
        depth = len(stack)
        deeper = targets.get(b, ())
        yield b, node, depth, [x for x, _ in stack] + [b], depth == most and any(c not in visited for c in deeper)
        stack.append((b, iter(deeper if depth < most else ())))


def depth_first(edges: DataFrame, starts: DataFrame, most: int, order: str = "place") -> DataFrame:
    """(start, visit, node, parent, depth, chain, truncated) of all nodes that a walk from each start visits.

    edges: a, b and the order of a's edges (equal ones by b); starts: node. A walk goes along the first edge to a node that it
    hasn't visited, down to `most` steps from its start, and back. visit numbers the visits from 0, the start's own; chain holds
    the nodes from the start to the node; truncated says that it lies at the bound and has an edge to a node not visited by then.
    A node that is first met at the bound isn't left again, even if a shorter way comes later. Edges of a null node, repeated
    edges and repeated starts make no difference; a start without edges is visited alone.
    """
    given = edges.where("a is not null and b is not null").groupBy("a", "b").agg(F.min(order).alias("o"))
    # one row for each node with its targets in order: what a start meets is a row for each node, not for each edge
    out = cut(given.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("o", "b"))).alias("t")).select("a", F.transform("t", lambda x: x["b"]).alias("targets")))
    starts = starts.where("node is not null").select(F.col("node").alias("start")).distinct()
    front = starts.select("start", F.col("start").alias("a"))
    met = None
    for _ in range(most + 1):
        found = cut(front.join(out, "a"))
        if found.isEmpty():
            break
        met = found if met is None else met.unionByName(found)
        front = found.select("start", F.explode("targets").alias("a")).distinct().join(met.select("start", "a"), ["start", "a"], "left_anti")
    node = out.schema["a"].dataType
    schema = T.StructType.fromDDL("start int, visit long, node int, parent int, depth int, chain array<int>, truncated boolean")
    for name in ("start", "node", "parent"):
        schema[name].dataType = node
    schema["chain"].dataType = T.ArrayType(node)
    if met is None:
        met = starts.limit(0).select("start", F.col("start").alias("a"), F.array("start").alias("targets"))
    rows = starts.join(met, "start", "left")

    def walk(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        targets = {a: list(t) for a, t in zip(group["a"], group["targets"], strict=True) if t is not None}
        visits = [(key[0], i, *v) for i, v in enumerate(_walk(key[0], targets, most))]
        made = {f.name: c for f, c in zip(schema.fields, zip(*visits, strict=True), strict=True)}
        made["parent"] = pd.array(made["parent"], dtype="Int64") if isinstance(node, T.IntegralType) else list(made["parent"])
        return pd.DataFrame(made)

    return rows.groupBy("start").applyInPandas(walk, schema)
