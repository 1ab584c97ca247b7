"""Graph operators over edge tables: strongly connected components, bounded reach.

Components are found by contraction. Nodes are dealt to blocks, and each block works on the edges within it: what is strongly
connected there becomes one node (Tarjan's algorithm), nodes without a way in or out go, and nodes with one way in or one way
out, all of it within the block, are replaced by edges past them. What is left has fewer nodes, so rounds follow the edges
between blocks, not the length of paths; edges that one task can hold are solved in it. Then the rounds are undone, last first:
a node that was passed by lies in the component of its only way in if one of its ways out does, and the other way round.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Edges that one task solves in memory.
TASK_EDGES = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or a local one in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        path = tempfile.mkdtemp(prefix="factgrid-graph-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder, which keeps the rows' partitions and their order in them. Files stay there until the
    folder's owner clears it, or Spark's cleaner does where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    path = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(path)
    return df.checkpoint()


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (node, tag, label) that took the least label of any node from which they are reached, to a fixpoint."""
    while True:
        moved = labels.join(edges, [labels["node"] == edges["a"], labels["tag"] == edges["tag_a"]]).where("tag_a = tag_b").select(F.col("b").alias("node"), F.col("tag_b").alias("tag"), "label")
        new = cut(labels.unionByName(moved).groupBy("node", "tag").agg(F.min("label").alias("label")))
        if new.join(labels, ["node", "tag", "label"], "left_anti").isEmpty():
            return new
        labels = new


def _by_colour(edges: DataFrame) -> DataFrame:
    """(node, component) of the edges, with a round for each edge of the longest path: for what contraction can't make smaller.

    Nodes are split by the least node that reaches them and the least that they reach, again and again within the parts: two
    nodes of one component never part, and parts that no longer split are components. Only labels move, one a node; no
    reachability pairs are kept. A node without a cycle is its own component; self edges have no effect.
    """
    nodes = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("tag", F.lit("")))
    parts = -1
    while True:
        tagged = cut(edges.join(nodes.select(F.col("node").alias("a"), F.col("tag").alias("tag_a")), "a").join(nodes.select(F.col("node").alias("b"), F.col("tag").alias("tag_b")), "b"))
        back = tagged.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("tag_b").alias("tag_a"), F.col("tag_a").alias("tag_b"))
        start = nodes.withColumn("label", F.col("node"))
        forward = _spread(start, tagged).withColumnRenamed("label", "low")
        reverse = _spread(start, back).withColumnRenamed("label", "reach")
        nodes = cut(forward.join(reverse, ["node", "tag"]).select("node", F.sha2(F.concat_ws("\u0000", "tag", F.col("low").cast("string"), F.col("reach").cast("string")).cast("binary"), 256).alias("tag")))
        now = nodes.select("tag").distinct().count()
        if now == parts:
            break
        parts = now
    least = nodes.groupBy("tag").agg(F.min("node").alias("component"))
    return nodes.join(least, "tag").select("node", "component")


def tarjan(targets: dict) -> list[list]:
    """Strongly connected components of a graph {node: targets}, by Tarjan's algorithm with a stack of its own."""
    index: dict = {}
    low: dict = {}
    path, on, found = [], set(), []
    for root in targets:
        if root in index:
            continue
        work = [(root, iter(targets[root]))]
        index[root] = low[root] = len(index)
        path.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    path.append(w)
                    on.add(w)
                    work.append((w, iter(targets.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(path.pop())
                        on.discard(part[-1])
                    found.append(part)
    return found


def contract(pairs: list[tuple]) -> list[tuple]:
    """One block's work. pairs: edges (a, b) within it, (a, None) where a has edges to other blocks, (None, b) from others.

    Rows (kind, node, other, others): `edge` node -> other; `left` node; `merged` node into other; `gone` node, alone in its
    component; `passed` node by its only way in or out, other, and its ways on the other side, others. Passed rows come in the
    order of their passing.
    """
    targets: dict = {}
    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                targets.setdefault(x, [])
        if a is not None and b is not None:
            targets[a].append(b)
    rep: dict = {}
    rows: list[tuple] = []
    for part in tarjan(targets):
        head = min(part)
        for x in part:
            rep[x] = head
            if x != head:
                rows.append(("merged", x, head, None))
    into: dict = {x: set() for x in rep.values()}
    out: dict = {x: set() for x in rep.values()}
    open_in, open_out = set(), set()
    for a, b in pairs:
        if b is None:
            open_out.add(rep[a])
        elif a is None:
            open_in.add(rep[b])
        elif rep[a] != rep[b]:
            out[rep[a]].add(rep[b])
            into[rep[b]].add(rep[a])
    todo = list(out)
    while todo:
        v = todo.pop()
        if v not in out:
            continue
        ins, outs, inside = into[v], out[v], v not in open_in and v not in open_out
        if not (ins or v in open_in) or not (outs or v in open_out):
            rows.append(("gone", v, None, None))
            fresh = ()
        elif inside and (len(ins) == 1 or len(outs) == 1):
            one, many = (next(iter(ins)), outs) if len(ins) == 1 else (next(iter(outs)), ins)
            rows.append(("passed", v, one, sorted(many)))
            fresh = [(one, w) for w in outs] if len(ins) == 1 else [(p, one) for p in ins]
        else:
            continue
        for p in ins:
            out[p].discard(v)
        for w in outs:
            into[w].discard(v)
        del into[v], out[v]
        for p, w in fresh:
            out[p].add(w)
            into[w].add(p)
        todo += [*ins, *outs]
    rows += [("edge", a, b, None) for a, bs in out.items() for b in bs]
    return rows + [("left", x, None, None) for x in out]


def passed_back(known: dict, passed: list[tuple]) -> dict:
    """Components of all nodes that were passed, from those of what was left; passed: (node, other, others), in their order."""
    known = dict(known)
    for v, one, many in reversed(passed):
        near = known.get(one, one)
        known[v] = near if any(known.get(x, x) == near for x in many) else v
    return known


def _ranges(nodes: DataFrame, blocks: int) -> DataFrame:
    """(node, block): blocks of neighbouring nodes in their own order, for ids or names whose neighbours are often linked."""
    return cut(nodes.repartitionByRange(blocks, "node").select("node", F.spark_partition_id().alias("block")))


def _clusters(edges: DataFrame, nodes: DataFrame, blocks: int, salt: int, levels: int = 3) -> DataFrame:
    """(node, block): blocks of linked nodes. Each node joins the neighbour of the least hash, again and again along such
    choices; groups then choose among their neighbour groups in the same way."""
    group = nodes.select("node", F.col("node").alias("root"))
    for level in range(levels):
        near = edges.join(group.toDF("a", "x"), "a").join(group.toDF("b", "y"), "b").where("x <> y").select("x", "y")
        near = near.union(near.select("y", "x")).distinct()
        low = lambda c: F.struct(F.xxhash64(F.lit(salt * levels + level), c), F.col(c).alias("root"))  # noqa: B023, E731
        best = near.groupBy("x").agg(F.least(F.min(low("y")), F.min(low("x")))["root"].alias("to"))
        best = cut(best)
        for _ in range(3):  # chains of choices of up to eight
            best = best.join(best.select(F.col("x").alias("to"), F.col("to").alias("far")), "to", "left").select("x", F.coalesce("far", "to").alias("to"))
        group = cut(group.join(best.withColumnRenamed("x", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
    return group.select("node", F.pmod(F.xxhash64("root"), F.lit(blocks)).cast("int").alias("block"))


def _contracted(edges: DataFrame, dealt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges that are left after all blocks' work, and the rows (block, at, kind, node, other, others) to undo it."""
    side = lambda n: dealt.toDF(n, f"block_{n}")
    placed = edges.join(side("a"), "a").join(side("b"), "b")
    null = F.lit(None).cast(edges.schema["a"].dataType)
    within = placed.where("block_a = block_b").select(F.col("block_a").alias("block"), "a", "b")
    across = cut(placed.where("block_a <> block_b"))
    marks = across.select(F.col("block_a").alias("block"), "a", null.alias("b")).union(across.select(F.col("block_b").alias("block"), null.alias("a"), "b")).distinct()
    node = edges.schema["a"].dataType
    schema = T.StructType.fromDDL("block int, at long, kind string, node int, other int, others array<int>")
    schema["node"].dataType = schema["other"].dataType = node
    schema["others"].dataType = T.ArrayType(node)
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    names = schema.fieldNames()

    def work(table: pa.Table) -> pa.Table:
        rows = contract(list(zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True)))
        block = table.column("block")[0].as_py()
        columns = list(zip(*[(block, i, *r) for i, r in enumerate(rows)], strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows = cut(within.union(marks).groupBy("block").applyInArrow(work, schema))
    became = rows.where("kind in ('merged', 'gone')").select("node", F.struct(F.col("other").alias("to")).alias("was"))
    far = across.select("a", "b").join(became.toDF("a", "wa"), "a", "left").join(became.toDF("b", "wb"), "b", "left")
    end = lambda n, w: F.when(F.col(w).isNull(), F.col(n)).otherwise(F.col(f"{w}.to")).alias(n)  # noqa: E731  null where it is gone
    far = far.select(end("a", "wa"), end("b", "wb")).where("a is not null and b is not null and a <> b")
    return cut(rows.where("kind = 'edge'").select(F.col("node").alias("a"), F.col("other").alias("b")).union(far).distinct()), rows


def _undone(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component) of the nodes of a round, from those of the edges that it left."""
    known = rows.where("kind in ('left', 'passed')").join(found, "node", "left")
    schema = T.StructType([T.StructField(n, known.schema["node"].dataType) for n in ("node", "component")])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def work(table: pa.Table) -> pa.Table:
        order = table.sort_by("at")
        each = list(zip(*(order.column(c).to_pylist() for c in ("kind", "node", "other", "others", "component")), strict=True))
        before = {x: x if c is None else c for kind, x, _, _, c in each if kind == "left"}
        after = passed_back(before, [(x, one, many) for kind, x, one, many, _ in each if kind == "passed"])
        return pa.table([pa.array(list(after), kinds[0]), pa.array(list(after.values()), kinds[1])], names=["node", "component"])

    heads = known.groupBy("block").applyInArrow(work, schema)
    heads = cut(heads.union(rows.where("kind = 'gone'").select("node", F.col("node").alias("component"))))
    merged = rows.where("kind = 'merged'").select("node", F.col("other").alias("head"))
    return cut(heads.union(merged.join(heads.withColumnRenamed("node", "head"), "head").select("node", "component")))


def strongly_connected(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component) of the edges (a, b), component the least node of the strongly connected component.

    A node without a cycle is its own component; repeated edges, self edges and edges of a null node have no effect, but a node
    of a self edge alone isn't listed. Up to task_edges edges are solved by one task; more are contracted in blocks of half as
    many, first of neighbouring nodes, then, where that leaves most edges, of linked ones. What doesn't shrink either way is
    split by colours. Nodes are numbers, strings or structs of them without nulls. Checkpoints stay in the checkpoint folder until its owner or Spark's cleaner removes them.
    """
    kind = edges.schema["a"].dataType
    if isinstance(kind, T.StructType):  # blocks work with plain values
        edges = edges.select(*[F.when(F.col(c).isNotNull(), F.to_json(c)).alias(c) for c in ("a", "b")])
    edges = cut(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    rounds: list[DataFrame] = []
    n, by_range, turn = edges.count(), True, 0
    while n > task_edges:
        blocks = math.ceil(2 * n / task_edges)
        nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        edges, rows = _contracted(edges, _ranges(nodes, blocks) if by_range else _clusters(edges, nodes, blocks, turn))
        rounds.append(rows)
        before, n, turn = n, edges.count(), turn + 1
        if n > 0.9 * before and not by_range:
            break
        by_range = by_range and n < 0.6 * before
    if n > task_edges:
        found = _by_colour(edges)
    else:
        rest, rows = _contracted(edges, edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.lit(0).alias("block")))
        rounds.append(rows)
        found = rest.select(F.col("a").alias("node"), F.col("b").alias("component"))  # none are left
    for rows in reversed(rounds):
        found = _undone(rows, found)
    if isinstance(kind, T.StructType):
        found = found.withColumn("node", F.from_json("node", kind))
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes in components of two nodes or more."""
    found = strongly_connected(edges)
    large = found.groupBy("component").count().where("count > 1").select("component")
    return found.join(large, "component", "left_semi").select("node", "component")


def bounded_reach(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(start, node, depth): what each start reaches in at most so many steps, with the least number of them."""
    found = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct()
    front = found
    for d in range(1, most + 1):
        step = front.join(edges.select(F.col("a").alias("node"), "b"), "node").select("start", F.col("b").alias("node")).distinct()
        front = cut(step.join(found, ["start", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        found = cut(found.unionByName(front))
    return found
