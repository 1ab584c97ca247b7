"""Graph operators against plain versions: components, traces, fixpoints, identities."""

import random
import sys
import time
from collections import defaultdict

import pytest

from factgrid.operators import graph, identity, lattice, trace


def plain_components(edges):
    """The least node of those that a node reaches and is reached from, by a search from each node."""
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
        out[b] |= set()

    def reach(a):
        seen, todo = {a}, [a]
        while todo:
            for b in out[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return seen

    reached = {a: reach(a) for a in out}
    return {a: min(b for b in reached[a] if a in reached[b]) for a in out}


@pytest.mark.parametrize("seed", range(40))
def test_contraction_alone(seed):
    """Blocks' work and its undoing, without Spark: rounds of random blocks give the components of a search from each node."""
    r = random.Random(seed)
    n = r.randint(2, 40)
    edges = {(r.randrange(n), r.randrange(n)) for _ in range(r.randint(1, 3 * n))}
    edges = {(a, b) for a, b in edges if a != b}
    want, rounds, rest = plain_components(edges), [], edges
    for blocks in (4, 2, 1):
        of = {x: r.randrange(blocks) for e in rest for x in e}
        rows, after, became = [], set(), {}
        for k in range(blocks):
            pairs = [e for e in rest if of[e[0]] == of[e[1]] == k] + [(a, None) for a, b in rest if of[a] == k != of[b]] + [(None, b) for a, b in rest if of[b] == k != of[a]]
            got = graph.contract(pairs)
            rows.append(got)
            after |= {(x, y) for kind, x, y, _ in got if kind == "edge"}
            became |= {x: y for kind, x, y, _ in got if kind in ("merged", "gone")}
        for a, b in rest:
            if of[a] != of[b]:
                a, b = became.get(a, a), became.get(b, b)
                if a is not None and b is not None and a != b:
                    after.add((a, b))
        rounds.append(rows)
        rest = after
    assert not rest
    found = {}
    for rows in reversed(rounds):
        now = {}
        for got in rows:
            heads = graph.passed_back({x: found.get(x, x) for kind, x, _, _ in got if kind == "left"}, [x[1:] for x in got if x[0] == "passed"])
            heads |= {x: x for kind, x, _, _ in got if kind == "gone"}
            now |= heads | {x: heads[y] for kind, x, y, _ in got if kind == "merged"}
        found = now
    least = {c: min(x for x in found if found[x] == c) for c in set(found.values())}
    assert {x: least[c] for x, c in found.items()} == want


@pytest.mark.parametrize("task_edges", [25, 1_000_000])
def test_components_match_plain(spark, task_edges):
    r = random.Random(1)
    edges = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(90)] + [("ring0", "ring1"), ("ring1", "ring2"), ("ring2", "ring0"), ("x", "x"), (None, "x")] * 2
    got = {c.node: c.component for c in graph.strongly_connected(spark.createDataFrame(edges, "a string, b string"), task_edges).collect()}
    assert got == plain_components([e for e in edges if None not in e and e[0] != e[1]])
    assert graph.strongly_connected(spark.createDataFrame([], "a string, b string")).collect() == []


def test_long_paths_and_rings(spark):
    """A path of 10,000 nodes, a ring of 5,000 whose ids are in no order, in one task and in blocks."""
    r = random.Random(2)
    ids = list(range(20_000, 25_000))
    r.shuffle(ids)
    edges = [(i, i + 1) for i in range(9_999)] + list(zip(ids, ids[1:] + ids[:1], strict=True))
    table = spark.createDataFrame(edges, "a long, b long")
    for task_edges, most in ((1_000_000, 60), (8_000, 60)):
        began = time.monotonic()
        found = graph.strongly_connected(table, task_edges).groupBy("component").count().where("count > 1").collect()
        assert [(f.component, f["count"]) for f in found] == [(20_000, 5_000)]
        assert time.monotonic() - began < most
    assert len(graph.tarjan({i: [i + 1] for i in range(50_000)} | {50_000: [0]})) == 1  # no recursion


def plain_walk(edges, start, most):
    out, visits, visited = defaultdict(list), [], {start}
    for a, b, o in sorted(edges, key=lambda e: (e[2], e[1])):
        if b not in out[a]:
            out[a].append(b)

    def visit(node, parent, chain):
        visits.append([start, len(visits), node, parent, len(chain) - 1, chain, len(chain) - 1 == most and any(b not in visited for b in out[node])])
        if len(chain) <= most:
            for b in out[node]:
                if b not in visited:
                    visited.add(b)
                    visit(b, node, chain + [b])

    visit(start, None, [start])
    return visits


@pytest.mark.parametrize("most", [0, 2, 4, 50])
def test_traces_match_recursion(spark, most):
    r = random.Random(most)
    edges = [(r.randrange(30), r.randrange(30), r.randrange(5)) for _ in range(60)] + [(1, 1, 0), (2, 3, 1), (2, 3, 4)]
    table = spark.createDataFrame([*edges, (None, 3, 1), (3, None, 1)], "a long, b long, place int")
    starts = spark.createDataFrame([(i,) for i in (*range(12), 3, 99, None)], "node long")
    got = sorted((list(row) for row in trace.depth_first(table, starts, most).collect()), key=lambda x: x[:2])
    # of repeated edges the first in order counts
    assert got == [v for s in sorted({*range(12), 99}) for v in plain_walk(edges, s, most)]


def test_traces_of_names_and_chains(spark):
    names = [(f"m{i}", f"m{i + 1}", 0) for i in range(3000)]
    sys.setrecursionlimit(2000)
    got = trace.depth_first(spark.createDataFrame(names, "a string, b string, place int"), spark.createDataFrame([("m2980",), ("m0",)], "node string"), 8).collect()
    last = max((x for x in got if x.start == "m0"), key=lambda x: x.visit)
    assert (last.node, last.parent, last.depth, last.truncated, last.chain) == ("m8", "m7", 8, True, [f"m{i}" for i in range(9)])
    empty = spark.createDataFrame([], "a string, b string, place int")
    assert [tuple(x) for x in trace.depth_first(empty, spark.createDataFrame([("z",)], "node string"), 3).collect()] == [("z", 0, "z", None, 0, ["z"], False)]


@pytest.mark.parametrize("seed", [1, 2])
def test_fixpoint_matches_reach(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(45)] + [(5, 5), (6, 7), (7, 6), (6, 7)]
    values = [(i, [f"x{i % 7}", None] if i % 3 else None, None if i % 5 == 0 else i % 4 != 0, i % 11 or None, i * 7 % 13) for i in range(30)] + [(3, ["twice"], False, 1, 99), (None, ["lost"], True, 0, 1000)]
    merge = {"names": "union", "complete": "and", "least": "min", "most": "max"}
    got = lattice.fixpoint(spark.createDataFrame([*edges, (None, 1), (1, None)], "a long, b long"), spark.createDataFrame(values, "node long, names array<string>, complete boolean, least int, most int"), merge)
    rows = {row.node: row for row in got.collect()}
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    assert set(rows) == {x for e in edges for x in e} | set(range(30))
    for node, row in rows.items():
        seen, todo = {node}, [node]
        while todo:
            new = out[todo.pop()] - seen
            seen |= new
            todo += new
        own = [v for v in values if v[0] in seen]
        assert row.names == sorted({n for v in own for n in v[1] or () if n is not None})
        assert row.complete == (None if all(v[2] is None for v in own) else all(v[2] for v in own if v[2] is not None))
        assert row.least == min((v[3] for v in own if v[3] is not None), default=None) and row.most == max((v[4] for v in own), default=None)


def test_fixpoint_of_a_ring_and_nothing(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 12) for i in range(12)], "a long, b long")
    got = lattice.fixpoint(ring, spark.createDataFrame([(4, ["k"])], "node long, names array<string>"), {"names": "union"}).collect()
    assert {row.node: row.names for row in got} == {i: ["k"] for i in range(12)}
    none = spark.createDataFrame([], "a long, b long")
    assert lattice.fixpoint(none, spark.createDataFrame([], "node long, names array<string>"), {"names": "union"}).collect() == []


def test_recursive_reach_matches_rounds(spark):
    r = random.Random(4)
    edges = spark.createDataFrame([(r.randrange(25), r.randrange(25)) for _ in range(40)], "a long, b long")
    starts = spark.createDataFrame([(i,) for i in (1, 2, 3, 3, 77)], "node long")
    want = {tuple(x) for x in graph.bounded_reach(edges, starts, 4).collect()}
    assert {tuple(x) for x in lattice.reach_within(edges, starts, 4).collect()} == want and len(want) > 8


def plain_identities(aliases):
    to = {}
    for a, t in aliases:
        if a is not None and t is not None and a != t:
            to[a] = min(to.get(a, t), t)
    out = {a: (a, False) for a, t in aliases if a is not None and a == t and a not in to}
    for a in to:
        seen, x = [], a
        while x in to and x not in seen:
            seen.append(x)
            x = to[x]
        out[a] = (min(seen[seen.index(x) :]), True) if x in to else (x, False)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_identities_match_walks(spark, seed):
    r = random.Random(seed)
    name = lambda: f"n{r.randrange(60)}"
    aliases = [(name(), name()) for _ in range(30 + 15 * seed)] + [("self", "self"), (None, "x"), ("x", None), ("n1", "n2"), ("n1", "n2")]
    if seed == 3:
        aliases = [(f"c{i:03}", f"c{i + 1:03}") for i in range(300)] + [(f"r{i:03}", f"r{(i + 1) % 37:03}") for i in range(37)] + [(f"t{i}", f"t{i + 1}") for i in range(20)] + [("t20", "r005")]
    table = spark.createDataFrame(aliases, "alias string, target string")
    found = identity.identities(table)
    want = plain_identities(aliases)
    assert {row.alias: (row.identity, row.ring) for row in found.collect()} == want
    links = [(name(), name(), 1) for _ in range(20)] + [(None, "n1", 2)]
    got = identity.fold(spark.createDataFrame(links, "source string, target string, n int"), found, ["source", "target"])
    of = lambda x: want.get(x, (x,))[0]
    assert sorted(map(tuple, got.select("source", "target", "n").collect()), key=str) == sorted(((of(a), of(b), n) for a, b, n in links), key=str)
    assert identity.identities(table.limit(0)).collect() == []


def test_reach_of_pages_beyond_the_recursion_limit(spark, sf):
    """A page may lead on in more ways than a recursive query may have rows."""
    from factgrid.plans import cases

    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        rows = cases.QUERIES["link_reach"](spark, sf).selectExpr("count(1) n", "count(distinct start, node) pairs", "max(depth) most").first()
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", limit)
    assert rows.n == rows.pairs > 100 and rows.most == 3
