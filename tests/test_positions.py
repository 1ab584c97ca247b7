"""As-of joins and ranges within ranges against plain versions."""

import random
import time

import pytest

from factgrid.functions import scan
from factgrid.operators import asof, intervals


def plain_asof(left, right, strict):
    out = []
    for row in left:
        k, at = row[0], row[1]
        fits = [r for r in right if r[0] is not None and r[1] is not None and r[0] == k and at is not None and (r[1] < at if strict else r[1] <= at)]
        best = max(fits, key=lambda r: (r[1], r[2]), default=(None,) * 3)
        out.append((*row, best[1], best[2]))
    return out


@pytest.mark.parametrize("block_rows", [7, 40, 1_000_000])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_matches_plain(spark, block_rows, strict):
    r = random.Random(block_rows)
    key = lambda: r.choice(["a", "a", "a", "a", "b", "c", None])
    left = [(key(), r.choice([None, *range(-5, 400)]), i) for i in range(300)] + [("a", 5, 1)] * 3
    right = [(key(), r.choice([None, *range(0, 300, 3)]), i) for i in range(200)]
    got = asof.asof_join(spark.createDataFrame(left, "k string, at int, id int"), spark.createDataFrame(right, "k string, place int, v int"), "at", "place", ["place", "v"], by=["k"], tie=["v"], strict=strict, block_rows=block_rows)
    assert got.columns == ["k", "at", "id", "place", "v"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_asof(left, right, strict), key=str)


def test_asof_without_key_and_rows(spark):
    left, right = spark.createDataFrame([(i,) for i in range(50)], "at int"), spark.createDataFrame([(7, "x"), (30, "y")], "place int, v string")
    got = {r["at"]: r.v for r in asof.asof_join(left, right, "at", "place", ["v"], block_rows=6).collect()}
    assert got == {i: None if i < 7 else "x" if i < 30 else "y" for i in range(50)}
    assert {r.v for r in asof.asof_join(left, right.limit(0), "at", "place", ["v"]).collect()} == {None}
    assert asof.asof_join(left.limit(0), right, "at", "place", ["v"]).collect() == []


def test_places_in_a_long_text(spark):
    """Ten million characters in one row: words get their lines without counting breaks again for each."""
    text = "some words é of a line\n" * 435_000 + "end"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "\n\nx")], "doc_id long, text string")
    began = time.monotonic()
    lines, words = scan.line_starts(docs, ["doc_id"], "text"), scan.matches(docs, ["doc_id"], "text", "(?:words|end|x)")
    placed = asof.asof_join(words, lines, "start", "line_start", ["line", "line_start"], by=["doc_id"], block_rows=100_000)
    row = placed.selectExpr("count(1) n", "sum(line) s", "max(line) m", "sum(start - line_start) p").first()
    assert (row.n, row.s, row.m, row.p) == (435_002, 435_000 * 435_001 // 2 + 435_001 + 3, 435_001, 5 * 435_000)
    assert time.monotonic() - began < 60


def test_block_of_places(spark):
    """Every place finds its block by steps as by a walk over all bounds."""
    bounds = list(range(0, 1000, 7))
    rows = spark.createDataFrame([(i, bounds) for i in range(-3, 1010, 5)] + [(5, []), (5, None), (None, bounds)], "at int, b array<int>")
    for r in rows.withColumn("block", asof._block(rows["at"], rows["b"])).collect():
        assert r.block == (0 if r.b is None or r["at"] is None else sum(b < r["at"] for b in r.b))


@pytest.mark.parametrize("task_rows", [5, 500_000])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_contained_matches_plain(spark, task_rows, by):
    r = random.Random(task_rows)
    span = lambda top: (lambda a, n: (a, a + n))(r.randint(-300, 300), r.choice([0, 1, 2, 3, 8, 50, top, -1]))
    key = lambda: r.choice(["a", "a", "b", None]) if by else None
    inner = [(key(), *span(20), i) for i in range(150)] + [(None if not by else "a", 0, 0, 900 + i) for i in range(60)] + [("a", None, 3, 1), ("a", 3, None, 2)]
    outer = [(key(), *span(700), i) for i in range(80)] + [("a", None, 3, 1), ("b", 5, None, 2)]
    x, y = spark.createDataFrame(inner, "k string, start int, end int, i int"), spark.createDataFrame(outer, "k string, outer_start int, outer_end int, o int")
    got = intervals.contained(x if by else x.drop("k"), y if by else y.drop("k"), by=by, task_rows=task_rows)
    want = [(a[3], b[3]) for a in inner for b in outer if None not in (*a[1:3], *b[1:3]) and b[1] <= b[2] and a[1] <= a[2] and a[1] >= b[1] and a[2] <= b[2] and (not by or a[0] is not None and a[0] == b[0])]
    assert sorted((r.i, r.o) for r in got.collect()) == sorted(want)
    assert intervals.contained(x.drop("k"), y.drop("k").limit(0)).collect() == [] == intervals.contained(x.drop("k").limit(0), y.drop("k")).collect()


def test_many_ranges_of_one_key(spark):
    """10^5 ranges of one key, some of them long, and as many to look up: work follows the pairs."""
    outer = spark.range(100_000).selectExpr("id o", "id * 10 outer_start", "id * 10 + if(id % 1000 = 0, 5000, 9) outer_end")
    inner = spark.range(100_000).selectExpr("id i", "id * 10 + 2 start", "id * 10 + 5 end")
    began = time.monotonic()
    n = intervals.contained(inner, outer, task_rows=20_000).count()
    assert n == sum(1 for o in range(0, 100_000, 1000) for i in range(o, min(o + 501, 100_000)) if i * 10 + 5 <= o * 10 + 5000) + 100_000 - 100
    assert time.monotonic() - began < 40


def test_texts_are_searched_once(spark, sf, monkeypatch):
    """The words of all texts aren't found once more to count them."""
    from factgrid.plans import cases

    counted = []
    monkeypatch.setattr(asof, "_split_keys", lambda *a: counted.append(a))
    assert cases.QUERIES["word_places"](spark, sf).columns == ["doc_id", "word", "line", "place"] and not counted
