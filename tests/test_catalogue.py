"""Every catalogue query against its SQL."""

import duckdb
import pytest

from factgrid.plans import cases, catalogue, runner

TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations benchmark embeddings".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query_matches_sql(spark, sf, con, name):
    got = catalogue.QUERIES[name](spark, sf)
    want = con.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = lambda r: sorted(r, key=str)
    assert rows(tuple(r[c] for c in columns) for r in got.collect()) == rows(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())
    assert catalogue.KIND[name] in ("R", "T")


def test_every_rule_has_a_query():
    names = {cases.query_name(n.removesuffix(" (file)")) for n in runner.ALL}
    assert names <= set(cases.RULE_QUERIES) and "rule_boundary_import_policy_tree" in cases.RULE_QUERIES


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("rows", [9, 700, 1 << 18])  # with more suppliers than one task's rows, with fewer, and all in one task
def test_tasks_of_the_edges_follow_the_rows(spark, sf, con, monkeypatch, rows):
    monkeypatch.setattr(catalogue, "TASK_ROWS", rows)
    edges, want = catalogue._edges(spark, sf), con.sql(catalogue.EDGES)
    assert sorted(map(tuple, edges.select(*want.columns).collect())) == sorted(want.fetchall())
    assert edges.rdd.getNumPartitions() >= spark.read.parquet(f"{sf}/lineitem.parquet").count() / rows
