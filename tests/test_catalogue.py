"""Every query with SQL against DuckDB on the smallest tables, and the command line."""

import duckdb
import pytest

import __spark_entry__
from braidgraph import catalogue, cli
from braidgraph.functions.pattern import Pattern
from braidgraph.operators import graph
from braidgraph.plans.match import continuous_match
from braidgraph.sources import testgraph

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    got = plain(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(__spark_entry__.oracle_sql()[name])
    want = plain([d[0] for d in result.description], result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["update_id", "op", "matches"]


def test_filters_reach_the_scan(spark):
    plan = continuous_match(testgraph.instances(spark, SF), catalogue.TRIANGLE)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(elabel), EqualTo(elabel,2)" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "g").write_text("v 0 0\nv 1 1\nv 2 0\ne 0 1 0\n")
    (tmp_path / "q").write_text("v 5 0\nv 6 1\nv 7 0\ne 5 6 0\ne 6 7 0\n")
    (tmp_path / "u").write_text("v 9 0\ne 1 2 0\ne 9 1 0\n-e 0 1 0\ne 0 2 0\n")
    assert cli.load_pattern(spark, str(tmp_path / "q")) == Pattern((0, 1, 0), ((0, 1, 0), (1, 2, 0)))
    results, counts = cli.run(spark, str(tmp_path / "g"), cli.load_pattern(spark, str(tmp_path / "q")), str(tmp_path / "u"), "anchored")
    assert sorted(tuple(r) for r in results.collect()) == [(1, "+", 2), (2, "+", 4), (3, "-", 4)]
    assert tuple(counts.first()) == (4, 3, 3, 6, 4)


def test_reduction_needs_a_tree(spark):
    with pytest.raises(ValueError, match="tree"):
        graph.reduce_candidates(testgraph.edges(spark, SF), catalogue.TRIANGLE)
