"""Pairs by groups: counted without a row for each."""

from braidgraph.operators import graph


def pairs_of(spark, left, right):
    return graph.GroupedPairs(spark.createDataFrame(left, "group int, src long"), spark.createDataFrame(right, "group int, dst long"))


def test_counts_as_by_pairs(spark):
    left, right = [(1, 10), (1, 11), (2, 11), (2, 11), (None, 12), (3, 13)], [(1, 20), (2, 20), (2, 21), (None, 22), (4, 23)]
    edges = [(10, 20, 4), (11, 21, 4), (11, 21, 3), (12, 22, 4), (13, 20, 4), (10, 21, 4)]
    all_pairs = [(s, d) for g, s in left for h, d in right if g is not None and g == h]
    arcs = spark.createDataFrame(edges, "src long, dst long, elabel int")
    pairs = pairs_of(spark, left, right)
    for label in (None, 3, 4, 5):
        there = {(s, d) for s, d, k in edges if label in (None, k)}
        want = [(f, len(x), sum(s for s, _ in x)) for f in (False, True) if (x := [p for p in all_pairs if (p in there) == f])]
        assert sorted(tuple(r) for r in graph.edge_exists_counts(pairs, arcs, elabel=label).collect()) == want
    found = [k for p in all_pairs for k in [k for s, d, k in edges if (s, d) == p] or [None]]
    want = sorted(((k, found.count(k)) for k in set(found)), key=str)
    assert sorted((tuple(r) for r in graph.edge_label_counts(pairs, arcs).collect()), key=str) == want


def test_more_pairs_than_fit_anywhere(spark):
    """Ten million pairs each of a million left rows: the sum of their src fits no long and is null, the count is whole."""
    left = spark.range(1_000_000).selectExpr("1 as group", "4000000000 + id as src")
    right = spark.range(10_000_000).selectExpr("1 as group", "6000000000 + id as dst")
    arcs = spark.createDataFrame([(4_000_000_001, 6_000_000_002)], "src long, dst long")
    got = sorted(tuple(r) for r in graph.edge_exists_counts(graph.GroupedPairs(left, right), arcs).collect())
    assert got == [(False, 10**13 - 1, None), (True, 1, 4_000_000_001)]


def test_no_pairs(spark):
    pairs, arcs = pairs_of(spark, [(1, 10)], [(2, 20)]), spark.createDataFrame([(10, 20, 4)], "src long, dst long, elabel int")
    assert graph.edge_exists_counts(pairs, arcs).collect() == [] and graph.edge_label_counts(pairs, arcs).collect() == []
