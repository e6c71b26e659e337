"""Labels of grouped pairs: every pair is looked up, those without an edge too."""

import random

import pytest

from braidgraph.operators import graph, lookup
from tests.test_grouped_pairs import pairs_of


def plain(left, right, edges):
    """(src, dst, elabel) of a plain left join."""
    out = []
    for s, d in ((s, d) for g, s in left for h, d in right if g is not None and g == h):
        out += [(s, d, k) for k in [k for a, b, k in edges if (a, b) == (s, d)] or [None]]
    return out


def counts(rows):
    keys = [k for *_, k in rows]
    return sorted(((k, keys.count(k)) for k in set(keys)), key=str)


@pytest.fixture(params=["whole", "small"])
def sizes(request, monkeypatch):
    if request.param == "small":  # several blocks of sources, packets and tables a group
        monkeypatch.setattr(graph, "PACKET_SOURCES", 4)
        monkeypatch.setattr(graph, "PACKET_PAIRS", 16)
        monkeypatch.setattr(lookup, "CELLS", 8)


def test_each_pair_as_by_left_join(spark, sizes):
    """Copies of ends, ends in several groups, null ends and groups, several labels of a pair, null labels, edges of other vertices."""
    rnd = random.Random(3)
    left = [(rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None, *range(10, 30)])) for _ in range(60)] + [(5, 10)]
    right = [(rnd.choice([1, 1, 1, 2, 4, None]), rnd.choice([None, *range(50, 70)])) for _ in range(60)] + [(6, 50)]
    edges = [(rnd.randrange(8, 30), rnd.randrange(50, 72), rnd.choice([None, 3, 4, 2**31 - 1, -5])) for _ in range(250)] + [(None, 50, 3), (10, None, 3), (None, None, 4)]
    pairs, arcs = pairs_of(spark, left, right), spark.createDataFrame(edges, "src long, dst long, elabel int")
    want = plain(left, right, [e for e in edges if None not in e[:2]])
    got = [tuple(r)[:3] for r in graph.edge_label_lookup(pairs, arcs).collect() for _ in range(r.pairs)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted((tuple(r) for r in graph.edge_label_counts(pairs, arcs).collect()), key=str) == counts(want)


def test_edge_without_a_label(spark):
    """Its pair has no label, and is not lost."""
    pairs, arcs = pairs_of(spark, [(1, 10)], [(1, 20), (1, 21)]), spark.createDataFrame([(10, 20, None)], "src long, dst long, elabel int")
    assert [tuple(r) for r in graph.edge_label_counts(pairs, arcs).collect()] == [(None, 2)]


def test_pairs_are_looked_up_and_not_shuffled(spark):
    """A million pairs, 1,000 with an edge: each has a cell; what Spark hands on is lists of ends and edges."""
    left, right = spark.range(1000).selectExpr("1 as group", "id as src"), spark.range(1000).selectExpr("1 as group", "id as dst")
    arcs = spark.range(1000).selectExpr("id as src", "id as dst", "4 as elabel")
    packets = graph.GroupedPairs(left, right).packets(arcs)
    assert packets.selectExpr("sum(size(srcs) * size(dsts))").first()[0] == 1_000_000 and packets.count() < 10
    assert sum(t.cells.size for t in lookup.tables(packets.toArrow().to_batches())) == 1_000_000
    assert sorted(tuple(r) for r in graph.edge_label_counts(graph.GroupedPairs(left, right), arcs).fillna(-1).collect()) == [(-1, 999_000), (4, 1000)]
