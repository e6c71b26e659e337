"""Common neighbours of pairs, in the cheapest order of joins."""

import pytest

from braidgraph.operators import graph


@pytest.mark.parametrize("order", ["a", "b", "w"])
def test_order_and_rows(spark, order):
    """Many neighbours of one end, of the other, or of the common ones: the order avoids them, and the rows are the same."""
    pairs = [(a, b) for a in range(3) for b in range(10, 13)]
    few, many = [(v, w) for v in (0, 2, 10, 12) for w in (100, 101)], range(200, 260)
    arcs = few + [(v, w) for w in many for v in {"a": range(10, 13), "b": range(3), "w": ()}[order]]
    if order == "w":
        arcs += [(v, w) for n, v in enumerate((0, 1, 2, 10, 11, 12)) for w in range(300 + 100 * n, 360 + 100 * n)]
    else:
        pairs += [(a, b) for a in range(20, 24) for b in range(30, 34)]
        arcs += [(v, 100) for v in (*range(20, 24), *range(30, 34))]
    there = {(s, d) for s, d in arcs}
    want = sorted((a, b, w) for a, b in pairs for w in {d for _, d in arcs} if (a, w) in there and (b, w) in there)
    left, right = spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(arcs, "src long, dst long")
    assert sorted(tuple(r) for r in graph.common_of_pairs(left, right).collect()) == want
    of_a, of_b = (right.toDF(x, "w").join(left.select(x).distinct(), x, "left_semi") for x in "ab")
    sizes = graph._rows_on_the_way(left, of_a, of_b)
    assert min(sizes, key=sizes.get) == order
