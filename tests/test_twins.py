"""Four-cycles with two like middles, counted from packed wedges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidgraph import catalogue
from braidgraph.functions import storage
from braidgraph.functions.pattern import Pattern
from braidgraph.operators.stream import attach_updates
from braidgraph.plans import compiler, twins
from braidgraph.plans.match import continuous_match, static_count
from braidgraph.sources import testgraph
from tests import brute
from tests.test_matching import as_dict, tables

CYCLE = Pattern((0, 1, 1, 2), ((0, 1, 0), (0, 2, 0), (1, 3, 1), (2, 3, 1)))
WITH_TAIL = Pattern((0, 1, 1, 2, 3), ((0, 1, 0), (0, 2, 0), (1, 3, 1), (2, 3, 1), (0, 4, 0)))
CHORD = Pattern((0, 1, 1, 2), ((0, 1, 0), (0, 2, 0), (1, 3, 1), (2, 3, 1), (0, 3, 0)))
OUTER = Pattern((0, 1, 1, 2, 2), ((0, 1, 0), (0, 2, 0), (1, 3, 1), (2, 3, 1), (0, 4, 0)))
MODES = ("plain", "shared+factorised", "all")


def graph_of(seed):
    """Some edges from the start, and many changes: edges go and come again."""
    rng = random.Random(seed)
    labels = {v: 0 if v < 3 else 1 if v < 8 else 2 if v < 11 else 3 for v in range(13)}
    pairs = [(u, v, k) for u in range(13) for v in range(u) for k in range(2) if labels[u] != labels[v]]
    return labels, rng.sample(pairs, 70), [(rng.choice("+-"), *rng.choice(pairs)) for _ in range(60)]


@pytest.mark.parametrize("p", [CYCLE, WITH_TAIL, CHORD, OUTER], ids=["cycle", "tail", "chord", "outer"])
@pytest.mark.parametrize("small", [False, True], ids=["one round", "rounds and small blobs"])
def test_counts(spark, monkeypatch, p, small):
    """Counts of every update and of each vertex are those of a replay and of plain joins."""
    monkeypatch.setattr(compiler, "worth_it", lambda *_: True)
    labels, initial, updates = graph_of(p.n)
    start, log = tables(spark, labels, initial, updates)
    instances = attach_updates(start, log).persist()
    want = brute.replay(labels, initial, [(i, *u) for i, u in enumerate(updates, 1)], p)
    plain = {by: sorted(tuple(r) for r in compiler.match_table(start, p, False).groupBy(f"v{by}").count().collect()) for by in (0, 1, 3)}
    assert want and plain[0]
    if small:
        for name, n in (("EDGES_A_TASK", 20), ("WEDGES_A_TASK", 10), ("PAIRS_AT_ONCE", 3), ("ENTRIES_AN_EDGE", 0), ("ENTRIES_AN_INTERVAL_EDGE", 0), ("ENTRIES_A_ROUND", 8)):
            monkeypatch.setattr(twins, name, n)
        assert compiler.counted_twins(instances, p, True).rounds > 1
    for mode in MODES[:1] if small else MODES:
        assert as_dict(continuous_match(instances, p, mode)) == want, mode
    for by, rows in plain.items():
        assert sorted(tuple(r) for r in static_count(start, p, by).collect()) == rows
    assert static_count(start, p).first().matches == sum(n for _, n in plain[0])
    assert static_count(start.limit(0), p).first().matches == 0


def test_packing():
    end = np.iinfo(np.int64).max
    for rows in ([], [end], [end, end], [5], [-3, 7, end], [0, 2**40], [-(2**62), 2**62], [2**31, 2**31 + 255]):
        values = np.array(rows, np.int64)
        assert twins._unpacked(twins._packed(values)).tolist() == rows
    keys = np.array([3, 1, 2**61, 1], np.int64)
    assert keys[twins._order(keys)].tolist() == keys[twins._order(keys[:])].tolist() == sorted(keys.tolist())
    assert twins._order(keys[:2]).tolist() == [1, 0]


@pytest.mark.parametrize("name", ["csm_combined", "csm_same_supplier", "match_shared", "match_same_supplier", "csm_shared"])
def test_queries_shuffle_no_row_a_pair(spark, name):
    """No join of the order's pairs of parts to all suppliers of one: wedges stay packed and in their tasks."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3 and plan.count("Join") <= (1 if name == "csm_combined" else 0)


def test_twins_only_where_they_are_hidden_and_fewer(spark):
    assert twins.find_twins(CYCLE, frozenset((1,))) is None and twins.find_twins(catalogue.SQUARE, frozenset()) is None
    assert twins.find_twins(OUTER, frozenset()).ends == (0, 3) and twins.find_twins(CYCLE, frozenset((3,))).ends == (3,)
    edges = testgraph.edges(spark, "/root/testdata/sf0.01")
    assert compiler.counted_twins(edges, catalogue.SAME_SUPPLIER, False) is not None
    some = edges.where(F.col("elabel") != 3)
    assert compiler.counted_twins(some, catalogue.SAME_SUPPLIER, False) is None


def test_updates_leave_one_copy(spark, tmp_path, monkeypatch):
    """The rows that were numbered go from the shared folder when their numbers are written."""
    monkeypatch.setattr(testgraph, "_written", {})
    monkeypatch.setattr(storage, "shared_dir", lambda _: str(tmp_path))
    n = testgraph.updates(spark, "/root/testdata/sf0.001").count()
    assert n == testgraph.updates(spark, "/root/testdata/sf0.001").count() > 0 and len(list(tmp_path.glob("table-*"))) == 1
