import random

import pytest
from pyspark.sql import functions as F

from braidgraph.functions.pattern import Pattern
from braidgraph.operators import graph
from braidgraph.operators.stream import FOREVER, attach_updates, candidate_flips, counters, relevant, running_size
from braidgraph.plans.compiler import MODES, explain, units_for
from braidgraph.plans.match import continuous_match, continuous_matches, enumerate_matches, static_count, static_match
from braidgraph.streaming.driver import UPDATES, ContinuousMatcher, run_stream
from braidgraph.streaming.progress import save_costs
from tests import brute
from tests.test_pattern import random_pattern

EDGE = "src long, dst long, elabel int, src_label int, dst_label int"
TRIANGLE_ONE_LABEL = ((0, 0, 0), ((0, 1, 0), (1, 2, 0), (0, 2, 0)))
SQUARE_ONE_LABEL = ((0, 0, 0, 0), ((0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 3, 0)))
#: name -> vertex labels, edges at the start, updates, pattern, matches of each update
FIXTURES = {
    "distinct labels": ({0: 0, 1: 1, 2: 2, 3: 2}, [(0, 1, 0), (1, 2, 0), (1, 3, 0)], [("+", 0, 2, 0), ("+", 0, 3, 0), ("-", 0, 1, 0)], ((0, 1, 2), ((0, 1, 0), (1, 2, 0), (0, 2, 0))), [1, 1, 2]),
    "one label": (dict.fromkeys(range(6), 0), [(0, 1, 0), (1, 2, 0)], [("+", 0, 2, 0), ("+", 0, 3, 0), ("+", 1, 3, 0), ("-", 0, 1, 0)], TRIANGLE_ONE_LABEL, [6, 0, 6, 12]),
    "wedge": ({0: 0, 1: 1, 2: 0, 3: 0}, [(0, 1, 0)], [("+", 1, 2, 0), ("+", 1, 3, 0), ("-", 0, 1, 0)], ((0, 1, 0), ((0, 1, 0), (1, 2, 0))), [2, 4, 4]),
    "square": (dict.fromkeys(range(6), 0), [(0, 1, 0), (1, 2, 0), (2, 3, 0)], [("+", 0, 3, 0), ("+", 1, 4, 0), ("+", 3, 4, 0), ("-", 0, 1, 0)], SQUARE_ONE_LABEL, [8, 0, 16, 16]),
    "not induced": (dict.fromkeys(range(6), 0), [(0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 3, 0), (0, 2, 0)], [("+", 1, 3, 0)], SQUARE_ONE_LABEL, [16]),
    "edge labels": ({0: 0, 1: 1, 2: 0, 3: 0}, [(0, 1, 0), (1, 2, 1)], [("+", 1, 3, 1), ("+", 1, 3, 0)], ((0, 1, 0), ((0, 1, 0), (1, 2, 1))), [1, 1]),
    "pendant": ({0: 0, 1: 1, 2: 2, 10: 3, 11: 3, 12: 4, 13: 4, 14: 4}, [(0, 1, 0), (1, 2, 0), (2, 10, 0), (2, 11, 0), (2, 12, 0), (2, 13, 0)], [("+", 0, 2, 0), ("+", 2, 14, 0), ("-", 2, 10, 0)], ((0, 1, 2, 3, 4), ((0, 1, 0), (1, 2, 0), (0, 2, 0), (2, 3, 0), (2, 4, 0))), [4, 2, 3]),
    "star": ({0: 1, 1: 0, 2: 0, 3: 0, 4: 0}, [(0, 1, 0), (0, 2, 0)], [("+", 0, 3, 0), ("+", 0, 4, 0)], ((1, 0, 0, 0), ((0, 1, 0), (0, 2, 0), (0, 3, 0))), [6, 18]),
    "present and missing edges": ({0: 0, 1: 1, 2: 0}, [(0, 1, 0)], [("+", 1, 0, 0), ("-", 1, 2, 0), ("+", 1, 2, 0), ("+", 1, 9, 0)], ((0, 1, 0), ((0, 1, 0), (1, 2, 0))), [0, 0, 2, 0]),
    "two vertices": ({0: 0, 1: 0}, [], [("+", 0, 1, 0), ("-", 0, 1, 0)], ((0, 0), ((0, 1, 0),)), [2, 2]),
    "unknown label": ({0: 0, 1: 1}, [], [("+", 0, 1, 0)], ((7, 1), ((0, 1, 0),)), [0]),
}


def tables(spark, labels, initial, updates):
    of = lambda v: labels.get(v, 99)
    rows = [(min(u, v), max(u, v), k, of(min(u, v)), of(max(u, v))) for u, v, k in initial]
    log = [(i, op, u, v, k, of(u), of(v)) for i, (op, u, v, k) in enumerate(updates, 1)]
    return spark.createDataFrame(rows, EDGE), spark.createDataFrame(log, UPDATES)


def as_dict(df):
    return {(r.update_id, r.op): r.matches for r in df.collect()}


@pytest.mark.parametrize("name", FIXTURES)
def test_fixtures_in_all_modes(spark, name):
    labels, initial, updates, pattern, expected = FIXTURES[name]
    p = Pattern(*pattern)
    instances = attach_updates(*tables(spark, labels, initial, updates)).persist()
    want = {(i, u[0]): n for i, (u, n) in enumerate(zip(updates, expected, strict=True), 1) if n}
    for mode in MODES:
        assert as_dict(continuous_match(instances, p, mode)) == want, mode


@pytest.mark.parametrize("seed", range(6))
def test_random_streams(spark, seed):
    rng = random.Random(seed)
    p = random_pattern(rng, 3 + seed % 3)
    labels = {v: rng.randrange(2) for v in range(7)}
    pairs = [(u, v, k) for u in range(7) for v in range(u) for k in range(2)]
    initial = rng.sample(pairs, 12)
    updates = [(rng.choice("+-"), *rng.choice(pairs)) for _ in range(40)]
    want = brute.replay(labels, initial, [(i, *u) for i, u in enumerate(updates, 1)], p)
    start, log = tables(spark, labels, initial, updates)
    instances = attach_updates(start, log).persist()
    for mode in MODES:
        assert as_dict(continuous_match(instances, p, mode)) == want, (mode, p)
    end = static_count(instances.where(F.col("del") == FOREVER), p).first().matches
    begin = static_count(start, p).first().matches
    assert end - begin == sum(n if op == "+" else -n for (_, op), n in want.items())


def test_error_policy(spark):
    start, log = tables(spark, {0: 0, 1: 1}, [(0, 1, 0)], [("+", 0, 1, 0)])
    with pytest.raises(Exception, match="in that state already"):
        attach_updates(start, log, "error").collect()


def test_cap_counters_sizes(spark):
    labels, initial, updates, pattern, _ = FIXTURES["one label"]
    p = Pattern(*pattern)
    start, log = tables(spark, labels, initial, updates)
    instances = attach_updates(start, log)
    assert as_dict(continuous_match(instances, p, limit=5)) == {(1, "+"): 5, (3, "+"): 5, (4, "-"): 5}
    row = counters(spark, log, continuous_match(instances, p), p).first()
    assert (row.processed, row.relevant, row.with_matches, row.gained, row.lost) == (4, 4, 3, 12, 12)
    assert [r.size for r in running_size(log, start).orderBy("update_id").collect()] == [3, 4, 5, 4]
    assert relevant(spark, log, Pattern((0, 1), ((0, 1, 0),))).count() == 0
    assert continuous_matches(instances, p).count() == 12


def test_static_enumerate_bound(spark):
    labels, initial, _, _, _ = FIXTURES["not induced"]
    start, _ = tables(spark, labels, initial, [])
    p = Pattern(*TRIANGLE_ONE_LABEL)
    assert static_match(start, p).count() == 12
    assert [tuple(r) for r in enumerate_matches(start, p, 2).collect()] == [(0, 1, 2), (0, 2, 1)]
    assert static_match(start, p, {0: 3}).count() == 2
    assert static_match(start, p, {0: 3, 1: 3}).count() == 0
    assert {r.id: r.matches for r in static_count(start, p, by=0).collect()} == {0: 4, 1: 2, 2: 4, 3: 2}


@pytest.mark.parametrize("per_batch", [1, 3, 40])
def test_stream_equals_bounded_run(spark, tmp_path, per_batch):
    rng = random.Random(5)
    p = Pattern((0, 1, 0), ((0, 1, 0), (1, 2, 0)))
    labels = {v: v % 2 for v in range(6)}
    pairs = [(u, v, 0) for u in range(6) for v in range(u) if u % 2 != v % 2]
    start, log = tables(spark, labels, pairs[:3], [(rng.choice("+-"), *rng.choice(pairs)) for _ in range(12)])
    want = as_dict(continuous_match(attach_updates(start, log), p))
    matcher = ContinuousMatcher(spark, start, p, str(tmp_path / f"run{per_batch}"))
    source = tmp_path / f"in{per_batch}"
    for n in range(0, 12, per_batch):
        log.where((F.col("update_id") > n) & (F.col("update_id") <= n + per_batch)).coalesce(1).write.mode("append").parquet(str(source))
        matcher.start(spark.readStream.schema(UPDATES).parquet(str(source))).awaitTermination()
    assert as_dict(matcher.results()) == want
    matcher.process(log.limit(0), max(matcher._batches("results")))  # a repeated batch replaces its own results
    assert len(matcher._batches("state")) <= 2


def test_stream_state_is_compacted(spark, tmp_path):
    """Tables and changes in turn, a repeated batch in the middle of the stream, state alone, and the costs of all batches."""
    rng = random.Random(6)
    p = Pattern((0, 1, 0), ((0, 1, 0), (1, 2, 0)))
    labels = {v: v % 2 for v in range(7)}
    pairs = [(u, v, k) for u in range(7) for v in range(u) if u % 2 != v % 2 for k in (0, 1)]
    start, log = tables(spark, labels, pairs[:4], [(rng.choice("+-"), *rng.choice(pairs)) for _ in range(15)])
    instances = attach_updates(start, log)
    matcher = ContinuousMatcher(spark, start, p, str(tmp_path / "run"), compact=2)
    views = ContinuousMatcher(spark, start, p, str(tmp_path / "views"), compact=100, view_only=True)
    for n in range(5):
        part = log.where(F.col("update_id").between(3 * n + 1, 3 * n + 3))
        for _ in range(1 + (n == 3)):
            matcher.process(part, n)
        views.process(part, n)
    assert as_dict(matcher.results()) == as_dict(continuous_match(instances, p))
    want = sorted((r.src, r.dst, r.elabel, r.src_label, r.dst_label) for r in instances.where(f"del = {FOREVER}").collect())
    for m in (matcher, views):
        assert sorted(tuple(r) for r in m.present().collect()) == want
        assert sorted((r.batch, r.rows) for r in m.costs().collect()) == [(n, 3) for n in range(5)]
    assert len(matcher._batches("state")) == 2 and views._batches("results") == []


@pytest.mark.parametrize("seed", [1])
def test_large_patterns(spark, seed):
    """More vertices than symmetries are searched for, against a plain count."""
    rng = random.Random(seed)
    labels = {v: v for v in range(14)} | {20 + v: v for v in range(14)}
    p = Pattern(tuple(range(14)), tuple((rng.randrange(max(0, v - 3), v), v, 0) for v in range(1, 14)) + ((0, 13, 0),))
    initial = [(u + 20 * rng.randrange(2), v + 20 * rng.randrange(2), 0) for u, v, _ in p.edges for _ in range(3)]
    updates = [(rng.choice("+-"), *rng.choice(initial)) for _ in range(6)] + [("+", u, v, 0) for u, v, _ in p.edges]
    start, log = tables(spark, labels, sorted({(min(u, v), max(u, v), k) for u, v, k in initial}), updates)
    want = brute.replay(labels, initial, [(i, *u) for i, u in enumerate(updates, 1)], p)
    instances = attach_updates(start, log)
    for mode in ("plain", "anchored", "all"):
        assert as_dict(continuous_match(instances, p, mode)) == want, mode


@pytest.mark.parametrize("seed", range(4))
def test_pruned_candidates(spark, seed):
    """Rounds of semi-joins over patterns with and without cycles against a plain fixed point; matches keep their vertices."""
    rng = random.Random(seed)
    p = random_pattern(rng, 3 + seed % 3)
    labels = {v: rng.randrange(2) for v in range(9)}
    edges = sorted({(min(a, b), max(a, b), rng.randrange(2)) for a, b in (rng.sample(range(9), 2) for _ in range(18))})
    start, _ = tables(spark, labels, edges, [])
    near = {(u, k, v) for u, v, k in edges} | {(v, k, u) for u, v, k in edges}
    now = {q: {v for v in labels if labels[v] == p.labels[q]} for q in range(p.n)}
    states = []
    while True:
        after = {q: {v for v in now[q] if all(any((v, k, w) in near for w in now[x]) for x, k in p.adjacent[q].items())} for q in range(p.n)}
        states.append({(q, v) for q in after for v in after[q]})
        if after == now:
            break
        now = after
    for rounds in (1, 2, None):
        got = {(r.qv, r.id) for r in graph.prune_candidates(spark, start, p, rounds).collect()}
        assert got == (states[-1] if rounds is None else states[min(rounds, len(states)) - 1])
    for r in static_match(start, p).collect():
        assert {(q, r[q]) for q in range(p.n)} <= states[-1]


def test_candidates_and_flips(spark):
    rng = random.Random(2)
    p = Pattern((0, 1, 0), ((0, 1, 0), (1, 2, 0)))
    labels = {v: v % 2 for v in range(6)}
    pairs = [(u, v, 0) for u in range(6) for v in range(u) if u % 2 != v % 2]
    updates = [(rng.choice("+-"), *rng.choice(pairs)) for _ in range(30)]
    start, log = tables(spark, labels, pairs[:3], updates)
    flips = sorted((r.update_id, r.qv, r.id, r.gained) for r in candidate_flips(spark, attach_updates(start, log), p).collect())
    edges = {tuple(sorted(e[:2])) for e in pairs[:3]}

    def now():
        degree = {v: sum(v in e for e in edges) for v in labels}
        return {(q, v) for q in range(3) for v in labels if labels[v] == p.labels[q] and degree[v] >= len(p.adjacent[q])}

    want, before = [], now()
    found = {(r.qv, r.id) for r in graph.candidates(spark, graph.both_ways(start), p).collect()}
    assert found == before
    for i, (op, u, v, _) in enumerate(updates, 1):
        (edges.add if op == "+" else edges.discard)(tuple(sorted((u, v))))
        after = now()
        want += [(i, *x, True) for x in after - before] + [(i, *x, False) for x in before - after]
        before = after
    assert flips == sorted(want)


def test_core_numbers_and_offsets(spark):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(90)}
    edges = spark.createDataFrame([(u, v, 0, 0, 0) for u, v in pairs], EDGE)
    arcs = graph.both_ways(edges)
    left, want, k = {v: {w for e in pairs for w in e if v in e and w != v} for v in range(25)}, {}, 0
    left = {v: n for v, n in left.items() if n}
    while left:
        v = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[v]))
        want[v] = k
        for w in left.pop(v):
            left[w].discard(v)
    assert {r.id: r.core for r in graph.core_numbers(spark, arcs).collect()} == want
    at = 0
    for r in graph.degree_offsets(spark, arcs).orderBy("id").collect():
        assert r.offset == at
        at += r.degree


def test_explain_names_units():
    assert "block (4,) on 0" in explain(Pattern((6, 5, 5, 4, 3), ((0, 1, 2), (0, 2, 2), (1, 3, 3), (2, 3, 3), (0, 4, 1))), "all")


def test_stars_are_joined_first_where_they_are_small(spark):
    """A square over few-edged centres: the closing vertex comes as one star, and counts stay those of a plain version."""
    rng = random.Random(8)
    labels = {v: 0 for v in range(30)} | {v: 1 for v in range(30, 90)}
    pairs = {(rng.randrange(6) if rng.random() < 0.7 else rng.randrange(30), v, 0) for v in range(30, 90) for _ in range(2)}
    start, _ = tables(spark, labels, sorted(pairs), [])
    p = Pattern((0, 1, 0, 1), ((0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 3, 0)))
    kinds = [u.kind for u in units_for(start, p, "plain", False)]
    assert kinds == ["edge", "edge", "star"]
    edges = {}
    for u, v, k in pairs:
        edges.setdefault((u, v), set()).add(k)
    assert static_count(start, p).first().matches == brute.count(labels, edges, p)


def test_costs_and_folder_stream(spark, tmp_path):
    p = Pattern((0, 1), ((0, 1, 0),))
    start, log = tables(spark, {0: 0, 1: 1, 2: 1}, [], [("+", 0, 1, 0), ("+", 0, 2, 0), ("-", 0, 1, 0)])
    log.repartition(3, "update_id").write.parquet(str(tmp_path / "in"))
    results = run_stream(spark, str(tmp_path / "in"), start, p, str(tmp_path / "run"), files_per_batch=100)
    assert as_dict(results) == {(1, "+"): 1, (2, "+"): 1, (3, "-"): 1}
    again = ContinuousMatcher(spark, start, p, str(tmp_path / "run")).start(spark.readStream.schema(UPDATES).parquet(str(tmp_path / "in")))
    again.awaitTermination()
    assert as_dict(results) == {(1, "+"): 1, (2, "+"): 1, (3, "-"): 1}  # nothing new: nothing changes
    matcher = ContinuousMatcher(spark, start, p, str(tmp_path / "other"))
    query = matcher.start(spark.readStream.schema(UPDATES).parquet(str(tmp_path / "in")))
    query.awaitTermination()
    save_costs(spark, query, str(tmp_path / "costs"))
    assert spark.read.parquet(str(tmp_path / "costs")).agg(F.sum("rows")).first()[0] == 3


def test_neighbour_maps_and_intersections(spark):
    start, _ = tables(spark, {0: 0, 1: 1, 2: 1, 3: 0}, [(0, 1, 0), (0, 2, 0), (3, 1, 0)], [])
    arcs = graph.both_ways(start)
    assert {r.id: r.neighbours for r in graph.neighbour_map(arcs).collect()} == {0: {1: 2}, 1: {0: 2}, 2: {0: 1}, 3: {1: 1}}
    pairs = spark.createDataFrame([(0, 3), (1, 2)], "a long, b long")
    assert {(r.a, r.b): r.common for r in graph.intersect_adjacency(pairs, arcs).collect()} == {(0, 3): [1], (1, 2): [0]}
    assert graph.edge_exists(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"), arcs, True).count() == 1
