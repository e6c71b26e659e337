"""Matching: static, continuous over a bounded history, enumerated, capped, with bound vertices."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidgraph.functions.pattern import Pattern
from braidgraph.functions.storage import materialize
from braidgraph.operators.graph import triple_view
from braidgraph.operators.stream import FOREVER
from braidgraph.plans.compiler import counted_twins, edge_unit, join_units, match_table


def static_match(edges: DataFrame, p: Pattern, bound: dict[int, int] | None = None) -> DataFrame:
    """Every match (v0 .. v<n-1>) in a graph; `bound` fixes pattern vertices, which filters every view that holds them."""
    units = [edge_unit(edges, p, i, False) for i in p.edge_order()]
    for v, x in (bound or {}).items():
        for u in units:
            if v in u.vertices:
                u.df = u.df.where(F.col(f"v{v}") == x)
    return join_units(p, units, False).select(*[f"v{i}" for i in range(p.n)])


def static_count(edges: DataFrame, p: Pattern, by: int | None = None, mode: str = "plain") -> DataFrame:
    """Number of matches, in all or for each data vertex that pattern vertex `by` maps to."""
    total = F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("matches")
    keys = [] if by is None else [F.col(f"v{by}").alias("id")]
    return _counted(edges, p, False, mode, frozenset() if by is None else frozenset((by,)), lambda found: found.groupBy(*keys).agg(total))


def _counted(edges: DataFrame, p: Pattern, temporal: bool, mode: str, keep: frozenset[int], summed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """summed(matches), where `summed` gives `matches` by other columns. Where the plan has rounds, each is summed and written before the next
    starts, so that what one has on disk goes; the rounds share out one vertex's data vertices, so every match is in one of them."""
    twins = counted_twins(edges, p, temporal, keep)
    if twins is None or twins.rounds == 1:
        return summed(match_table(edges, p, temporal, mode, True, twins and (twins, 0)))
    parts = [materialize(edges.sparkSession, summed(match_table(edges, p, temporal, mode, True, (twins, n))), f"round-{n}") for n in range(twins.rounds)]
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy(*[c for c in both.columns if c != "matches"]).agg(F.sum("matches").cast("long").alias("matches"))


def enumerate_matches(edges: DataFrame, p: Pattern, most: int) -> DataFrame:
    """The first `most` matches in the order of their vertices."""
    ids = [f"v{i}" for i in range(p.n)]
    return static_match(edges, p).orderBy(*ids).limit(most)


def _by_update(found: DataFrame) -> DataFrame:
    """(update_id, op, matches) of matches with validity: gained at ins, lost at del."""
    events = F.array(F.struct(F.col("ins").alias("update_id"), F.lit("+").alias("op")), F.struct(F.col("del").alias("update_id"), F.lit("-").alias("op")))
    turned = found.select("weight", F.inline(events)).where((F.col("update_id") > 0) & (F.col("update_id") < FOREVER))
    return turned.groupBy("update_id", "op").agg(F.sum("weight").cast("long").alias("matches"))


def edge_orbits(p: Pattern) -> list[list[int]]:
    """Pattern edges (by number) that automorphisms turn into each other."""
    number = {(u, v): i for i, (u, v, _) in enumerate(p.edges)}
    left, orbits = list(range(len(p.edges))), []
    while left:
        u, v, _ = p.edges[left[0]]
        orbit = sorted({number[min(a[u], a[v]), max(a[u], a[v])] for a in p.automorphisms})
        orbits.append(orbit)
        left = [i for i in left if i not in orbit]
    return orbits


def _anchored(instances: DataFrame, p: Pattern, anchor: int, op: str) -> DataFrame:
    """(update_id, weight) of matches whose edge `anchor` is the last one inserted, or the first one deleted."""
    u, v, k = p.edges[anchor]
    at = "ins" if op == "+" else "del"
    view = triple_view(instances, p.labels[u], k, p.labels[v], f"v{u}", f"v{v}")
    df = view.where((F.col(at) > 0) & (F.col(at) < FOREVER)).select(f"v{u}", f"v{v}", F.col(at).alias("update_id"))
    bound = {u, v}
    for i in p.edge_order((u, v)):
        if i == anchor:
            continue
        unit = edge_unit(instances, p, i, True)
        common = [f"v{x}" for x in sorted(bound & set(unit.vertices))]
        df = df.join(unit.df, common).where((F.col("ins") < F.col("update_id")) & (F.col("del") > F.col("update_id"))).drop("ins", "del")
        for x in set(unit.vertices) - bound:
            for y in bound:
                if p.labels[x] == p.labels[y]:
                    df = df.where(F.col(f"v{x}") != F.col(f"v{y}"))
        bound |= set(unit.vertices)
    return df.select("update_id", F.lit(op).alias("op"))


def continuous_match(instances: DataFrame, p: Pattern, mode: str = "plain", limit: int | None = None) -> DataFrame:
    """(update_id, op, matches) for all updates that gain or lose matches; all modes give the same rows.

    "anchored" evaluates one edge of each orbit from the changed edges outwards and multiplies by the orbit's
    size: for few changes against a large graph. The others are one join of all instances. `limit` caps matches.
    """
    if mode == "anchored":
        parts = [_anchored(instances, p, orbit[0], op).groupBy("update_id", "op").agg((F.count("*") * len(orbit)).alias("matches")) for orbit in edge_orbits(p) for op in "+-"]
        out = reduce(DataFrame.unionByName, parts).groupBy("update_id", "op").agg(F.sum("matches").cast("long").alias("matches"))
    else:
        out = _counted(instances, p, True, mode, frozenset(), _by_update)
    return out if limit is None else out.withColumn("matches", F.least("matches", F.lit(limit)))


def continuous_matches(instances: DataFrame, p: Pattern) -> DataFrame:
    """The matches themselves (v0 .. v<n-1>) with the updates that bring and end them."""
    return match_table(instances, p, True).select(*[f"v{i}" for i in range(p.n)], "ins", "del")
