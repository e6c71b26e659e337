"""From a pattern and a mode to a DataFrame join tree.

A plan is a list of units. A unit is a relation over some pattern vertices (columns v<i>), with the validity interval of its
edges (ins, del) and how many matches a row stands for (weight), if these are asked for. Units cover the pattern's edges once:

- an edge: the view of its label triple;
- a star: edges from a new vertex to two or more bound ones, joined on that vertex first and then on all bound ones at once, where
  statistics say that this makes fewer rows than expanding along one edge and closing the others;
- a shared sub-pattern: matches of a symmetric sub-pattern found once for each set of symmetric copies, then turned out
  by its automorphisms;
- isomorphic sub-patterns: one written relation, renamed for each instance;
- twins: a four-cycle whose two middles are alike, where only counts are asked for and statistics say that its wedges are fewest: see twins.py;
- a block: what hangs on one vertex by labels found nowhere else, as counts by that vertex (and interval).

Units are joined on their common vertices; intervals are intersected, and rows with empty ones dropped, at each join.
Vertices are only compared where their labels are equal.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidgraph.functions.pattern import Pattern, automorphic_subpatterns, blocks, isomorphic_subpatterns
from braidgraph.functions.storage import materialize
from braidgraph.operators.graph import triple_view
from braidgraph.plans.twins import TwinRounds, find_twins, twin_rounds, worth_it

MODES = ("plain", "anchored", "shared_subpattern", "iso_subpattern", "factorised", "shared+factorised", "all")


#: Shuffled joins build hash tables instead of sorting where every partition of a side is below this (checked at run time).
HASH_SIDE = "64m"


def prepare(spark: SparkSession) -> None:
    """Session setting for closing cycles: one side is an edge view, unique in the join's keys and so without skew."""
    key = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    if spark.conf.get(key, "0").rstrip("bB") == "0":
        spark.conf.set(key, HASH_SIDE)


@dataclass
class Unit:
    """`covers`: numbers of the pattern edges that it stands for."""

    df: DataFrame
    vertices: tuple[int, ...]
    covers: frozenset[int]
    kind: str = "edge"


def _edges_within(p: Pattern, vertices) -> frozenset[int]:
    inside = set(vertices)
    return frozenset(i for i, (u, v, _) in enumerate(p.edges) if u in inside and v in inside)


def edge_unit(edges: DataFrame, p: Pattern, i: int, temporal: bool) -> Unit:
    u, v, k = p.edges[i]
    view = triple_view(edges, p.labels[u], k, p.labels[v], f"v{u}", f"v{v}")
    return Unit(view.select(f"v{u}", f"v{v}", *(("ins", "del") if temporal else ())), (u, v), frozenset((i,)))


def statistics(edges: DataFrame) -> dict[tuple[int, int, int], tuple[int, int, int]]:
    """(label, edge label, label) -> edges, vertices on the one and on the other side (about); kept with the DataFrame."""
    if not hasattr(edges, "_braidgraph_statistics"):
        rows = edges.groupBy("src_label", "elabel", "dst_label").agg(F.count("*").alias("n"), F.approx_count_distinct("src").alias("s"), F.approx_count_distinct("dst").alias("d")).collect()
        found: dict[tuple[int, int, int], tuple[int, int, int]] = {}
        for r in rows:
            found[r.src_label, r.elabel, r.dst_label] = (r.n, r.s, r.d)
            found.setdefault((r.dst_label, r.elabel, r.src_label), (r.n, r.d, r.s))
        edges._braidgraph_statistics = found
    return edges._braidgraph_statistics


def star_groups(edges: DataFrame, p: Pattern) -> list[frozenset[int]]:
    """Groups of edges worth joining on their new vertex first."""
    if len(p.edges) < 4 or all(len(p.adjacent[v]) < 2 for v in range(p.n)):
        return []
    known = statistics(edges)

    def out_degree(v: int, w: int) -> float:
        n, s, _ = known.get((p.labels[v], p.adjacent[v][w], p.labels[w]), (0, 1, 1))
        return n / max(1, s)

    order, groups = p.matching_order(), []
    first = known.get((p.labels[order[0]], p.adjacent[order[0]][order[1]], p.labels[order[1]]), (0, 1, 1))
    rows = float(first[0])
    for i, x in enumerate(order[2:], 2):
        near = [v for v in order[:i] if v in p.adjacent[x]]
        expand = rows * min(out_degree(v, x) for v in near)
        if len(near) > 1:
            n, s, _ = known.get((p.labels[x], p.adjacent[x][near[0]], p.labels[near[0]]), (0, 1, 1))
            star = float(s)
            for v in near:
                star *= out_degree(x, v)
            if star < expand / 2:
                groups.append(frozenset(e for e, (u, w, _) in enumerate(p.edges) if x in (u, w) and (u in near or w in near)))
            for v in near[1:]:
                n, s, d = known.get((p.labels[v], p.adjacent[v][x], p.labels[x]), (0, 1, 1))
                expand *= n / max(1, s * d)
        rows = max(1.0, expand)
    return groups


def join_units(p: Pattern, units: list[Unit], temporal: bool, weighted: bool = False, when: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All units joined in order of most common vertices with what is bound (ties: as listed)."""
    left = list(units[1:])
    df, bound = units[0].df, set(units[0].vertices)
    while left:
        unit = max(left, key=lambda x: len(bound & set(x.vertices)))
        left.remove(unit)
        common = sorted(bound & set(unit.vertices))
        if not common:
            raise ValueError("units don't hang together")
        extra = [c for c in ("ins", "del", "weight") if c in unit.df.columns]
        df = df.join(unit.df.withColumnsRenamed({c: f"__{c}" for c in extra}), [f"v{x}" for x in common])
        new = set(unit.vertices) - bound
        for a, b in p.same_label_pairs():
            if (a in new) != (b in new) and {a, b} <= bound | new and not {a, b} <= set(unit.vertices):
                df = df.where(F.col(f"v{a}") != F.col(f"v{b}"))
        bound |= new
        if temporal:
            df = df.withColumns({"ins": F.greatest("ins", "__ins"), "del": F.least("del", "__del")}).where("ins < del")
        if "__weight" in df.columns:
            df = df.withColumn("weight", F.col("weight") * F.col("__weight") if "weight" in df.columns else F.col("__weight"))
        df = df.drop(*[f"__{c}" for c in extra])
    if weighted and "weight" not in df.columns:
        df = df.withColumn("weight", F.lit(1).cast("long"))
    return when(df) if when else df


def _listed(p: Pattern, units: list[Unit]) -> list[Unit]:
    """Units in the pattern's own join order: larger shares first, then edges as the matching order takes them, blocks last."""
    place = {e: i for i, e in enumerate(p.edge_order())}
    return sorted(units, key=lambda x: (x.kind == "block", x.kind in ("edge", "star"), (max if x.kind == "star" else min)(place[e] for e in x.covers)))


def shared_unit(edges: DataFrame, p: Pattern, vertices: tuple[int, ...], autos: list[tuple[int, ...]], temporal: bool) -> Unit:
    """Matches of a symmetric sub-pattern: the least of each set of symmetric copies, then all copies from it."""
    sub = p.induced(vertices)
    found = match_table(edges, sub, temporal)
    ids = [f"v{i}" for i in range(sub.n)]
    for a in autos:
        if a != tuple(range(sub.n)):
            found = found.where(F.struct(*ids) <= F.struct(*[F.col(f"v{a[i]}").alias(f"v{i}") for i in range(sub.n)]))
    copies = F.array(*[F.struct(*[F.col(f"v{a[i]}").alias(f"w{vertices[i]}") for i in range(sub.n)]) for a in autos])
    turned = found.select(*(("ins", "del") if temporal else ()), F.inline(copies))
    return Unit(turned.withColumnsRenamed({f"w{v}": f"v{v}" for v in vertices}), vertices, _edges_within(p, vertices), "shared")


def iso_units(edges: DataFrame, p: Pattern, sets: list[tuple[int, ...]], temporal: bool) -> list[Unit]:
    """One written relation for all instances of a sub-pattern."""
    sub = p.induced(sets[0])
    found = materialize(edges.sparkSession, match_table(edges, sub, temporal), "isomorphic")
    renamed = [found.select(*[F.col(f"v{i}").alias(f"v{v}") for i, v in enumerate(s)], *(("ins", "del") if temporal else ())) for s in sets]
    return [Unit(df, s, _edges_within(p, s), "iso") for df, s in zip(renamed, sets, strict=True)]


def block_unit(edges: DataFrame, p: Pattern, entry: int, inner: tuple[int, ...], temporal: bool) -> Unit:
    """Counts of a block's matches by entry vertex (and interval): no later join needs its inner vertices."""
    vertices = (entry, *inner)
    found = match_table(edges, p.induced(vertices), temporal)
    counted = found.groupBy(F.col("v0").alias(f"v{entry}"), *(("ins", "del") if temporal else ())).agg(F.count("*").alias("weight"))
    return Unit(counted, (entry,), _edges_within(p, vertices), "block")


def counted_twins(edges: DataFrame, p: Pattern, temporal: bool, keep: frozenset[int] = frozenset()) -> TwinRounds | None:
    """Twins for a count of which only the vertices in `keep` are asked for, if it has any that save rows."""
    found = find_twins(p, keep)
    return twin_rounds(edges, p, found, temporal) if found and worth_it(p, found, statistics(edges)) else None


def units_for(edges: DataFrame, p: Pattern, mode: str, temporal: bool, twins: tuple[TwinRounds, int] | None = None) -> list[Unit]:
    """The units of a mode; what its analyses don't cover stays plain edges. `twins`: with a round of these."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    prepare(edges.sparkSession)
    units: list[Unit] = []
    taken: set[int] = set()
    hidden: set[int] = set()  # inner vertices of blocks

    def add(made: list[Unit]) -> None:
        for u in made:
            units.append(u)
            taken.update(u.covers)

    within: set[int] = set()  # vertices of twins
    if twins:
        t = twins[0].twins
        add([Unit(twins[0].part(twins[1]), t.ends, t.covers, "twins")])
        within = {t.a, t.b, t.x, t.y}
    if mode in ("factorised", "shared+factorised", "all"):
        for b in blocks(p):
            if within & set(b.inner):
                continue
            add([block_unit(edges, p, b.entry, b.inner, temporal)])
            hidden |= set(b.inner)
    if mode in ("iso_subpattern", "all"):
        for sets in isomorphic_subpatterns(p):
            if all(not set(s) & hidden and not _edges_within(p, s) & taken for s in sets):
                add(iso_units(edges, p, sets, temporal))
    if mode in ("shared_subpattern", "shared+factorised", "all"):
        for s, autos in automorphic_subpatterns(p):
            if not set(s) & hidden and not _edges_within(p, s) & taken:
                add([shared_unit(edges, p, s, autos, temporal)])
    for group in star_groups(edges, p):
        if not group & taken:
            parts = [edge_unit(edges, p, i, temporal) for i in sorted(group)]
            add([Unit(join_units(p, parts, temporal), tuple(sorted({v for u in parts for v in u.vertices})), group, "star")])
    add([edge_unit(edges, p, i, temporal) for i in range(len(p.edges)) if i not in taken])
    return _listed(p, units)


def match_table(edges: DataFrame, p: Pattern, temporal: bool, mode: str = "plain", weighted: bool = False, twins: tuple[TwinRounds, int] | None = None) -> DataFrame:
    """v0 .. v<n-1> (those that the mode keeps), then ins and del, then weight, as asked for; with twins, of one of their rounds."""
    return join_units(p, units_for(edges, p, mode, temporal, twins), temporal, weighted)


def explain(p: Pattern, mode: str = "plain") -> str:
    """The plan's units in words, for tests and logs."""
    lines = [f"{p.name}: {p.n} vertices, {len(p.edges)} edges, |Aut| = {len(p.automorphisms)}, order {p.matching_order()}"]
    if mode in ("factorised", "shared+factorised", "all"):
        lines += [f"block {b.inner} on {b.entry}" for b in blocks(p)]
    if mode in ("iso_subpattern", "all"):
        lines += [f"isomorphic {g}" for g in isomorphic_subpatterns(p)]
    if mode in ("shared_subpattern", "shared+factorised", "all"):
        lines += [f"shared {s} x {len(a)}" for s, a in automorphic_subpatterns(p)]
    return "\n".join(lines)
