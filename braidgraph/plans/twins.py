"""Twins of a pattern: two vertices of one label with the same two neighbours, a four-cycle a - x - b - y, counted without joining pairs to lists.

A match of the four-cycle is two wedges a - x - b with the same ends and different middles, and both middles have the same wedges.
So the wedges are made once. They are never rows of a shuffle: edges are dealt out by middle vertex as packed arrays, each edge to an `a`
goes on to its `a` with its middle's packed list of `b`, and wedges are spelled out, matched and counted only there. What a count doesn't need
(x, y, and ends that nothing else touches) stays in there. Packed lists are still as many entries as there are wedges; rounds over
hashed `a` bound what is on disk at once, in proportion to the edges.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidgraph.functions.pattern import Pattern
from braidgraph.operators.graph import triple_view

#: Edges that a task takes in by middle vertex, wedges that it spells out, pairs of wedges that it holds at once.
EDGES_A_TASK, WEDGES_A_TASK, PAIRS_AT_ONCE = 1_000_000, 1_500_000, 2_000_000
#: Entries of packed lists in one round: as many an edge (an entry has about 2 bytes, with its interval 6), and so many in any case.
ENTRIES_AN_EDGE, ENTRIES_AN_INTERVAL_EDGE, ENTRIES_A_ROUND = 8, 2, 20_000_000

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the repository on their path


@dataclass(frozen=True)
class Twins:
    """Ends a and b, middles x and y (all pattern vertices); `ends`: those of a and b that stay columns."""

    a: int
    b: int
    x: int
    y: int
    ends: tuple[int, ...]
    covers: frozenset[int]


def find_twins(p: Pattern, keep: frozenset[int]) -> Twins | None:
    """The first twins of a pattern with ends of two labels, and with middles that no other vertex shares a label with and that nobody asks for."""
    for x, y in p.same_label_pairs():
        if p.adjacent[x] != p.adjacent[y] or len(p.adjacent[x]) != 2 or p.labels.count(p.labels[x]) != 2 or {x, y} & keep:
            continue
        a, b = sorted(p.adjacent[x])
        if p.labels[a] == p.labels[b]:
            continue
        covers = frozenset(i for i, (u, v, _) in enumerate(p.edges) if {u, v} & {x, y})
        needed = {v for i, (u, w, _) in enumerate(p.edges) if i not in covers for v in (u, w)} | keep
        return Twins(a, b, x, y, tuple(v for v in (a, b) if v in needed or p.labels.count(p.labels[v]) > 1), covers)
    return None


def worth_it(p: Pattern, t: Twins, known: dict[tuple[int, int, int], tuple[int, int, int]]) -> bool:
    """Are the wedges fewer than half of the rows that joins from either end make (statistics as in compiler.statistics)?"""
    def view(v: int) -> tuple[float, float, float]:
        n, ends, middles = known.get((p.labels[v], p.adjacent[v][t.x], p.labels[t.x]), (0, 1, 1))
        return n, n / max(1, ends), n / max(1, middles)  # edges, middles an end, ends a middle

    (na, from_a, to_a), (nb, from_b, to_b) = view(t.a), view(t.b)
    pairs_a, pairs_b = na * from_a, nb * from_b
    return na * to_b < min(pairs_a * to_b, pairs_b * to_a, max(pairs_a, pairs_b)) / 2


@dataclass
class TwinRounds:
    """Twins on a graph: views by middle vertex, sizes, rounds."""

    twins: Twins
    of_a: DataFrame
    of_b: DataFrame
    temporal: bool
    edges: int
    wedges: int
    rounds: int

    def part(self, this: int) -> DataFrame:
        """Of the matches with `a` in this round: columns v<end> of ends that stay, ins and del, weight."""
        t, names = self.twins, (["ins", "del"] if self.temporal else [])
        of_a = self.of_a if self.rounds == 1 else self.of_a.where(F.pmod(F.xxhash64("end"), F.lit(self.rounds)) == this)
        both = of_a.withColumn("side", F.lit(0)).union(self.of_b.withColumn("side", F.lit(1)))
        tasks = max(1, self.edges // EDGES_A_TASK), max(1, -(-self.wedges // (WEDGES_A_TASK * self.rounds)))
        kept = (t.a in t.ends, t.b in t.ends)
        columns = [f"v{v}" for v in t.ends] + names + ["weight"]
        blobs = "part int, data binary"
        dealt = both.mapInArrow(_deal(tasks[0], self.temporal), blobs).repartitionById(tasks[0], F.col("part"))
        lists = dealt.mapInArrow(_lists(tasks[1], self.temporal), blobs).repartitionById(tasks[1], F.col("part"))
        return lists.mapInArrow(_pairs(kept, self.temporal, columns), ", ".join(f"{c} long" for c in columns))


def twin_rounds(edges: DataFrame, p: Pattern, t: Twins, temporal: bool) -> TwinRounds:
    """Views and exact sizes: wedges are counted from the degrees of the middles."""
    def view(v: int) -> DataFrame:
        one = triple_view(edges, p.labels[t.x], p.adjacent[v][t.x], p.labels[v], "middle", "end")
        return one.select("middle", "end", *(("ins", "del") if temporal else ()))

    of_a, of_b = view(t.a), view(t.b)
    degrees = of_a.select("middle", F.lit(1).alias("m"), F.lit(0).alias("n")).union(of_b.select("middle", F.lit(0), F.lit(1))).groupBy("middle").agg(F.sum("m").alias("m"), F.sum("n").alias("n"))
    size = degrees.agg(F.coalesce(F.sum(F.col("m") + F.col("n")), F.lit(0)).alias("edges"), F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0)).alias("wedges")).first()
    rounds = max(1, -(-size.wedges // max(ENTRIES_A_ROUND, (ENTRIES_AN_INTERVAL_EDGE if temporal else ENTRIES_AN_EDGE) * size.edges)))
    return TwinRounds(t, of_a, of_b, temporal, size.edges, size.wedges, rounds)


# ---- inside the tasks

def _spread(ids: np.ndarray, n: int) -> np.ndarray:
    """A task number below n of each id."""
    h = ids.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) % np.uint64(n)).astype(np.int64)


def _packed(values: np.ndarray) -> tuple:
    """int64 values above their least in as few bytes as hold them; the largest possible one (an edge that stays) is coded apart."""
    if not len(values):
        return 0, None, values.astype(np.uint8)
    last, end = None, np.iinfo(np.int64).max
    open_ = values == end
    if open_.any():
        rest = values[~open_]
        if not len(rest):
            return end, None, len(values)
        last = int(rest.max()) + 1
        values = np.where(open_, last, values)
    low = int(values.min())
    span = int(values.max()) - low
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if span <= np.iinfo(k).max)
    return low, last, (values.astype(np.uint64) - np.uint64(low % 2**64)).astype(kind)


def _unpacked(packed: tuple) -> np.ndarray:
    low, last, small = packed
    if isinstance(small, int):
        return np.full(small, low, np.int64)
    out = (small.astype(np.uint64) + np.uint64(low % 2**64)).astype(np.int64)
    return out if last is None else np.where(out == last, np.iinfo(np.int64).max, out)


def _blob(part: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    data = pickle.dumps([_packed(x) for x in arrays], protocol=5)
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["part", "data"])


def _unblob(batches) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for data in batch.column(1):
            yield [_unpacked(x) for x in pickle.loads(data.as_py())]  # noqa: S301 (written by _blob)


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1 of all i in a row."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _deal(parts: int, temporal: bool):
    """Edges to tasks by middle vertex, packed: [side, middle, end, ins, del]."""
    names = ["side", "middle", "end", *(("ins", "del") if temporal else ())]

    def out(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        part = _spread(columns[1], parts)
        order = np.lexsort((columns[1], columns[0], part))
        columns, cuts = [c[order] for c in columns], np.searchsorted(part[order], np.arange(parts + 1))
        for n in range(parts):
            if cuts[n] < cuts[n + 1]:
                yield _blob(n, [c[cuts[n] : cuts[n + 1]] for c in columns])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
                rows += batch.num_rows
            if rows >= EDGES_A_TASK:
                yield from out(held)
                held, rows = [], 0
        if held:
            yield from out(held)

    return run


def _lists(parts: int, temporal: bool):
    """Edges to an `a` go to the task of that `a`, each middle's list once a blob: [a, middle, ins, del, number of the list, lengths, b, ins, del]."""
    def run(batches):
        blobs = list(_unblob(batches))
        if not blobs:
            return
        side, *columns = (np.concatenate(c) for c in zip(*blobs, strict=True))
        del blobs
        b = [c[side == 1] for c in columns]
        order = np.lexsort((b[1], b[0]))
        b = [c[order] for c in b]
        middles, first, length = np.unique(b[0], return_index=True, return_counts=True)
        a = [c[side == 0] for c in columns]
        at = np.searchsorted(middles, a[0])
        there = np.flatnonzero(middles[np.minimum(at, len(middles) - 1)] == a[0]) if len(middles) else np.empty(0, np.int64)
        a, at = [c[there] for c in a], at[there]
        part = _spread(a[1], parts)
        order = np.lexsort((at, part))
        a, at, part = [c[order] for c in a], at[order], part[order]
        upto = np.concatenate(([0], np.cumsum(length[at])))
        cuts = np.searchsorted(part, np.arange(parts + 1))
        for n in range(parts):
            low = cuts[n]
            while low < cuts[n + 1]:
                high = min(cuts[n + 1], max(low + 1, np.searchsorted(upto, upto[low] + PAIRS_AT_ONCE, "right") - 1))
                used, number = np.unique(at[low:high], return_inverse=True)
                of = _runs(first[used], length[used])
                yield _blob(n, [a[1][low:high], a[0][low:high], *(c[low:high] for c in a[2:]), number, length[used], b[1][of], *(c[of] for c in b[2:])])
                low = high

    return run


def _wedges(blob: list[np.ndarray], temporal: bool) -> list[np.ndarray]:
    """a, b, middle, then ins and del, of the wedges of a blob that ever were."""
    if temporal:
        a, middle, a_ins, a_del, number, lengths, b, b_ins, b_del = blob
    else:
        a, middle, number, lengths, b = blob
    each = lengths[number]
    of = _runs((np.cumsum(lengths) - lengths)[number], each)
    out = [np.repeat(a, each), b[of], np.repeat(middle, each)]
    if not temporal:
        return out
    ins, gone = np.maximum(np.repeat(a_ins, each), b_ins[of]), np.minimum(np.repeat(a_del, each), b_del[of])
    was = ins < gone
    return [c[was] for c in (*out, ins, gone)]


def _order(key: np.ndarray) -> np.ndarray:
    """Places of keys (0 or more) in order; a plain sort of key and place as one number is faster, where both fit."""
    bits = len(key).bit_length()
    if int(key.max()) >> (62 - bits):
        return np.argsort(key)
    return np.sort(key << bits | np.arange(len(key))) & ((1 << bits) - 1)


def _summed(columns: list[np.ndarray], weight: np.ndarray) -> list[np.ndarray]:
    """Distinct rows of the columns, with the sum of their weights."""
    if not columns:
        return [np.array([weight.sum()], np.int64)]
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    return [*(c[at] for c in columns), np.add.reduceat(weight[order], at) if len(at) else weight]


def _pairs(kept: tuple[bool, bool], temporal: bool, names: list[str]):
    """Pairs of wedges with the same ends and different middles, both orders counted, by the ends that stay and the interval."""
    def batches_of(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for n in range(0, len(columns[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[n : n + 100_000], pa.int64()) for c in columns], names)

    def run(batches):
        made = [_wedges(blob, temporal) for blob in _unblob(batches)]
        if not made:
            return
        a, b, middle, *valid = (np.concatenate(c) for c in zip(*made, strict=True))
        del made
        if not len(a):
            return
        of_b = np.unique(b)
        key = np.unique(a, return_inverse=True)[1] * len(of_b) + np.searchsorted(of_b, b)
        order = _order(key)
        new = np.concatenate(([True], np.diff(key[order]) != 0))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(order)))
        live = order[np.repeat(size > 1, size)]
        size = size[size > 1]
        a, b, middle, *valid = (c[live] for c in (a, b, middle, *valid))
        ends = [c for c, there in zip((a, b), kept, strict=True) if there]
        if not temporal:  # all ordered pairs of a group, but for those of one middle
            group = np.repeat(np.arange(len(size)), size)
            same = _summed([group, middle], np.ones(len(group), np.int64))
            at = np.cumsum(size) - size
            weight = size * size - np.bincount(same[0], weights=same[2].astype(np.float64) ** 2, minlength=len(size)).astype(np.int64)
            some = weight > 0
            yield from batches_of(_summed([c[at][some] for c in ends], weight[some]))
            return
        before = np.arange(len(live)) - np.repeat(np.cumsum(size) - size, size)  # wedges of the group that come earlier
        upto = np.concatenate(([0], np.cumsum(before)))
        low = 0
        while low < len(live):
            high = max(low + 1, np.searchsorted(upto, upto[low] + PAIRS_AT_ONCE, "right") - 1)
            n = before[low:high]
            i, j = np.repeat(np.arange(low, high), n), _runs(np.arange(low, high) - n, n)
            ins, gone = np.maximum(valid[0][i], valid[0][j]), np.minimum(valid[1][i], valid[1][j])
            some = (ins < gone) & (middle[i] != middle[j])
            i = i[some]
            yield from batches_of(_summed([*(c[i] for c in ends), ins[some], gone[some]], np.full(len(i), 2, np.int64)))
            low = high

    return run
