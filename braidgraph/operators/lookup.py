"""Edge labels of pairs, inside the tasks: each pair of a packet's sources and ends is looked up in a table of the packet's edges.

A table has a cell for every pair of some ends with all sources; edges are put into their cells, and what a cell then holds, an edge or
none, is the pair's answer. Cells are read where they are made, so that no pair is ever a row of a shuffle.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

#: Cells of one table, which stay in the processor's cache.
CELLS = 1 << 17
#: In packets: the label of an edge that has none.
NO_LABEL = 1 << 40

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the repository on their path


@dataclass
class Ids:
    """Distinct ids in order, how many copies there are of each, and behind them those of the null one, if it is there."""

    ids: np.ndarray
    copies: np.ndarray

    @classmethod
    def of(cls, known: np.ndarray, more: pa.StructArray) -> Ids:
        out = cls(np.sort(known), np.ones(len(known), np.int64))
        ids, copies = more.field("id"), more.field("copies").to_numpy(zero_copy_only=False)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        out.copies[out.places(ids.drop_null().to_numpy(zero_copy_only=False))] = copies[~null]
        return cls(out.ids, np.concatenate((out.copies, copies[null])))

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Where the ids are, -1 for those that aren't here."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)

    def names(self, places: np.ndarray) -> pa.Array:
        """The ids at places."""
        return pa.array(np.append(self.ids, 0)[places], pa.int64(), mask=places == len(self.ids))


@dataclass
class Table:
    """Cells of the ends from `low` on by all sources: the number (from 1) of the pair's first edge, or 0 without one. `each`: the
    labels of a pair by its first edge, whose others follow; `labels` by edge."""

    srcs: Ids
    dsts: Ids
    low: int
    cells: np.ndarray
    each: np.ndarray
    labels: np.ndarray

    def answers(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of cells: indices into them, one for each label of the cell's pair, and the labels' edges (-1: none)."""
        edge = self.cells.ravel()[at].astype(np.int64) - 1
        each = np.where(edge < 0, 1, self.each[edge])
        cell = np.repeat(np.arange(len(at)), each)
        further = np.arange(len(cell)) - np.repeat(np.cumsum(each) - each, each)
        return cell, np.repeat(edge, each) + further

    def copies(self, at: np.ndarray) -> np.ndarray:
        """How many pairs each cell stands for."""
        dst, src = np.divmod(at, self.cells.shape[1])
        return self.dsts.copies[self.low + dst] * self.srcs.copies[src]


def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[Table]:
    """Every pair of every packet, table by table."""
    longs = lambda x: np.zeros(0, np.int64) if x.values is None else x.values.to_numpy(zero_copy_only=False)
    for batch in batches:
        columns = [batch.column(c) for c in ("srcs", "src_copies", "dsts", "dst_copies", "edge_src", "edge_dst", "edge_label")]
        for srcs, src_copies, dsts, dst_copies, *edges in zip(*columns, strict=True):
            yield from _tables(Ids.of(longs(srcs), src_copies.values), Ids.of(longs(dsts), dst_copies.values), *map(longs, edges))


def _tables(srcs: Ids, dsts: Ids, src: np.ndarray, dst: np.ndarray, labels: np.ndarray) -> Iterator[Table]:
    src, dst = srcs.places(src), dsts.places(dst)
    order = np.lexsort((src, dst))
    order = order[(src[order] >= 0) & (dst[order] >= 0)]
    src, dst, labels = src[order], dst[order], labels[order]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(src) != 0) | (np.diff(dst) != 0)))) if len(src) else np.zeros(0, np.int64)
    each = np.zeros(len(src) + 1, np.int64)  # one more, for pairs without an edge
    each[first] = np.diff(np.append(first, len(src)))
    width, height = len(srcs.copies), len(dsts.copies)
    rows = max(1, CELLS // width)
    for low in range(0, height, rows):
        cells = np.zeros((min(rows, height - low), width), np.int32)
        here = first[slice(*np.searchsorted(dst[first], (low, low + rows)))]
        cells[dst[here] - low, src[here]] = here + 1
        yield Table(srcs, dsts, low, cells, each, labels)


def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src, dst, elabel, pairs: every pair with its label, or null; with several labels, a row for each."""
    for t in tables(batches):
        at = np.arange(t.cells.size)
        cell, edge = t.answers(at)
        dst, src = np.divmod(at[cell], t.cells.shape[1])
        labels = np.append(t.labels, NO_LABEL)[edge]
        columns = [t.srcs.names(src), t.dsts.names(t.low + dst), pa.array(labels, mask=labels == NO_LABEL).cast(pa.int32()), pa.array(t.copies(at[cell]), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["src", "dst", "elabel", "pairs"])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """elabel, pairs: what `labelled` says, summed in the task. Cells without an edge are counted as they stand."""
    n: Counter = Counter()
    for t in tables(batches):
        flat = t.cells.ravel()
        if (t.srcs.copies == 1).all() and (t.dsts.copies == 1).all():
            n[None] += np.count_nonzero(flat == 0)
        else:
            n[None] += int(t.copies(np.flatnonzero(flat == 0)).sum())
        at = np.flatnonzero(flat != 0)
        cell, edge = t.answers(at)
        labels, which = np.unique(t.labels[edge], return_inverse=True)
        sums = np.zeros(len(labels), np.int64)
        np.add.at(sums, which, t.copies(at[cell]))
        for label, some in zip(labels.tolist(), sums.tolist(), strict=True):
            n[None if label == NO_LABEL else label] += some
    found = {label: int(some) for label, some in n.items() if some}
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["elabel", "pairs"])
