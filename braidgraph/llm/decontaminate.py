"""Benchmark decontamination by q-gram lemma filtering.

A text is folded (letters and digits in lower case, everything else one space). An item of length m within
edit distance e of a region shares at least m - q + 1 - q * e of its q-grams with it, all on diagonals that differ by
e at most. With e = floor(m * errors / 100), diagonals fall in bands of width e + 1 that are taken two by two
(overlapping), so that one pair of bands holds all of them; pairs of bands with enough shared q-grams are regions.
Each region is verified by banded alignment of the whole item (semi-global: free ends in the text).

An item too short for that (no q-gram is sure to be shared) has its own q: of edits + 1 pieces of q characters one is unchanged, and
pieces are looked up like q-grams.

The benchmark is the stated query set: its q-grams are indexed in blocks of at most BLOCK_CHARS characters and BLOCK_ITEMS items (one
item, if it is longer), each block sent to the executors and met by every document. Documents meet nothing else, so nothing is
shuffled by q-gram and frequent q-grams or sources make no hot task.

Defined results: null and empty texts, items without a letter or digit and null items match nothing; rows with one
doc_id or a null doc_id are judged row by row; an item of less than q characters is found as whole words; of several places of an item
that with the fewest edits counts (ties: the first region); texts and items of any length are read whole; an empty benchmark or table gives no
hit. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidgraph.llm.common import MIX_A, U64, arrow_schema, mix, tidied

Q, ERRORS, BLOCK_ITEMS, BLOCK_CHARS = 9, 8, 1 << 16, 1 << 21
HITS = "doc_id long, item_id long, start long, length long, edits long"
#: Of the table of hashes in use: at least so many, and eight slots a q-gram up to a limit.
SLOTS_BITS, MOST_SLOTS_BITS = 22, 24
_SPACE = 32


def fold(text: str | None) -> np.ndarray:
    """Code points of a text in lower case; runs of other characters than letters and digits are one space."""
    if not text:
        return np.empty(0, np.uint32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    word = ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57))
    high = codes >= 128
    if high.any():
        kinds, where = np.unique(codes[high], return_inverse=True)
        word[high] = np.array([chr(k).isalnum() for k in kinds], bool)[where]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first other character after a word is its space
    return np.where(word, codes, _SPACE)[keep]


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, U64)
    c = codes.astype(U64)
    with np.errstate(over="ignore"):
        size, h = 1, c
        while 2 * size <= q:
            h = h[:-size] * MIX_A + h[size:]
            h ^= h >> U64(29)
            size *= 2
        if size < q:
            h = h[: n] * MIX_A + h[q - size : q - size + n]
        return mix(h)


@dataclass
class Index:
    """q-grams of a block of items, sorted by hash, and a flag for each slot in use; pieces of short items by their q."""

    ids: list[int]
    texts: list[np.ndarray]
    edits: np.ndarray
    needed: np.ndarray
    hashes: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    slots: np.ndarray
    q: int
    short: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _sorted(hashes: list[np.ndarray], owner: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By hash."""
    h = np.concatenate([*hashes, np.empty(0, U64)])
    order = np.argsort(h, kind="stable")
    o, p = (np.concatenate([*x, np.empty(0, np.int32)])[order].astype(np.int32) for x in (owner, place))
    return h[order], o, p


def _lookup(h: np.ndarray, at: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where hashes (at places `at`) stand in a sorted table: (owner, place in the text, place in the item) of each meeting."""
    hashes, owner, place = table
    first = np.searchsorted(hashes, h, "left")
    many = np.searchsorted(hashes, h, "right") - first
    at, first, many = at[many > 0], first[many > 0], many[many > 0]
    entry = np.repeat(first - np.cumsum(np.r_[0, many[:-1]]), many) + np.arange(many.sum()) if len(at) else np.empty(0, np.int64)
    return owner[entry], np.repeat(at, many), place[entry].astype(np.int64)


def build(items: list[tuple[int, str | None]], q: int = Q, errors: int = ERRORS) -> Index:
    folded = [(i, np.trim_zeros(np.where(f == _SPACE, 0, f)).astype(np.uint32)) for i, t in items for f in [fold(t)]]
    folded = [(i, np.where(f == 0, _SPACE, f).astype(np.uint32)) for i, f in folded if len(f)]
    texts = [f for _, f in folded]
    edits = np.array([len(f) * errors // 100 for f in texts], np.int64)
    needed = np.array([len(f) - q + 1 - q * e for f, e in zip(texts, edits, strict=True)], np.int64)
    long_ = np.flatnonzero(needed >= 1)
    parts = [grams(texts[n], q) for n in long_]
    hashes, owner, place = _sorted(parts, [np.full(len(x), n, np.int32) for n, x in zip(long_, parts, strict=True)], [np.arange(len(x), dtype=np.int32) for x in parts])
    bits = min(MOST_SLOTS_BITS, max(SLOTS_BITS, (8 * len(hashes)).bit_length()))
    slots = np.zeros(1 << bits, bool)
    slots[(hashes >> U64(64 - bits)).astype(np.int64)] = True
    pieces: dict[int, list[tuple]] = {}
    for n in np.flatnonzero(needed < 1):
        e, m = int(edits[n]), len(texts[n])
        of = m // (e + 1)
        for k in range(e + 1):
            pieces.setdefault(of, []).append((grams(texts[n][k * of : k * of + of], of), np.array([n]), np.array([k * of])))
    short = {of: _sorted(*zip(*x, strict=True)) for of, x in sorted(pieces.items())}
    return Index([i for i, _ in folded], texts, edits, needed, hashes, owner, place, slots, q, short)


def align(item: np.ndarray, region: np.ndarray, limit: int) -> tuple[int, int] | None:
    """(edits, end): least edit distance of the item to a part of the region, and that part's last end, if at most limit.

    Only the band of diagonals on which such a part can lie is computed; cell k of row i is region end i + k - limit.
    """
    m, n = len(item), len(region)
    if n < m - limit:
        return None
    width = max(0, n - m) + 2 * limit + 1
    far = m + n + 1
    at = np.arange(width) - limit
    padded = np.concatenate([np.zeros(limit + 1, np.uint32), region, np.zeros(m + limit + 1, np.uint32)])
    row = np.where((at >= 0) & (at <= n), 0, far)
    step = np.arange(width)
    for i in range(1, m + 1):
        end = at + i
        change = row + (padded[end + limit] != item[i - 1])
        change[end < 1] = far
        change[:-1] = np.minimum(change[:-1], row[1:] + 1)
        change[(end < 0) | (end > n)] = far
        row = np.minimum.accumulate(change - step) + step
        row[(end < 0) | (end > n)] = far
        if row.min() > limit:
            return None
    best = int(row.min())
    return best, int(np.flatnonzero(row == best)[-1]) + m - limit


def last_place(item: np.ndarray, region: np.ndarray) -> int | None:
    """Where an item last stands unchanged in a region."""
    part, whole = item.astype("<u4").tobytes(), region.astype("<u4").tobytes()
    at = whole.rfind(part)
    while at % 4 and at > 0:
        at = whole.rfind(part, 0, at + len(part) - 1)
    return at // 4 if at >= 0 and at % 4 == 0 else None


def regions(starts: np.ndarray, m: int, limit: int) -> list[list[int]]:
    """Regions that may hold an item of m characters within `limit` edits, from where pieces put its start; overlapping ones are one."""
    out: list[list[int]] = []
    for x in np.unique(starts).tolist():
        low, high = x - limit, x + m + limit
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return out


def hits(codes: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """(item number, start, length, edits) in folded text: the best region of each item that the text holds."""
    found: dict[int, tuple[int, int, int]] = {}

    def judge(n: int, low: int, high: int) -> None:
        item, limit = index.texts[n], int(index.edits[n])
        low, high = max(0, low), min(len(codes), high)
        if n in found and found[n][2] == 0:
            return
        if (at := last_place(item, codes[low:high])) is not None:
            found[n] = (low + at, len(item), 0)
            return
        got = align(item, codes[low:high], limit)
        if got and (n not in found or got[0] < found[n][2]):
            back = align(item[::-1], codes[low : low + got[1]][::-1], limit)
            length = min(back[1], got[1]) if back else got[1]
            found[n] = (low + got[1] - length, length, got[0])

    h = grams(codes, index.q)
    at = np.flatnonzero(index.slots[(h >> U64(64 - (len(index.slots).bit_length() - 1))).astype(np.int64)])
    if len(at):
        item, where, place = _lookup(h[at], at, (index.hashes, index.owner, index.place))
        diagonal = where - place
        enough = np.bincount(item, minlength=len(index.texts)) >= np.maximum(index.needed, 1)
        for n in np.flatnonzero(enough):
            d, width, m = diagonal[item == n], int(index.edits[n]) + 1, len(index.texts[n])
            band, count = np.unique((d + m) // width, return_counts=True)
            single = dict(zip(band.tolist(), count.tolist(), strict=True))
            for b in sorted({*single, *(x - 1 for x in single)}):
                if single.get(b, 0) + single.get(b + 1, 0) >= index.needed[n]:
                    low = b * width - m
                    judge(int(n), low - width, low + 2 * width + m + width)
    for q, table in index.short.items():
        h = grams(codes, q)
        item, where, place = _lookup(h, np.arange(len(h)), table)
        for n in np.unique(item):
            starts, size, limit = (where - place)[item == n], len(index.texts[n]), int(index.edits[n])
            if limit:
                for low, high in regions(starts, size, limit):
                    judge(int(n), low, high)
                continue
            ends = starts + size
            whole = ((starts == 0) | (codes[starts - 1] == _SPACE)) & ((ends == len(codes)) | (codes[np.minimum(ends, len(codes) - 1)] == _SPACE))
            if len(s := starts[whole]):
                found[int(n)] = (int(s[0]), size, 0)
    return [(n, *x) for n, x in sorted(found.items())]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items that have a text, up to BLOCK_ITEMS of them and BLOCK_CHARS characters at a time."""
    block, chars = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id").toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or chars + len(row.text) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((row.item_id, row.text))
        chars += len(row.text)
    if block:
        yield block


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, q: int = Q, errors: int = ERRORS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """HITS: for each row of docs and item that it holds within `errors` percent edits: place in the folded text, length, edits."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    schema = arrow_schema(HITS)
    found = None

    def search(index):
        def run(batches):
            for batch in batches:
                rows = []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    rows += [(i, index.value.ids[n], s, length, e) for n, s, length, e in hits(fold(t.as_py()), index.value)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

        return texts.mapInArrow(tidied(run), HITS)

    for block in _blocks(benchmark):
        part = search(spark.sparkContext.broadcast(build(block, q, errors)))
        found = part if found is None else found.union(part)
    return search(spark.sparkContext.broadcast(build([], q, errors))) if found is None else found


def without_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, q: int = Q, errors: int = ERRORS) -> DataFrame:
    """docs without the rows whose text holds an item; judged row by row, so that no doc_id is needed."""

    def free(index):
        @F.pandas_udf("boolean")
        def judge(texts: pd.Series) -> pd.Series:
            return pd.Series([t is None or not hits(fold(t), index.value) for t in texts], dtype=bool)

        return judge("text")

    for block in _blocks(benchmark):
        docs = docs.where(free(spark.sparkContext.broadcast(build(block, q, errors))))
    return docs


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, q: int = Q, errors: int = ERRORS) -> DataFrame:
    """docs without the documents that hold an item; rows whose doc_id is null are kept."""
    return docs.join(contaminated(spark, docs, benchmark, q, errors).select("doc_id").distinct(), "doc_id", "left_anti")
