"""Removal of repeated passages: windows of words, found through a count-min prefilter.

A window is `length` consecutive words. Its key for the prefilter is its minimiser: the smallest hash of the
q-word grams inside it. Equal windows have equal minimisers, so a minimiser's document count is never below that of
any of its windows. Steps:

1. Documents with the same words are one class; all but its smallest doc_id lose every word and search no further.
2. Each task gathers the (document, minimiser) pairs of its rows by block, blocks being ranges of hashed minimisers. A minimiser of several of the
   task's documents is repeated for certain: its pairs are kept, and one word of it goes to its block instead of all of them.
   The task's counters of a block (two rows of them) are a partition sketch; those of all tasks are merged by addition. There are COUNTERS_PER_ITEM
   counters a pair however many pairs there are, so blocks grow in number, not in size, and no sketch is held whole anywhere.
3. Pairs whose estimate (the smaller of the two counters) is 2 or more are kept: pairs are dealt out by block, and stream past
   their block's merged sketch, which is loaded once. An estimate is never too small, so no repeated window is lost.
4. A second pass over the texts hashes (96 bits) only windows with a kept minimiser. Of the same window in several documents of a task all but the
   smallest document lose it for certain, and only that one goes on to be grouped exactly with other tasks' windows.
   Windows whose smallest document is another one are removed with all the words they cover.

Defined results: null and empty texts have no words; texts with fewer words than a window lose nothing (nor do they if equal);
of rows with one doc_id none removes from another; a row whose doc_id is null loses and removes nothing; of equal windows the
smallest doc_id keeps its own; texts of any length are read whole; an empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidgraph.llm.common import MIX_A, MIX_B, Rolling, U64, Words, arrow_schema, map_batches, materialize, mix, signed, tidied, utf8, word_chunks, words_of

#: Counters of one block in one row of the sketch; counters for each pair in all; pairs of a task sketched at once.
BLOCK_COUNTERS, COUNTERS_PER_ITEM, CHUNK = 1 << 20, 8, 1 << 20
_first, _second = Rolling(0x2545F4914F6CDD1D), Rolling(0x9E6C63D0876A9A47)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling."""
    if len(h) < width:
        return np.empty(0, h.dtype)
    size, m = 1, h
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


class Passages:
    """Windows of some rows of texts at once; a row's windows start at its words but the last length - 1."""

    def __init__(self, words: Words, length: int):
        self.words, self.length = words, length
        self.prefix, self.other = _first.prefix(words.hashes), _second.prefix(words.hashes)
        q = length // 2 + 1
        self.minimisers = sliding_min(_first.windows(self.prefix, q), length - q + 1)

    def rows(self):
        """(row, first window, the window after its last, number of words)."""
        for row, a, b in self.words.rows():
            yield row, a, max(a, b - self.length + 1), b - a

    def sequence_keys(self, a: int, n: int) -> tuple[int, int]:
        """128 bits of a row's whole word sequence: n words from word a, each mixed with its place, so that no pattern of words cancels out."""
        with np.errstate(over="ignore"):
            placed = mix(self.words.hashes[a : a + n] + np.arange(1, n + 1, dtype=U64) * MIX_A)
            both = np.array([placed.sum(dtype=U64), mix(placed * MIX_B + MIX_A).sum(dtype=U64)])
            return tuple(signed(mix(both + U64(n))).tolist())

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits for each window."""
        return _first.windows(self.prefix, self.length), (_second.windows(self.other, self.length) >> U64(33)).astype(np.int32)


def cells(item: np.ndarray, row: int) -> np.ndarray:
    """Counter of an item inside its block, in one row of the sketch."""
    with np.errstate(over="ignore"):
        return (mix(item * MIX_A + U64(row) * MIX_B) % U64(BLOCK_COUNTERS)).astype(np.uint32)


def block_of(item: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(item ^ MIX_B) % U64(blocks)).astype(np.int64)


PAIRS = "block long, docs binary, items binary, twice binary"


def _by_block(blocks: int):
    """Rows (doc_id, mins) -> PAIRS: the pairs of a task gathered by block, and minimisers that several of its documents have; these
    documents' own pairs follow under block -1."""
    schema = arrow_schema(PAIRS)

    def out(docs, items):
        docs, items = np.concatenate(docs), np.concatenate(items)
        order = np.argsort(items, kind="stable")
        docs, items = docs[order], items[order]
        start = np.flatnonzero(np.r_[True, items[1:] != items[:-1]])
        many = np.diff(start, append=len(items)) > 1
        several = np.repeat(many, np.diff(start, append=len(items)))
        rows = [(-1, docs[several].tobytes(), items[several].tobytes(), b"")] if several.any() else []
        docs, items, twice = docs[start], items[start], many  # one of each minimiser
        at = block_of(items, blocks)
        order = np.argsort(at, kind="stable")
        at, docs, items, twice = at[order], docs[order], items[order], twice[order]
        names, starts = np.unique(at, return_index=True)
        for name, a, b in zip(names.tolist(), starts, [*starts[1:], len(at)], strict=True):
            one = ~twice[a:b]
            rows.append((name, docs[a:b][one].tobytes(), items[a:b][one].tobytes(), items[a:b][~one].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        docs, items, n = [], [], 0
        for batch in batches:
            for doc, mins in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                m = mins.values.to_numpy(zero_copy_only=False).view(U64)
                docs.append(np.full(len(m), doc, np.int64))
                items.append(m)
                n += len(m)
                if n >= CHUNK:
                    yield out(docs, items)
                    docs, items, n = [], [], 0
        if n:
            yield out(docs, items)

    return run


def _sketch(batch):
    """A task's counters of each block: the cells in use and their counts (2 stands for more)."""
    made = {"block": [], "row": [], "cells": [], "counts": []}
    for block, items, twice in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
        twice = np.frombuffer(twice, U64)
        items = np.concatenate([np.frombuffer(items, U64), twice, twice])
        for row in (0, 1):
            at, count = np.unique(cells(items, row), return_counts=True)
            made["block"].append(block)
            made["row"].append(row)
            made["cells"].append(at.tobytes())
            made["counts"].append(np.minimum(count, 2).astype(np.uint8).tobytes())
    return made


def _merge(parts: pd.DataFrame) -> pd.DataFrame:
    """Adds the sketches of one block; returns for each row the bits of counters that are 2 or more."""
    bits = []
    for row in (0, 1):
        total = np.zeros(BLOCK_COUNTERS, np.uint8)
        for at, count in zip(parts["cells"][parts["row"] == row], parts["counts"][parts["row"] == row], strict=True):
            at = np.frombuffer(at, np.uint32)
            total[at] = np.minimum(total[at] + np.frombuffer(count, np.uint8), 2)
        bits.append(np.packbits(total == 2).tobytes())
    return pd.DataFrame({"block": [parts["block"].iloc[0]], "bits0": [bits[0]], "bits1": [bits[1]]})


def _estimated(batches):
    """Rows (block, is_pairs, one, two) sorted so that each block's bits come before its pairs (docs, items) -> pairs whose estimate is 2 or
    more: (doc_id, item)."""
    schema = arrow_schema("doc_id long, item long")
    at, bits = None, []
    for batch in batches:
        docs, items = [], []
        for block, pairs, one, two in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if not pairs:
                at, bits = block, [np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)]
                continue
            doc, item = np.frombuffer(one, np.int64), np.frombuffer(two, U64)
            if block != at:
                raise ValueError("pairs without their sketch")
            keep = np.ones(len(item), bool)
            for row in (0, 1):
                cell = cells(item, row)
                keep &= (bits[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
            docs.append(doc[keep])
            items.append(item[keep])
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(signed(np.concatenate(items)))], schema=schema)


def _unpacked(batch):
    """Pairs that need no estimate: (doc_id, item)."""
    docs, items = (b"".join(batch.column(i).to_pylist()) for i in (1, 2))
    return {"doc_id": np.frombuffer(docs, np.int64), "item": np.frombuffer(items, np.int64)}


def removed_windows(spark: SparkSession, texts: DataFrame, length: int) -> DataFrame:
    """(doc_id, gone): hashes of the windows that a document loses; its sequence key if it loses every word."""

    def describe(batch):
        made = []
        for words in word_chunks(batch.column(1)):
            p = Passages(words, length)
            for _, a, b, n in p.rows():
                made.append((n, *p.sequence_keys(a, n), signed(np.unique(p.minimisers[a:b]))) if n >= length else (n, 0, 0, ()))
        n, k1, k2, mins = zip(*made, strict=True) if made else ((), (), (), ())
        return {"doc_id": batch.column(0), "n": n, "k1": k1, "k2": k2, "mins": mins}

    rows = materialize(spark, map_batches(texts.where("doc_id is not null"), describe, "doc_id long, n long, k1 long, k2 long, mins array<long>").where(F.col("n") >= length), "minimisers")
    classes = materialize(spark, rows.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    joined = rows.join(classes, ["k1", "k2", "n"])
    copies = rows.select("k1", "k2", "n", "doc_id").join(classes, ["k1", "k2", "n"]).where("doc_id > rep").select("doc_id", F.col("k1").alias("gone"))
    singles = materialize(spark, joined.where("doc_id = rep").select("doc_id", "mins"), "singles")
    n_items = singles.agg(F.sum(F.size("mins")).alias("n")).first().n or 1
    blocks = max(1, -(-n_items * COUNTERS_PER_ITEM // (2 * BLOCK_COUNTERS)))
    pairs = materialize(spark, singles.mapInArrow(tidied(_by_block(blocks)), PAIRS), "pairs")
    asked = pairs.where("block >= 0")
    parts = map_batches(asked, _sketch, "block long, row int, cells binary, counts binary")
    sketch = parts.groupBy("block").applyInPandas(_merge, "block long, bits0 binary, bits1 binary")
    both = sketch.select("block", F.lit(False).alias("is_pairs"), F.col("bits0").alias("one"), F.col("bits1").alias("two")).union(asked.where(F.length("docs") > 0).select("block", F.lit(True), "docs", "items"))
    estimated = both.repartition("block").sortWithinPartitions("block", "is_pairs").mapInArrow(tidied(_estimated), "doc_id long, item long")
    kept = estimated.union(map_batches(pairs.where("block < 0"), _unpacked, "doc_id long, item long"))
    wanted = kept.groupBy("doc_id").agg(F.collect_set("item").alias("mins"))

    def hash_wanted(batches):
        schema = arrow_schema("w1 long, w2 int, doc_id long, gone boolean")

        def out(made):
            w1, w2, doc = (np.concatenate(x) for x in zip(*made, strict=True))
            order = np.lexsort((doc, w2, w1))
            w1, w2, doc = w1[order], w2[order], doc[order]
            same = np.zeros(len(w1), bool)  # as the window before
            same[1:] = (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])
            first = doc[np.maximum.accumulate(np.where(same, 0, np.arange(len(w1))))]
            keep = ~same | (doc > first)  # of a repeated row of the smallest doc_id, one
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (w1, w2, doc, same)], schema=schema)

        made, n = [], 0
        for batch in batches:
            docs, mins = batch.column(0).to_pylist(), batch.column(2)
            for words in word_chunks(batch.column(1)):
                p = Passages(words, length)
                w1, w2 = p.keys()
                for row, a, b, _ in p.rows():
                    if b > a:
                        hit = a + np.flatnonzero(np.isin(p.minimisers[a:b], mins[row].values.to_numpy(zero_copy_only=False).view(U64)))
                        once = hit[np.unique(w1[hit], return_index=True)[1]]
                        made.append((signed(w1[once]), w2[once], np.full(len(once), docs[row], np.int64)))
                        n += len(once)
                if n >= CHUNK:
                    yield out(made)
                    made, n = [], 0
        if made:
            yield out(made)

    windows = texts.join(wanted, "doc_id").select("doc_id", "text", "mins").mapInArrow(tidied(hash_wanted), "w1 long, w2 int, doc_id long, gone boolean")
    #: What a task has settled already isn't brought together by window: salted by document.
    salt = F.when(F.col("gone"), F.xxhash64("doc_id")).otherwise(F.lit(0))
    repeated = windows.withColumn("salt", salt).withColumn("first", F.min("doc_id").over(Window.partitionBy("w1", "w2", "salt"))).where("gone or doc_id > first")
    return repeated.select("doc_id", F.col("w1").alias("gone")).union(copies).groupBy("doc_id").agg(F.collect_list("gone").alias("gone"))


def kept_words(text: bytes, words: list[bytes], gone: np.ndarray | None, length: int) -> list[bytes]:
    """The words that stay when the windows (or the whole sequence) named in `gone` go."""
    if gone is None or len(words) < length:
        return words
    p = Passages(words_of(text), length)
    if np.int64(p.sequence_keys(0, len(words))[0]) in gone:
        return []
    hit = np.isin(signed(p.keys()[0]), gone)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:-length][hit] += 1
    edge[length:][hit] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    return [w for w, c in zip(words, covered.tolist(), strict=True) if not c]


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def rebuild(batch):
        for low in range(0, batch.num_rows, 512):
            few = batch.slice(low, 512)
            n_words, n_removed, kept = [], [], []
            for t, gone in zip(utf8(few.column(1)), few.column(2), strict=True):
                words = t.split() if t else []
                left = kept_words(t or b"", words, gone.values.to_numpy(zero_copy_only=False) if gone.is_valid else None, length)
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield {"doc_id": few.column(0), "n_words": n_words, "n_removed": n_removed, "kept": pa.array(kept, pa.binary()).cast(pa.string())}

    joined = texts.join(removed_windows(spark, texts, length), "doc_id", "left").select("doc_id", "text", "gone")
    return map_batches(joined, rebuild, "doc_id long, n_words long, n_removed long, kept string")
