"""Sequence packing along a space-filling curve.

Each document becomes a signed hashed vector of its 4-byte grams, projected to a few dimensions by a fixed random matrix and
placed on a grid; its cell's Hilbert index is the sort key. The rows are range-partitioned by (key, doc_id), so
ties and copies split over partitions, and each partition streams its documents, which are neighbours on the curve, into
sequences of `length` tokens. A partition's unfinished last sequence is cut into lengths that are powers of two
and so needs no padding.

Defined results: a null or empty text is the single id 0; a null doc_id sorts first and is kept; repeated rows are
packed once each; an empty table gives no piece; texts of any length are encoded whole, long runs of one character included. Only the
two named columns are read, so others can't clash.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from math import erf

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidgraph.llm.common import arrow_schema, tidied

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Fixed: the seed of the projection, the size of the hashed vector, grid bits a dimension, dimensions.
SEED, BUCKETS, BITS, DIMS = 9, 256, 10, 4
#: Bytes hashed at a time; their multiplier; the shift that leaves a bucket and its sign (2 * BUCKETS values).
GRAM, GRAM_MIX, GRAM_SHIFT = 4, np.uint32(0x9E3779B1), np.uint32(23)
#: Texts whose characters all lie here are cut alike by both tokenizer libraries (tests/llm/test_packing.py goes
#: through every one); any other text goes through `tokenizers` itself.
UNPROVEN = re.compile("[^\\x00-\\x7f\\xa1-\\xff\\u0152\\u0153\\u2010-\\u201f\\u2026\\u20ac]")
#: The faster library's matcher keeps a frame for each character of a run of white space: texts with longer runs go through `tokenizers`.
LONG_RUN = 10_000
BLANKS = re.compile(rf"(?<!\s)\s{{{LONG_RUN}}}")
#: The cutting pattern of byte-level vocabularies (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (rows of cells, each below 2**bits)."""
    x = cells.astype(np.int64).copy()
    n, dims = x.shape
    for level in range(bits - 1, 0, -1):  # undo the rotations and reflections of every level, coarse to fine
        bit, below = 1 << level, (1 << level) - 1
        for d in range(dims):
            on = (x[:, d] & bit) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, d]) & below)
            x[:, 0] ^= np.where(on, below, swap)
            x[:, d] ^= swap
    for d in range(1, dims):  # Gray code across dimensions
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[:, d] >> level) & 1)
    return key


@lru_cache(1)
def _projection() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((BUCKETS, DIMS))


def curve_keys(texts: list[bytes | None]) -> np.ndarray:
    """Hilbert keys of texts; the grid is fixed (normal quantiles), so a key depends on its text alone."""
    vectors = np.zeros((len(texts), BUCKETS))
    for row, text in enumerate(texts):
        if text:
            text = text if len(text) >= GRAM else text.ljust(GRAM)
            grams = np.ndarray((len(text) - GRAM + 1,), "<u4", text, strides=(1,))  # each byte and the next three
            signed = np.bincount((grams * GRAM_MIX) >> GRAM_SHIFT, minlength=2 * BUCKETS)
            vectors[row] = signed[:BUCKETS] - signed[BUCKETS:]
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    at = (vectors / np.where(norm == 0, 1, norm)) @ _projection()
    share = 0.5 * (1 + np.vectorize(erf, otypes=[float])(at / np.sqrt(2)))
    return hilbert_index(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


class Encoder:
    """ids of texts by a `tokenizers` file; the faster library with the same vocabulary does the proven range."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(name if name.startswith("/") else public_tokenizers.path(name))
        specials = {t.content for t in self.exact.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, sorted(specials)))) if specials else None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*printable}))}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.exact.get_vocab(with_added_tokens=False).items() if token not in specials}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if UNPROVEN.search(text) or self.special and self.special.search(text) or len(text) >= LONG_RUN and BLANKS.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(2)
def encoder(name: str) -> Encoder:
    return Encoder(name)


class Packer:
    """Cuts a stream of documents into pieces that fill sequences one after another."""

    def __init__(self, length: int, first_sequence: int):
        self.length, self.sequence, self.open, self.filled = length, first_sequence, [], 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while start < total:
            take = min(self.length - self.filled, total - start)
            self.open.append((doc_id, start, ids[start : start + take], total))
            self.filled += take
            start += take
            if self.filled == self.length:
                self._close(self.open)
                self.open, self.filled = [], 0

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def finish(self) -> None:
        """The last, unfinished sequence: lengths by its binary digits, large to small."""
        left = self.open
        for size in (1 << b for b in range(self.filled.bit_length() - 1, -1, -1) if self.filled >> b & 1):
            part, room = [], size
            while room:
                doc_id, start, ids, total = left[0]
                part.append((doc_id, start, ids[:room], total))
                room, left = room - len(part[-1][2]), ([(doc_id, start + room, ids[room:], total)] if len(ids) > room else []) + left[1:]
            self._close(part)
        self.open, self.filled = [], 0

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        schema = arrow_schema(PIECES)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", length: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (PIECES) of all documents. `tokenizer`: a file, or its name among the public tokenizers."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    @F.pandas_udf("long")
    def curve_key(texts: pd.Series) -> pd.Series:
        return pd.Series(curve_keys([None if x is None else bytes(x) for x in texts]))

    ranged = slim.withColumn("key", curve_key(F.col("text").cast("binary"))).repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "text")

    def run(batches):
        encode = encoder(tokenizer)
        packer = Packer(length, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(i, np.array([*encode.ids(t.as_py() or ""), 0], "<u4"))
                if len(packer.rows) > 20_000:
                    yield packer.batch()
        packer.finish()
        yield packer.batch()

    return ranged.select("doc_id", "text").mapInArrow(tidied(run), PIECES)
