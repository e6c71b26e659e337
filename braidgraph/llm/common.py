"""What the corpus operators share: shipping, word hashes, components.

Words are maximal runs of bytes other than ASCII white space (\\x20 and \\x09-\\x0D), which is what
``bytes.split()`` cuts too. Words of many texts are hashed at once from Arrow's own UTF-8 buffer.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from itertools import count
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidgraph.functions.storage import materialize

ROOT = Path(__file__).resolve().parents[2]
U64 = np.uint64
#: Odd multipliers of the mixing functions (fixed values: results must not change between runs).
MIX_A, MIX_B, MIX_C = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Bytes of text hashed at a time.
CHUNK_BYTES = 1 << 18
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
DIGIT = np.isin(np.arange(256), np.arange(48, 58))
#: Edges that one task contracts in memory; so few in all need no further rounds.
EDGES_PER_TASK = 200_000


#: Texts are long, and each Python worker holds a few copies of a batch: Arrow batches stay below these sizes.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that don't have the repository on their path, and bound the
    session's Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p] + [os.path.realpath(os.getcwd())]
    sc = spark.sparkContext
    if str(ROOT) in paths or getattr(sc, "_braidgraph_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / "braidgraph.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in (ROOT / "braidgraph").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(target))
    sc._braidgraph_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tidied(run: Callable) -> Callable:
    """A function for mapInArrow that gives freed memory back when its task ends: idle workers stay small."""

    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[dict] | dict], ddl: str) -> DataFrame:
    """mapInArrow over df: function turns a batch into one or more dicts of columns for ddl."""
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            made = function(batch)
            for columns in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type, from_pandas=False) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)

    return df.mapInArrow(tidied(run), ddl)


def named(columns: list[str]) -> list[Column]:
    """Columns by their whole names, which may hold dots and backticks."""
    return [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in columns]


def fresh(columns: list[str], name: str) -> str:
    """A name that no column has (upper and lower case are one)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of a table of ids for each of them, and in all; rows of such a table have BITS_ROW.
BITS_EACH, MOST_BITS, BITS_ROW = 16, 1 << 28, 1 << 15


def id_bits(spark: SparkSession, ids: DataFrame, column: str) -> tuple[DataFrame, int]:
    """A bit table of the ids (long) of a column, and how many bits it has: small enough to be sent to every task, whatever their number."""
    n = min(MOST_BITS, max(BITS_ROW, -(-BITS_EACH * ids.count() // BITS_ROW) * BITS_ROW))
    at = F.pmod(F.xxhash64(F.col(column)), F.lit(n))
    made = ids.where(F.col(column).isNotNull()).select(at.alias("at")).groupBy(F.expr(f"at div {BITS_ROW}").alias("__row"))
    return materialize(spark, made.agg(F.expr(f"bitmap_construct_agg(at % {BITS_ROW})").alias("__bits")), "bits"), n


def may_hold(df: DataFrame, key: Column, bits: tuple[DataFrame, int], negate: bool = False) -> DataFrame:
    """Rows of df whose key is in the bit table: all whose key is one of its ids, and a few others. negate: all rows that aren't these."""
    table, n = bits
    at = F.pmod(F.xxhash64(key.cast("long")), F.lit(n))
    inside = F.pmod(at, F.lit(BITS_ROW))
    byte = F.conv(F.hex(F.substring(table["__bits"], F.floor(inside / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = key.isNotNull() & (F.floor(at / BITS_ROW) == table["__row"]) & (F.getbit(byte, F.pmod(inside, F.lit(8)).cast("int")) == 1)
    return df.join(F.broadcast(table), set_, "left_anti" if negate else "left_semi")  # BITS_EACH bits an id


def utf8(column: pa.Array) -> list:
    """The texts of a string column as bytes (None where null)."""
    return column.cast(pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * MIX_B
        x = (x ^ (x >> U64(27))) * MIX_C
        return x ^ (x >> U64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], U64))[0])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), U64)
    out[:] = U64(base)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Rolling:
    """Hashes of all windows of a sequence by prefix sums of h[i] * base**i modulo 2**64."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up, self.down = powers(self.base, 4096), powers(self.inverse, 4096)

    def prefix(self, h: np.ndarray) -> np.ndarray:
        n = len(h) + 1
        if n > len(self.up):
            self.up, self.down = powers(self.base, 2 * n), powers(self.inverse, 2 * n)
        out = np.zeros(n, U64)
        with np.errstate(over="ignore"):
            np.cumsum(h * self.up[: n - 1], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, k: int) -> np.ndarray:
        m = len(prefix) - k
        if m <= 0:
            return np.empty(0, U64)
        with np.errstate(over="ignore"):
            return mix((prefix[k:] - prefix[:m]) * self.down[:m])


def _edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of rows that lie one after another in data."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    first, last = ~inside[:-2], ~inside[2:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    first[cut], last[cut - 1] = True, True
    return np.flatnonzero(inside[1:-1] & first), np.flatnonzero(inside[1:-1] & last) + 1


#: Masks of the lowest 0 to 8 bytes of eight.
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes between starts and ends: eight bytes at a time, each mixed with its place in the word, so that no
    pattern of letters cancels out; CHUNK_BYTES or one word at a time."""
    out = np.empty(len(starts), U64)
    low = 0
    while low < len(starts):
        base = int(starts[low])
        high = max(low + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, "right")))
        s, size = starts[low:high] - base, ends[low:high] - starts[low:high]
        part = np.concatenate([data[base : int(ends[high - 1])], np.zeros(8, np.uint8)])
        eight = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))
        with np.errstate(over="ignore"):
            if size.max(initial=0) <= 8:
                out[low:high] = mix(mix((eight[s] & _LOW_BYTES[size]) ^ MIX_A) + size.astype(U64) * MIX_A)
            else:
                pieces = (size + 7) >> 3
                first = np.cumsum(pieces) - pieces
                place = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
                left = np.minimum(np.repeat(size, pieces) - 8 * place, 8)
                mixed = mix((eight[np.repeat(s, pieces) + 8 * place] & _LOW_BYTES[left]) ^ (MIX_A * (place + 1).astype(U64)))
                out[low:high] = mix(np.add.reduceat(mixed, first) + size.astype(U64) * MIX_A)
        low = high
    return out


class Words:
    """Word hashes of some rows of texts at once: row i has hashes[bounds[i]:bounds[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, low: int = 0):
        self.data, self.offsets, self.low = data, offsets, low
        self.starts, self.ends = _edges(data, offsets)
        self.hashes = _hash_words(data, self.starts, self.ends)
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def rows(self):
        """(row of the batch, its first word, the word after its last)."""
        return zip(range(self.low, self.low + len(self)), self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)


def words_of(text: bytes) -> Words:
    """Of one text."""
    return Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))


def word_chunks(column: pa.Array, fold: np.ndarray | None = None) -> Iterator[Words]:
    """Words of all rows of a string column (null: none), CHUNK_BYTES or one row at a time; fold: a table of bytes."""
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK_BYTES, "right")) - 1)
        part = data[offsets[low] : offsets[high]]
        yield Words(part if fold is None else fold[part], offsets[low : high + 1] - offsets[low], low)
        low = high


def find(parent: dict, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _forest(batches):
    """Edges of a task become (node, smallest node of its tree): as many rows as nodes at most."""
    schema = arrow_schema("a long, b long")
    parent: dict[int, int] = {}

    def out():
        nodes = list(parent)
        return pa.RecordBatch.from_pydict({"a": nodes, "b": [find(parent, x) for x in nodes]}, schema=schema)

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(parent, a), find(parent, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 3 * EDGES_PER_TASK:  # bounded memory: a tree cut in two is joined by the rounds below
            yield out()
            parent.clear()
    yield out()


def components(spark: SparkSession, edges: DataFrame, tag: str) -> DataFrame:
    """(node, component) of every node of edges (a, b: long): the smallest node it reaches.

    Tasks first contract EDGES_PER_TASK edges each, which settles small inputs; then rounds of smallest-neighbour labels with pointer jumping run
    until none changes. Nothing is collected but one count a round; every round is written to the shared folder.
    """
    edges = materialize(spark, edges.select("a", "b"), f"{tag}-given")
    tasks = max(1, -(-edges.count() // EDGES_PER_TASK))
    forest = edges.coalesce(tasks).mapInArrow(tidied(_forest), "a long, b long")
    if tasks == 1:
        return materialize(spark, forest.toDF("node", "component"), f"{tag}-0")
    pairs = forest.where("a <> b")
    pairs = materialize(spark, pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-edges")
    labels = materialize(spark, pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")), f"{tag}-0")
    for n in count(1):
        near = pairs.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("component", "near").alias("via"), F.col("component").alias("before"))
        roots = labels.select(F.col("node").alias("via"), F.col("component").alias("root"))
        after = materialize(spark, lower.join(roots, "via").select("node", F.least("via", "root").alias("component"), "before"), f"{tag}-{n}")
        labels = after.select("node", "component")
        if after.where("component <> before").limit(1).count() == 0:
            return labels
