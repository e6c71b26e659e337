"""Line de-duplication by log templates.

A fixed-depth tree parses every line: words holding a digit become a field, then the path is the number of words and
the first DEPTH words. Inside a leaf, a word stays in the template if its place has that word in at least `min_docs`
of the leaf's lines; a rarer word is a field. A template that keeps fewer than `similarity` percent of a line's words,
or a line of fewer than `min_words` words, is not generalised beyond its digit fields. Templates of at least `min_docs` documents
recur: their lines are dropped from all documents but the first (smallest doc_id), so that no content is lost.

Leaves are counted by (leaf, place, word) over distinct lines, never gathered, and only leaves with enough
documents and two different lines at least are looked into; a leaf's size only adds rows to these counts.

Defined results: null and empty texts have no lines and give an empty text; lines without a word are kept and never
count; a row whose doc_id is null keeps all its lines and gives no template; rows that share a doc_id count as one
document; texts and lines of any length are read whole; of documents with a recurring line the smallest doc_id keeps it. Only the named columns
are read, and `rewrite` passes all others on, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidgraph.llm.common import DIGIT, MIX_A, U64, Words, arrow_schema, fresh, map_batches, materialize, mix, named, signed, tidied, utf8, word_chunks, words_of

DEPTH = 3
#: Hash of a field (fixed value: any number that isn't a likely word hash).
FIELD = U64(0x3C2A3E0000000001)


class Lines:
    """The lines with words of some rows of texts at once.

    row, place (which line of its text), n (words), keys and leaves: one for each line; starts: its first word; hashes: of words,
    those with a digit as a field.
    """

    def __init__(self, words: Words):
        data, self.hashes = words.data, words.hashes
        if (digit := DIGIT[data]).any():
            seen = np.concatenate([[0], np.cumsum(digit, dtype=np.int64)])
            self.hashes = np.where(seen[words.ends] > seen[words.starts], FIELD, self.hashes)
        feeds = np.flatnonzero(data == 10)
        line = np.searchsorted(np.sort(np.concatenate([feeds, words.offsets[:-1]])), words.starts, "right")
        self.starts = np.flatnonzero(np.diff(line, prepend=-1))
        self.n = np.diff(self.starts, append=len(self.hashes))
        at = words.starts[self.starts]
        own = np.searchsorted(words.bounds, self.starts, "right") - 1
        self.row = own + words.low
        self.place = np.searchsorted(feeds, at) - np.searchsorted(feeds, words.offsets[own])
        inside = np.arange(len(self.hashes)) - np.repeat(self.starts, self.n)
        with np.errstate(over="ignore"):
            mixed = mix(self.hashes + inside.astype(U64) * MIX_A)
            size = self.n.astype(U64)
            self.keys = mix(self._sums(mixed) + size)
            self.leaves = mix(self._sums(np.where(inside < DEPTH, mixed, U64(0))) + (size << U64(8)))

    def _sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts) if len(self.starts) else np.empty(0, U64)


def recurring_lines(spark: SparkSession, texts: DataFrame, min_docs: int, similarity: int, min_words: int) -> DataFrame:
    """(doc_id, places, keys): lines that a document loses, by place and key."""

    def parse(batches):
        schema = arrow_schema("doc_id long, line long, leaf long, n int, place int, first boolean")
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            for words in word_chunks(batch.column(1)):
                found = Lines(words)
                order = np.lexsort((found.place, found.keys, found.row))
                row, key = found.row[order], found.keys[order]
                first = np.ones(len(order), bool)
                first[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
                columns = (ids[row], signed(key), signed(found.leaves[order]), found.n[order].astype(np.int32), found.place[order].astype(np.int32), first)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    lines = materialize(spark, texts.where("doc_id is not null").mapInArrow(tidied(parse), "doc_id long, line long, leaf long, n int, place int, first boolean"), "lines")
    each = lines.where("first").select("line", "leaf", "n", "doc_id").distinct().groupBy("line", "leaf", "n").agg(F.count("*").alias("docs"), F.min("doc_id").alias("rep"))
    wide = each.where(F.col("n") >= min_words)
    leaves = wide.groupBy("leaf").agg(F.sum("docs").alias("in_leaf"), F.count("*").alias("kinds")).where((F.col("in_leaf") >= min_docs) & (F.col("kinds") > 1)).select("leaf")
    looked = materialize(spark, wide.join(leaves, "leaf", "left_semi"), "leaves")
    wanted = looked.groupBy(F.col("rep").alias("doc_id")).agg(F.collect_list(F.struct("line", "docs")).alias("wanted"))

    def places(batches):
        schema = arrow_schema("line long, leaf long, docs long, n int, place int, word long")
        for batch in batches:
            parts: list[tuple] = []
            asked = [{c["line"]: c["docs"] for c in chosen} for chosen in batch.column(1).to_pylist()]
            for words in word_chunks(batch.column(0)):
                found = Lines(words)
                seen = set()
                for k, (row, key) in enumerate(zip(found.row.tolist(), signed(found.keys).tolist(), strict=True)):
                    docs = asked[row].get(key)
                    if docs is not None and (row, key) not in seen:
                        seen.add((row, key))
                        n, low = int(found.n[k]), int(found.starts[k])
                        parts.append((np.full(n, key), np.full(n, signed(found.leaves[k : k + 1])[0]), np.full(n, docs), np.full(n, n, np.int32), np.arange(n, dtype=np.int32), signed(found.hashes[low : low + n])))
                if len(parts) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], schema=schema)
                    parts = []
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], schema=schema)

    words = materialize(spark, texts.join(wanted, "doc_id").select("text", "wanted").mapInArrow(tidied(places), "line long, leaf long, docs long, n int, place int, word long").distinct(), "places")  # rows that share the representative's doc_id give its lines again
    common = words.groupBy("leaf", "place", "word").agg(F.sum("docs").alias("support")).where(F.col("support") >= min_docs)
    constant = words.join(common, ["leaf", "place", "word"], "left_semi")
    shape = constant.groupBy("line", "leaf", "n").agg(F.count("*").alias("constants"), F.bit_xor(F.xxhash64("place", "word")).alias("shape"))
    template = materialize(spark, shape.where(100 * F.col("constants") >= similarity * F.col("n")).select("line", F.xxhash64("leaf", "shape").alias("template")), "templates")
    assigned = lines.select("doc_id", "line", "place").join(template, "line", "left").withColumn("template", F.coalesce("template", "line"))
    users = assigned.select("template", "doc_id").distinct().groupBy("template").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))
    recur = materialize(spark, users.where(F.col("docs") >= min_docs), "recurring")  # its own table, so that a hot template's rows can be split in the join
    gone = assigned.join(recur, "template").where("doc_id > first").groupBy("doc_id").agg(F.collect_list(F.struct("place", "line")).alias("gone"))
    return gone.select("doc_id", F.col("gone.place").alias("places"), F.col("gone.line").alias("keys"))


def without(text: bytes | None, places: np.ndarray | None, keys: np.ndarray | None) -> tuple[int, int, bytes]:
    """Lines of a text, lines dropped, and the text without the lines at `places` that have the `keys`."""
    if not text:
        return 0, 0, b""
    if places is None or not len(places):
        return text.count(b"\n") + 1, 0, text
    lines = text.split(b"\n")
    asked = [(p, k) for p, k in zip(places.tolist(), keys.tolist(), strict=True) if p < len(lines)]
    found = Lines(words_of(b"\n".join([lines[p] for p, _ in asked])))
    out = {asked[i][0] for i, k in zip(found.place.tolist(), signed(found.keys).tolist(), strict=True) if asked[i][1] == k}
    return len(lines), len(out), b"\n".join([x for i, x in enumerate(lines) if i not in out])


def dedup_lines(spark: SparkSession, docs: DataFrame, min_docs: int = 10, similarity: int = 75, min_words: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, text without recurring lines, n_lines, n_dropped.

    min_docs: documents from which a template recurs; similarity: percent of a line's words that a template keeps;
    min_words: words from which a line is generalised.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def rebuild(batch):
        for low in range(0, batch.num_rows, 512):
            few = batch.slice(low, 512)
            made = [without(t, _values(p), _values(k)) for t, p, k in zip(utf8(few.column(1)), few.column(2), few.column(3), strict=True)]
            yield {"doc_id": few.column(0), "text": pa.array([m[2] for m in made], pa.binary()).cast(pa.string()), "n_lines": [m[0] for m in made], "n_dropped": [m[1] for m in made]}

    gone = recurring_lines(spark, texts, min_docs, similarity, min_words)
    return map_batches(texts.join(gone, "doc_id", "left").select("doc_id", "text", "places", "keys"), rebuild, "doc_id long, text string, n_lines long, n_dropped long")


def _values(x: pa.ListScalar) -> np.ndarray | None:
    return x.values.to_numpy(zero_copy_only=False) if x.is_valid else None


def rewrite(spark: SparkSession, docs: DataFrame, min_docs: int = 10, similarity: int = 75, min_words: int = 8, dropped: str = "__dropped") -> DataFrame:
    """docs with recurring lines taken out of text, and the number of lines taken out added; all other columns as they are."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    doc, places, keys, new = (fresh(docs.columns, c) for c in ("__doc", "__places", "__keys", "__new"))
    gone = recurring_lines(spark, texts, min_docs, similarity, min_words).toDF(doc, places, keys)

    @F.pandas_udf("text string, dropped long")
    def strip(text: pd.Series, places: pd.Series, keys: pd.Series) -> pd.DataFrame:
        made = [without(None if t is None else t.encode(), p, k) for t, p, k in zip(text, places, keys, strict=True)]
        return pd.DataFrame({"text": [None if t is None else m[2].decode() for t, m in zip(text, made, strict=True)], "dropped": [m[1] for m in made]})

    joined = docs.join(gone, docs["doc_id"] == gone[doc], "left").withColumn(new, strip(docs["text"], places, keys))
    columns = [F.col(f"{new}.text").alias("text") if c == "text" else x for c, x in zip(docs.columns, named(docs.columns), strict=True)]
    return joined.select(*columns, F.col(f"{new}.dropped").alias(dropped))
