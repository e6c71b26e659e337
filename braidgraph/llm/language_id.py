"""Language identification by a string kernel.

A text's blended spectrum is the set of hashed 1- to ORDERS-grams of its letters (lower case; all else is one
space), as a 0/1 vector over DIMENSIONS; the kernel of two texts is the number of shared grams over the geometric
mean of their counts. The Nyström map of a text is its kernel values with the landmarks times the inverse root of the landmarks' own kernel
matrix, so that products of maps stand for kernels; kernel ridge regression for each language (one against the rest) is ridge regression on these
maps. Batches are scored by two matrix products: with the landmarks, and with the map and all regressions in one.

The model is fitted on the driver from at most `per_language` labelled rows of each language (and SAMPLE_ROWS in
all), taken by a hash of doc_id from the rows that training may use: lang known and crc32(doc_id) mod 5 not 0.
Every row is predicted, from its text alone.

A set of grams fills as a text grows, so a text of more than WINDOW letters and spaces is cut into windows of equal length that cover
all of it; its margins are the means of its windows'. A training row gives one window, chosen by its hash.

Defined results: a null text, or one without a letter, is `und` with score 0; ties go to the language whose name comes first; of repeated rows of a
doc_id and language one is learned from; texts of any length are read whole; a null doc_id is predicted but never held
out or learned from; without any labelled row everything is `und`. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidgraph.llm.common import arrow_schema, map_batches, tidied

ORDERS, BITS = 4, 13
DIMENSIONS = 1 << BITS
WINDOW = 2048
PER_LANGUAGE, SAMPLE_ROWS, LANDMARKS, RIDGE = 400, 8000, 192, 1e-3
PREDICTED = "doc_id long, lang_pred string, score double"
#: Odd multipliers of the gram hashes (fixed values).
STEP, FINAL = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_letters = np.array([chr(c).isalpha() for c in range(0x3000)])


def letters(text: str | None) -> np.ndarray | None:
    """Code points of a text's letters, all else one space; None without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = codes < len(_letters)
    letter = _letters[np.where(known, codes, 0)]
    if not known.all():
        kinds, where = np.unique(codes[~known], return_inverse=True)
        letter[~known] = np.array([chr(k).isalpha() for k in kinds], bool)[where]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.concatenate([[np.uint32(32)], np.where(letter, codes, np.uint32(32))[keep]]).astype(np.uint32)


def presence(c: np.ndarray) -> np.ndarray:
    """The 0/1 vector of the grams of some letters."""
    out = np.zeros(DIMENSIONS, np.uint8)
    h = np.zeros(len(c), np.uint32)
    for n in range(1, min(ORDERS, len(c)) + 1):
        h = (h[: len(c) - n + 1] ^ c[n - 1 :]) * STEP
        h ^= h >> np.uint32(15)
        out[((h + np.uint32(n)) * FINAL) >> np.uint32(32 - BITS)] = 1
        h = h[:-1]
    return out


def spectrum(text: str | None) -> np.ndarray | None:
    """The 0/1 vector of a whole text, None without a letter."""
    c = letters(text)
    return None if c is None else presence(c)


def cuts(c: np.ndarray) -> np.ndarray:
    """Where the windows of some letters start, and the end of the last."""
    n = -(-len(c) // WINDOW)
    return np.arange(n + 1) * len(c) // n


def window(c: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The 0/1 vector of window k; grams that reach into the next window count here."""
    return presence(c[at[k] : at[k + 1] + ORDERS - 1])


@dataclass
class Model:
    """landmarks: DIMENSIONS x m, columns scaled by their own count; weights: m x languages, the inverse root times the regressions."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def kernel(self, vectors: np.ndarray) -> np.ndarray:
        """Of texts with the landmarks."""
        shared = vectors.astype(np.float32) @ self.landmarks
        return shared / np.sqrt(np.maximum(vectors.sum(axis=1, keepdims=True, dtype=np.float32), 1))

    def margins(self, vectors: np.ndarray) -> np.ndarray:
        return self.kernel(vectors) @ self.weights

    def predict(self, vectors: np.ndarray) -> tuple[list[str], np.ndarray]:
        return self.choose(self.margins(vectors))

    def choose(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        best = margins.argmax(axis=1)
        return [self.languages[b] for b in best], np.clip((margins[np.arange(len(best)), best] + 1) / 2, 0, 1).astype(float)


def train(vectors: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression in the span of landmarks that are taken evenly from every language; languages count alike, however many
    rows they have; `ridge` times the number of rows is the penalty on the squared norm of a regression."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    turn = np.empty(len(y), np.int64)
    for k in range(len(languages)):
        turn[y == k] = np.arange((y == k).sum())
    chosen = np.lexsort((y, turn))[:landmarks]
    z = vectors[chosen].astype(np.float32)
    model = Model(languages, np.ascontiguousarray((z / np.sqrt(np.maximum(z.sum(axis=1, keepdims=True), 1))).T), np.zeros((len(z), len(languages)), np.float32))
    values, axes = np.linalg.eigh(model.kernel(z).astype(np.float64))
    seen = values > 1e-6 * values.max()  # equal landmarks add nothing
    root = axes[:, seen] / np.sqrt(values[seen])
    mapped = model.kernel(vectors).astype(np.float64) @ root
    weight = (len(y) / np.bincount(y, minlength=len(languages))[y] / len(languages))[:, None]
    targets = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    gram = mapped.T @ (mapped * weight) + ridge * len(y) * np.eye(mapped.shape[1])
    model.weights = (root @ np.linalg.solve(gram, mapped.T @ (targets * weight))).astype(np.float32)
    return model


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(spark: SparkSession, docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from a bounded sample of the labelled rows of docs (doc_id, text, lang); None without any."""
    usable = docs.where("doc_id is not null and text is not null and lang is not null").where(~held_out()).select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("rank"))
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return None
    each = max(1, min(per_language, SAMPLE_ROWS // len(counts)))
    limits = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, 2.0 * each / n) * (1 << 40))))])

    def vectors(batches):
        schema = arrow_schema("lang string, rank long, bits binary")
        for batch in batches:
            made = []
            for k, t, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (c := letters(t)) is not None:
                    at = cuts(c)
                    made.append((k, r, np.packbits(window(c, at, r % (len(at) - 1))).tobytes()))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    # about 2 * `each` doc_ids a language, one row and 1 kB each
    sample = usable.where(F.col("rank") < limits[F.col("lang")]).mapInArrow(tidied(vectors), "lang string, rank long, bits binary").groupBy("lang", "rank").agg(F.min("bits").alias("bits"))
    rows = sorted(sample.collect(), key=lambda r: (r.lang, r.rank))
    taken: dict[str, int] = {}
    rows = [r for r in rows if taken.update({r.lang: taken.get(r.lang, 0) + 1}) or taken[r.lang] <= each]
    if not rows:
        return None
    return train(np.unpackbits(np.array([np.frombuffer(bytes(r.bits), np.uint8) for r in rows]), axis=1), [r.lang for r in rows])


def _predict_some(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float]]:
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    if model is None:
        return lang, score
    margins, windows = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    vectors: list[np.ndarray] = []
    owners: list[int] = []

    def add():
        if vectors:
            np.add.at(margins, owners, model.margins(np.array(vectors)))
            vectors.clear()
            owners.clear()

    for n, t in enumerate(texts):
        if (c := letters(t)) is None:
            continue
        at = cuts(c)
        for k in range(len(at) - 1):
            vectors.append(window(c, at, k))
            owners.append(n)
            if len(vectors) == 128:
                add()
        windows[n] = len(at) - 1
    add()
    some = np.flatnonzero(windows)
    for n, k, s in zip(some.tolist(), *model.choose(margins[some] / windows[some, None]), strict=True):
        lang[n], score[n] = k, float(s)
    return lang, score


def predict(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """PREDICTED for every row of docs (doc_id, text)."""
    shared = spark.sparkContext.broadcast(model)  # DIMENSIONS x LANDMARKS numbers

    def run(batch):
        for low in range(0, batch.num_rows, 128):
            few = batch.slice(low, 128)
            lang, score = _predict_some(few.column(1).to_pylist(), shared.value)
            yield {"doc_id": few.column(0), "lang_pred": lang, "score": score}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PREDICTED)


def tag(spark: SparkSession, docs: DataFrame, model: Model | None, name: str = "__language") -> DataFrame:
    """docs with a struct column (lang_pred, lang_score) added, row by row (no join by id)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, lang_score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        found = [_predict_some(texts.iloc[low : low + 128].tolist(), shared.value) for low in range(0, len(texts), 128)]
        return pd.DataFrame({"lang_pred": [k for part in found for k in part[0]], "lang_score": [s for part in found for s in part[1]]})

    return docs.withColumn(name, guess("text"))


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs, by a model fitted on its own labelled rows."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return predict(spark, slim, fit(spark, slim)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
