"""Clusters that shared passages chain together, and filters by bit tables."""

import random

import pytest
from pyspark.sql import functions as F

from braidgraph.llm import common, ngram_join
from tests.llm.test_joins import plain_documents


def chained_rows(seed, n=60):
    """Documents with half of their words in passages that they share with others, near copies of some, and two texts of one doc_id."""
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(10**6)}" for _ in range(12)] for _ in range(8)]
    rows = []
    for i in range(n):
        words = [w for p in rng.sample(passages, 3) for w in p] + [f"w{rng.randrange(10**6)}" for _ in range(30)]
        rows.append((10 * i, " ".join(words)))
        if i % 5 == 0:
            rows.append((10 * i + 1, " ".join([*words[:-1], "edited"])))
        if i % 20 == 0:
            rows.append((10 * i, " ".join([*words, "longer"])))
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_large_clusters_are_contracted_anew(spark, k, percent, monkeypatch):
    """Blocks of 4 sets: no more than the near copies meet, whatever passages the documents share, and no link is lost."""
    written = {}
    write = ngram_join.materialize
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    # every document of the input is a candidate of every other one
    monkeypatch.setattr(ngram_join, "materialize", lambda s, df, tag: written.setdefault(tag, write(s, everybody(df) if tag == "candidates" else df, tag)))
    rows = chained_rows(3)
    everybody = lambda df: df.union(spark.createDataFrame([(i, 0) for i, _ in rows if i], "a long, b long")).distinct()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(spark, docs, k, percent).collect())
    assert got == sorted(plain_documents(rows, k, percent))
    assert max(r["count"] for r in written["placed"].groupBy("cluster").count().collect()) <= 4


def test_bit_tables(spark, monkeypatch):
    """All ids are found, null keys are with those that aren't; few others are found, and a full table filters nothing."""
    docs = spark.range(-20_000, 20_000).select(F.when(F.col("id") % 1000 != 7, F.col("id") * 3).alias("doc_id"))
    ids = docs.where("doc_id % 20 = 0").toDF("x")
    bits = common.id_bits(spark, ids, "x")
    inside, outside = (common.may_hold(docs, docs["doc_id"], bits, negate=n) for n in (False, True))
    assert inside.count() + outside.count() == 40_000 and outside.where("doc_id is null").count() == 20
    assert inside.where("doc_id % 20 = 0").count() == ids.count() and inside.count() < 0.2 * 40_000
    assert common.may_hold(docs, docs["doc_id"], common.id_bits(spark, ids.limit(0), "x")).count() == 0
    monkeypatch.setattr(common, "MOST_BITS", 64)
    few = common.id_bits(spark, ids, "x")
    assert few[1] == 64 and common.may_hold(docs, docs["doc_id"], few).where("doc_id % 20 = 0").count() == ids.count()
