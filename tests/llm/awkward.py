"""Rows that operators must take: nulls in every column, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, line long, rep long, sig long, gone string, `lang_pred` string, key long, n_words string"


def prose(rng: random.Random, n: int) -> str:
    words = ["the", "of", "and", "erth", "tionand", "heou", "été", "über", "niño", "in,", "on.", "thereal"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "x", "yz", str(rng.randrange(9))]) for _ in range(n))


def texts(seed: int = 0) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    base, passage = prose(rng, 200), prose(rng, 60)
    near = base.split()
    near[100] = "changed"
    rows: list[tuple[int | None, str | None]] = [(i, prose(rng, rng.randrange(1, 120))) for i in range(20, 50)]
    rows += [(1, base), (2, base), (3, " ".join(near)), (4, base.upper()), (5, prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30)), (6, passage + " " + prose(rng, 40)), (7, passage)]
    rows += [(8, None), (9, ""), (10, " \t\n\n  \x0b "), (11, "word"), (12, "word"), (13, "two words"), (14, "\n".join(["same line of text here"] * 40)), (15, prose(rng, 20_000))]
    rows += [(None, base), (None, None), (None, "alone and without a name"), (2, base), (16, "no\xa0break space\x85 here \x1c end"), (17, "12 34 5678 !!"), (18, "%%% *** &&&"), (19, "😀 𝔘𝔫𝔦 日本語 عربى")]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), 1, 2, 3, "x", "y", 4, "z") for i, t in rows], DOCS).repartition(3)
