"""Quality rules as a ledger of failure bits.

Every rule is measured once per document; the ledger keeps one bit a rule (set: failed) and the measurements. A
policy is a versioned set of rules, hence a mask: a document passes if no masked bit is set. Verdicts of further
policies, and ablations (what would pass without one rule), read the ledger only, by bitwise aggregation.

Defined results: a null text has no words and fails the length rule; a null doc_id and repeated rows are kept, each
with its own row; an empty table gives an empty ledger. Only the two named columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidgraph.llm.common import U64, Rolling, map_batches, mix, utf8

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
TAILS = bytes(range(0x80, 0xC0))
LOWER = bytes(range(97, 123))
UPPER = bytes(range(65, 91))
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_adjacent", "n_marks")
LEDGER = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
_rolling = Rolling(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Rule:
    """bit: its place in the ledger, never used again for another rule; failed: Column over the measurements."""

    bit: int
    name: str
    failed: Callable[[], F.Column]


def _over(part: str, percent: int, whole: str) -> Callable[[], F.Column]:
    return lambda: 100 * F.col(part) > percent * F.col(whole)


#: All thresholds are whole numbers, so that the SQL form of the query agrees to the last row.
RULES = (
    Rule(0, "short", lambda: F.col("n_words") < 20),
    Rule(1, "repeats", _over("n_repeat_words", 30, "n_words")),
    Rule(2, "symbols", _over("n_symbols", 3, "word_chars")),
    Rule(3, "dup_lines", lambda: (100 * F.col("n_dup_lines") > 50 * F.col("n_lines")) & (F.col("n_lines") >= 4)),
    Rule(4, "long_words", lambda: F.col("word_chars") > 14 * F.col("n_words")),
    Rule(5, "short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule(6, "upper", lambda: F.col("n_upper") > F.col("n_lower")),
    Rule(7, "marks", _over("n_marks", 10, "word_chars")),
    Rule(8, "adjacent", _over("n_adjacent", 30, "n_words")),
)
POLICIES = {
    "base": ("short", "repeats"),
    "v1": ("short", "repeats", "symbols", "dup_lines", "long_words", "short_words", "upper", "marks", "adjacent"),
    "v1-loose": ("short", "repeats", "symbols", "upper", "adjacent"),
}


def repeated_words(words: list[bytes], k: int = WINDOW) -> int:
    """Words inside k-word windows that occur twice or more (first ones included); hash matches are compared."""
    n = len(words)
    if n <= k:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    hashes = _rolling.windows(_rolling.prefix(mix(ids.astype(U64) + U64(1))), k)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return 0
    hits = np.zeros(len(hashes), bool)
    hits[order[1:][same]] = hits[order[:-1][same]] = True
    seen: dict[bytes, list[int]] = defaultdict(list)
    for s in np.flatnonzero(hits):
        seen[ids[s : s + k].tobytes()].append(s)
    starts = np.zeros(n + 1, np.int64)
    for at in seen.values():
        if len(at) > 1:
            for s in at:
                starts[s] += 1
                starts[s + k] -= 1
    return int((np.cumsum(starts[:n]) > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """MEASURES of one text."""
    text = text or b""
    words = text.split()
    bare = text.translate(None, SPACES)
    seen, n_lines, n_dup = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip(SPACES):
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
    adjacent = sum(map(bytes.__eq__, words[1:], words))
    return (
        len(words), len(bare.translate(None, TAILS)), len(bare) - len(bare.translate(None, SYMBOLS)), n_dup, repeated_words(words), n_lines,
        len(bare) - len(bare.translate(None, UPPER)), len(bare) - len(bare.translate(None, LOWER)), adjacent, len(bare) - len(bare.translate(None, b"!?")),
    )


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measurements and `failed`: bit r is set where rule r fails."""

    def run(batch):
        rows = [measure(t) for t in utf8(batch.column(1))]
        return {"doc_id": batch.column(0)} | {m: [r[i] for r in rows] for i, m in enumerate(MEASURES)}

    measured = map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, LEDGER)
    bits = [F.when(r.failed(), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("failed", total.cast("long"))


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << r.bit for r in RULES if r.name in rules)


def apply_policy(book: DataFrame, policy: str = "v1", column: str = "kept") -> DataFrame:
    """The ledger with a verdict column by a policy of POLICIES."""
    return book.withColumn(column, F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)


def ablations(book: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail only it (they return if it goes), and that
    pass; from one aggregation of the failure bits (at most 2**rules groups, however many documents)."""
    whole = mask(POLICIES[policy])
    groups = book.groupBy(F.col("failed").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in POLICIES[policy]]
    each = groups.select("bits", "n", F.inline(F.array(*rules)))
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("fail"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("fail_only_this"),
        F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("pass_all"),
    )
