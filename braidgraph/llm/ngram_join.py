"""N-gram Jaccard join: universe-partition pigeonhole over sets of word shingles.

Two sets of sizes s <= r with |A & B| / |A | B| >= t differ in at most s * (1 - t) / t elements. In the size band
[low, high] of the smaller set, this bound is H = floor(high * (1 - t) / t). The hashed universe is
cut into m segments, and each segment i gets an allowance e_i: 0 (the two subsets there are equal) or 1 (they differ
by one element at most, found through one-deletion neighbourhoods). With sum(e_i + 1) = H + g, the segments in which
any linking pair agrees within the allowance weigh g at least (a segment weighs e_i + 1). Equal subsets are tiny in both sets or
in neither, and a subset is hot (held by more than HOT documents, with SMALL elements at most) for all its documents or for none. So a set with few
tiny subsets in segments of allowance 0 needn't tell these, and one with few hot ones needn't meet others in them: g - 1 agreements may be lost in all,
shared out between the two kinds, and every linking pair still meets in another signature. `allocate` picks m, the allowances and g for a band at least cost,
from the exact count of its documents: signatures written against pairs that meet by chance in an empty subset. Chance
pairs grow with the square of the count, so larger inputs get more to spare. A set writes signatures for its own band and for
every band that holds sizes down to t times its own.

Signatures are gathered by task into sheaves: within one, a subset's documents become a star around one of them, which alone goes on (of hot and of
deleted subsets a few documents go on), so that a family of copies doesn't send a row a copy to one place. Sheaves are dealt out by ranges of
signatures, and each range is settled by sorting. A range gives stars, and the memberships in hot subsets; these are counted by document, and only
documents with more of them than their band has to spare meet there.

Sharing a signature makes candidates, never links. Candidates are kept as stars (document, another document of the
signature), contracted to clusters. Passages that many documents share chain these to clusters that grow with the input, so clusters above a block
are contracted anew, from the shingles that their sets have in common (`closer`). The sets of a cluster are cut by size into classes, so that linking sets are in one class or in two neighbouring
ones, and classes into blocks of bounded size; blocks are compared in pairs
by counting matrix products: exact intersections, no pair rows. A block returns a spanning forest of its links and
the number of links of each member. Documents with equal sets are one class throughout.

Sets are compared as 64-bit shingle hashes, classes by 128 bits.

Defined results: null and empty texts have no shingles, link with nothing and are their own component; fewer words
than a shingle make one shingle of all; rows that share a doc_id are one document, which links with all that any of them links with, each row keeping
its own n_shingles and n_links; a row whose doc_id is null takes part through its class only, and its component is null if no
other row has its set; texts of any length are read whole. Only the two named columns are read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidgraph.llm.common import MIX_A, MIX_B, U64, arrow_schema, components, id_bits, map_batches, materialize, may_hold, mix, signed, tidied, word_chunks

FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Upper sizes of bands grow by this factor (from DENSE percent on, or below); members compared in one block.
BAND_GROWTH, FINE_GROWTH, DENSE, BLOCK = 1.4, 1.2, 88, 256
#: Expected elements of a subset from which one of a single element counts as tiny, as empty ones do; cost of a pair that meets by chance, in signatures.
FULL, PAIR_COST = 4.0, 50.0
#: A subset of at most SMALL elements is hot if more than HOT documents have it; of deleted subsets alone, a task sends CROWD documents on.
HOT, SMALL, CROWD = 1, 5, 32
#: Signatures and documents of a sheaf, signatures of a range; the bits of a signature that are kept, beside its range.
SHEAF, SHEAF_DOCS, RANGE, KEPT_BITS = 1 << 20, 60_000, 1 << 20, 40
#: Flags in the lowest bits of a signature: of a subset without one of its elements; of a subset that may be hot.
DELETED, MAY_BE_HOT = U64(1), U64(2)


def _sequences(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word sequences."""
    with np.errstate(over="ignore"):
        out = h[: len(h) - k + 1]
        for i in range(1, k):
            out = mix(out * MIX_A + h[i : len(h) - k + 1 + i])
        return mix(out + U64(k))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; with fewer words, of all its words as one."""
    for w in word_chunks(texts, FOLD):
        long_ = _sequences(w.hashes, k) if len(w.hashes) >= k else np.empty(0, U64)
        for _, a, b in w.rows():
            yield np.unique(long_[a : b - k + 1]) if b - a >= k else _sequences(w.hashes[a:b], b - a) if b > a else np.empty(0, U64)


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        return int(mix(s ^ MIX_A).sum(dtype=U64).view(np.int64)), int(mix(s * MIX_B + MIX_A).sum(dtype=U64).view(np.int64))


class Bands:
    """Size bands and the difference bound of each, for a threshold of percent / 100."""

    def __init__(self, percent: int):
        self.percent, self.highs, self.growth = percent, [1], BAND_GROWTH if percent >= DENSE else FINE_GROWTH

    def _grow(self, size: int) -> None:
        while self.highs[-1] < size:
            self.highs.append(max(self.highs[-1] + 1, int(self.highs[-1] * self.growth)))

    def of(self, size: int) -> int:
        self._grow(size)
        return bisect_left(self.highs, size)

    def bound(self, band: int) -> int:
        while len(self.highs) <= band:
            self._grow(self.highs[-1] + 1)
        return self.highs[band] * (100 - self.percent) // self.percent

    def joined(self, size: int) -> range:
        """Bands in which a set of this size has to be found: of all sizes that it may link with, up to its own."""
        return range(self.of(max(1, -(-size * self.percent // 100))), self.of(size) + 1)


def tiny(mean: float) -> int:
    """Elements that a tiny subset has at most, if `mean` are expected."""
    return int(mean >= FULL)


def hot_spare(spare: int) -> int:
    """Of the agreements to spare: hot subsets from which on a set meets others in them. Tiny ones take the rest."""
    return 1 + spare // 3


def tiny_spare(spare: int) -> int:
    """Tiny subsets from which on a set tells them."""
    return spare + 1 - hot_spare(spare)


def _below(n: int, p: float, k: int) -> float:
    """Chance that fewer than k of n are hit, each with chance p."""
    if n > 60 and n * p > 8:
        return 0.5 * math.erfc((n * p - k + 0.5) / math.sqrt(2 * n * p * (1 - p)))
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(min(k, n + 1)))


@lru_cache(4096)
def allocate(bound: int, high: int, n_docs: int, growth: float = BAND_GROWTH) -> tuple[int, int, int]:
    """(exact, deleting, spare): numbers of segments with allowance 0 and 1 and of agreements to spare, with
    exact + 2 * deleting = bound + spare, that cost least for n_docs sets of up to `high` elements: signatures written, and PAIR_COST
    for each pair that is expected to meet because a subset of both is empty."""
    best: tuple = ()
    for deleting in sorted({0, 1, 2, (bound + 1) // 4, (bound + 1) // 2} & set(range((bound + 1) // 2 + 1))):
        spare = 0
        while spare < bound + 3:
            spare += 1 + spare // 6
            exact = bound + spare - 2 * deleting
            mean = high / growth / (exact + deleting)
            p = min(math.exp(-mean) * sum(mean**k / math.factorial(k) for k in range(tiny(mean) + 1)), 1 - 1e-12)
            all_told = max(0.0, 1 - _below(exact, p, tiny_spare(spare)))  # sets with so many tiny subsets that these have to be told
            chance = math.exp(-2 * mean) * (exact * all_told**2 + deleting * (1 + 2 * mean))
            cost = n_docs * (exact + deleting * (2 + mean)) + PAIR_COST * n_docs * n_docs / 2 * chance
            if not best or cost < best[0]:
                best = (cost, exact, deleting, spare)
    return best[1:]


def told(s: np.ndarray, plans: dict[int, tuple[int, int, int]], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of a set, flags in their lowest bits, and the band of each: for each band that it joins, a hash of every segment's subset,
    and for segments with allowance 1 also a hash of that subset without each of its elements. Tiny subsets of segments
    with allowance 0 are left out if there are few enough of them."""
    out, at = [], []
    element = mix(s * MIX_A + MIX_B)
    with np.errstate(over="ignore"):
        for band in bands.joined(len(s)):
            if bands.bound(band) == 0:
                continue  # only equal sets link here, and these are one class already
            exact, deleting, spare = plans[band]
            m = exact + deleting
            segment = ((element >> U64(33)) % U64(m)).astype(np.int64)
            sums = np.zeros(m, U64)
            np.add.at(sums, segment, element)
            salt = mix((U64(band) << U64(32)) + np.arange(m, dtype=U64))
            sizes = np.bincount(segment, minlength=m)
            tell = sizes > tiny(bands.highs[band] / bands.growth / m)
            tell[exact:] = True
            if m - np.count_nonzero(tell) >= tiny_spare(spare):
                tell[:] = True
            small = sizes <= SMALL
            small[exact:] = False
            found = [(mix(sums + salt) & ~U64(3) | np.where(small, MAY_BE_HOT, U64(0)))[tell]]
            if deleting:
                inside = segment >= exact
                of = segment[inside]
                found.append(mix(sums[of] - element[inside] + salt[of]) & ~U64(3) | DELETED)
            out += found
            at.append(np.full(sum(map(len, found)), band, np.uint8))
    return (np.concatenate(out), np.concatenate(at)) if out else (np.empty(0, U64), np.empty(0, np.uint8))


def signatures(s: np.ndarray, plans: dict[int, tuple[int, int, int]], bands: Bands) -> np.ndarray:
    """The signatures of a set, without flags."""
    return np.unique(told(s, plans, bands)[0] & ~U64(3))


def _groups(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted signatures: where each group starts, its size, and each one's place in its group. Whole subsets come before deleted ones."""
    start = np.flatnonzero(np.r_[True, sig[1:] >> U64(1) != sig[:-1] >> U64(1)]) if len(sig) else np.empty(0, np.int64)
    size = np.diff(start, append=len(sig))
    return start, size, np.arange(len(sig)) - np.repeat(start, size)


def _once(*columns: np.ndarray) -> list[np.ndarray]:
    """Distinct rows."""
    if not len(columns[0]):
        return list(columns)
    order = np.lexsort(columns)
    columns = tuple(c[order] for c in columns)
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return [c[new] for c in columns]


def _range_of(sig: np.ndarray, ranges: int) -> np.ndarray:
    return ((sig >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)


def _hot_key(at: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Names a hot subset by its range and the kept bits."""
    return signed(mix((at.astype(U64) << U64(KEPT_BITS)) ^ (sig & U64((1 << KEPT_BITS) - 1))))


SHEAVES = "at long, docs binary, doc binary, sigs binary, bands binary, stars binary, hot binary"


class Sheaf:
    """Signatures of some documents, on their way to their ranges."""

    def __init__(self, ranges: int):
        self.ranges = ranges
        self.clear()

    def clear(self) -> None:
        self.docs, self.sigs, self.bands, self.size = [], [], [], 0

    def add(self, doc: int, sigs: np.ndarray, bands: np.ndarray) -> bool:
        """Whether the sheaf is full."""
        if len(sigs):
            self.docs.append(doc)
            self.sigs.append(sigs)
            self.bands.append(bands)
            self.size += len(sigs)
        return self.size >= SHEAF or len(self.docs) >= SHEAF_DOCS

    def out(self) -> pa.RecordBatch:
        """SHEAVES: for each range the documents, and of each signature its document, kept bits and band; stars (two documents each); and
        memberships in subsets that are hot already (document, subset, band)."""
        docs = np.array(self.docs, np.int64)
        doc = np.repeat(np.arange(len(docs)), [len(x) for x in self.sigs])
        sig, band = np.concatenate(self.sigs), np.concatenate(self.bands)
        self.clear()
        order = np.argsort(sig, kind="stable")
        sig, doc, band = sig[order], doc[order], band[order]
        start, size, place = _groups(sig)
        first, of = np.repeat(start, size), np.repeat(size, size)
        small, whole = (sig & MAY_BE_HOT) != 0, (sig[first] & DELETED) == 0
        many = of > CROWD
        goes_on = np.where(small, place <= HOT, (place == 0) | ~whole & ~many)
        star, hot = ~small & (place > 0) & (whole | many), small & ~goes_on
        at = _range_of(sig, self.ranges)  # rises with sig
        stars = np.stack([docs[doc[star]], docs[doc[first[star]]]], axis=1)
        hots = np.stack([docs[doc[hot]], _hot_key(at[hot], sig[hot]), band[hot].astype(np.int64)], axis=1)
        names, low = np.unique(at, return_index=True)
        high = np.append(low[1:], len(at))
        kept_upto, star_upto, hot_upto = (np.concatenate([[0], np.cumsum(x)]) for x in (goes_on, star, hot))
        sig, doc, band = sig[goes_on], doc[goes_on], band[goes_on]
        kept = sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEPT_BITS // 8]
        rows: list[tuple] = []
        for name, a, b in zip(names.tolist(), low.tolist(), high.tolist(), strict=True):
            part = slice(kept_upto[a], kept_upto[b])
            by_doc = np.argsort(doc[part], kind="stable")  # neighbours alike: compresses well
            who, where = np.unique(doc[part], return_inverse=True)
            s, h = slice(star_upto[a], star_upto[b]), slice(hot_upto[a], hot_upto[b])
            rows.append((name, docs[who].tobytes(), where[by_doc].astype(np.uint16).tobytes(), kept[part][by_doc].tobytes(), band[part][by_doc].tobytes(), np.stack(_once(*stars[s].T), axis=1).tobytes(), hots[h].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow_schema(SHEAVES), strict=True)], schema=arrow_schema(SHEAVES))


FOUND = "hot boolean, a long, b long, band int"


def _settle_ranges(batches):
    """Sheaves sorted by range -> FOUND: stars (two documents), and memberships in hot subsets (document, subset, band)."""
    schema = arrow_schema(FOUND)
    open_: list[tuple] = []
    at = None

    def found(stars: np.ndarray, hots: np.ndarray) -> pa.RecordBatch:
        a, b = _once(stars[:, 0], stars[:, 1])
        n, m = len(a), len(hots)
        columns = np.repeat([False, True], [n, m]), np.concatenate([a, hots[:, 0]]), np.concatenate([b, hots[:, 1]]), np.concatenate([np.zeros(n, np.int32), hots[:, 2].astype(np.int32)])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def close() -> pa.RecordBatch:
        docs = np.concatenate([np.frombuffer(d, np.int64)[np.frombuffer(w, np.uint16)] for d, w, *_ in open_])
        bits = np.frombuffer(b"".join(x[2] for x in open_), np.uint8).reshape(-1, KEPT_BITS // 8)
        sig = np.zeros((len(bits), 8), np.uint8)
        sig[:, : KEPT_BITS // 8] = bits
        sig, band = sig.reshape(-1).view("<u8").astype(U64), np.frombuffer(b"".join(x[3] for x in open_), np.uint8)
        order = np.argsort(sig, kind="stable")
        sig, docs, band = sig[order], docs[order], band[order]
        start, size, place = _groups(sig)
        first, of = np.repeat(start, size), np.repeat(size, size)
        hot = ((sig & MAY_BE_HOT) != 0) & (of > HOT)
        star = ~hot & (place > 0) & ((sig[first] & DELETED) == 0) & (docs != docs[first])
        stars = [np.stack([docs[star], docs[first[star]]], axis=1), *(np.frombuffer(x[4], np.int64).reshape(-1, 2) for x in open_)]
        hots = [np.stack([docs[hot], _hot_key(np.full(int(hot.sum()), at), sig[hot]), band[hot].astype(np.int64)], axis=1), *(np.frombuffer(x[5], np.int64).reshape(-1, 3) for x in open_)]
        open_.clear()
        return found(np.concatenate(stars), np.concatenate(hots))

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if row[0] != at:
                if open_:
                    yield close()
                at = row[0]
            open_.append(row[1:])
    if open_:
        yield close()


def blocks_of(members: list[np.ndarray], percent: int) -> np.ndarray:
    """Links (boolean matrix) between sets: intersections by products of 0/1 blocks over shared elements."""
    n = len(members)
    sizes = np.array([len(x) for x in members], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    keep = count[column] > 1
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((n, n), np.float32)
    if len(column):
        column = np.cumsum(np.r_[0, column[1:] != column[:-1]])
        width = 2048
        for low in range(0, int(column[-1]) + 1, width):
            a, b = np.searchsorted(column, [low, low + width])
            part = np.zeros((n, min(width, int(column[-1]) + 1 - low)), np.float32)
            part[owner[a:b], column[a:b] - low] = 1
            shared += part @ part.T
    shared = shared.astype(np.int64)
    np.fill_diagonal(shared, sizes)
    return 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)


def settle(links: np.ndarray) -> np.ndarray:
    """Smallest index that each row of a symmetric boolean matrix reaches."""
    n = len(links)
    label = np.arange(n)
    while True:
        after = np.where(links, label[None, :], n).min(axis=1)
        after = after[after]
        if (after == label).all():
            return label
        label = after


LINKS = "a long, b long, links long, k1 long"


def _verify(percent: int):
    """Reads rows (task, side, rep, copies, k1, set) sorted by task; returns LINKS: a representative, the smallest that it reaches in its
    task, the rows that its set (of key k1) links with there."""
    schema = arrow_schema(LINKS)

    def one(rows: list[tuple]) -> list[np.ndarray]:
        rows = sorted({r[1:3] + (r[4],): r for r in rows}.values(), key=lambda r: r[2])  # repeated rows come again
        side, reps, copies, k1 = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3, 4))
        if len(rows) < 2 or side[0] >= 0 and (side == side[0]).all():
            return [np.empty(0, np.int64)] * 4
        links = blocks_of([r[5] for r in rows], percent) & ((side[:, None] != side[None, :]) | (side[0] < 0))
        np.fill_diagonal(links, True)
        lowest = settle(links)
        np.fill_diagonal(links, False)
        linked = links.any(axis=1)
        return [x[linked] for x in (reps, reps[lowest], links @ copies, k1)]

    def run(batches):
        open_, at, made, size = [], None, [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*made, strict=True)], schema=schema)

        for batch in batches:
            *columns, sets = (batch.column(i) for i in range(6))
            for *head, s in zip(*(c.to_pylist() for c in columns), sets, strict=True):
                if head[0] != at:
                    if len(open_) > 1:
                        made.append(one(open_))
                        size += len(open_)
                    open_, at = [], head[0]
                open_.append((*head, s.values.to_numpy(zero_copy_only=False).view(U64)))
            if size > 20_000:
                yield out()
                made, size = [], 0
        if len(open_) > 1:
            made.append(one(open_))
        if made:
            yield out()

    return run


def closer(spark: SparkSession, large: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(rep, cluster) of the sets (rep, cluster, k1, k2) of large clusters that may link with another one, in clusters as small or smaller.

    Sets of which one has n shingles link only if they share percent / 100 * n of them. So, with the shingles of a cluster in one order, they share one
    among the first n * (1 - percent / 100) + 1 of each. The order is by how many sets of the cluster have a shingle, rare ones first: those
    of one set alone come first of all and meet nobody. Links are looked for among these first shingles' stars; none is lost.
    """

    def sets_of(batch):
        for few, sets in own_sets(batch, k):
            yield {c: few.column(c) for c in ("cluster", "rep", "k1")} | {"shingles": sets}

    chosen = texts.join(large, texts.doc_id == large.rep).select("cluster", "rep", "k1", "k2", "text")
    sets = materialize(spark, map_batches(chosen, sets_of, "cluster long, rep long, k1 long, shingles array<long>").distinct(), "large-sets")
    held = sets.select("cluster", "rep", "k1", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))
    common = held.groupBy("cluster", "shingle").agg(F.count("*").alias("holders")).where("holders > 1")
    found = held.join(common, ["cluster", "shingle"]).groupBy("cluster", "rep", "k1", "n").agg(F.sort_array(F.collect_list(F.struct("holders", "shingle"))).alias("shared"))
    first = F.expr(f"n - ceil(n * {percent}L / 100) + 1").cast("long") - (F.col("n") - F.size("shared"))  # without the shingles that no other set has
    met = materialize(spark, found.select("cluster", "rep", F.explode(F.slice("shared", 1, F.greatest(first, F.lit(0)).cast("int"))).alias("at")).select("cluster", "rep", F.col("at.shingle").alias("shingle")), "large-met")
    centres = met.groupBy("cluster", "shingle").agg(F.min("rep").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = materialize(spark, met.join(centres, ["cluster", "shingle"]).select(F.col("rep").alias("a"), "b").distinct(), "large-edges")
    joined = components(spark, edges.where("a <> b"), "closer").select(F.col("node").alias("rep"), "component")
    # texts of one doc_id that meet nobody else still meet each other
    return edges.select(F.col("a").alias("rep")).union(edges.select("b")).distinct().join(joined, "rep", "left").select("rep", F.coalesce("component", "rep").alias("cluster"))


def own_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
    """Rows (k1, k2, text, ..) in small parts with their sets; another text of the same doc_id isn't the class that a row names and goes."""
    for low in range(0, batch.num_rows, 256):
        few = batch.slice(low, 256)
        keys = list(zip(few.column("k1").to_pylist(), few.column("k2").to_pylist(), strict=True))
        sets = list(shingle_sets(few.column("text"), k))
        own = [i for i, x in enumerate(sets) if len(x) and set_keys(x) == keys[i]]
        flat = np.concatenate([*(sets[i] for i in own), np.empty(0, U64)])
        offsets = np.cumsum([0, *(len(sets[i]) for i in own)])
        yield few.take(pa.array(own, pa.int64())), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(signed(flat)))


def jaccard_components(spark: SparkSession, docs: DataFrame, k: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_links (rows that it
    links with, those with an equal set included)."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def describe(batch):
        bands, made = Bands(percent), []
        for s in shingle_sets(batch.column(1), k):
            made.append((len(s), *set_keys(s), list(bands.joined(len(s))) if len(s) else []))
        n, k1, k2, joined = zip(*made, strict=True) if made else ((), (), (), ())
        return {"doc_id": batch.column(0), "n_shingles": n, "k1": k1, "k2": k2, "bands": joined}

    rows = materialize(spark, map_batches(texts, describe, "doc_id long, n_shingles long, k1 long, k2 long, bands array<int>"), "rows")
    classes = materialize(spark, rows.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    counts = {r.band: r.n for r in rows.where("doc_id is not null").select(F.explode("bands").alias("band")).groupBy("band").agg(F.count("*").alias("n")).collect()}  # bands: logarithm of the longest text
    bands = Bands(percent)
    plans = {b: allocate(bands.bound(b), bands.highs[b], n, bands.growth) for b, n in counts.items()}

    expected = sum(n * (plans[b][0] + plans[b][1] + (bands.highs[b] + plans[b][1] if plans[b][1] else 0)) for b, n in counts.items())
    ranges = min(1 << 31, max(256, -(-expected // RANGE)))

    def sign(batches):
        bands, seen, sheaf = Bands(percent), set(), Sheaf(ranges)
        for batch in batches:
            for i, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k), strict=True):
                if not len(s) or (key := set_keys(s)) in seen:
                    continue  # an equal set of this task has written the same signatures
                if len(seen) < 200_000:
                    seen.add(key)
                if sheaf.add(i, *told(s, plans, bands)):
                    yield sheaf.out()
        if sheaf.size:
            yield sheaf.out()

    sheaves = texts.where("doc_id is not null").mapInArrow(tidied(sign), SHEAVES)
    found = materialize(spark, sheaves.repartition("at").sortWithinPartitions("at").mapInArrow(tidied(_settle_ranges), FOUND), "found")
    hot = found.where("hot").select(F.col("a").alias("doc"), F.col("b").alias("subset"), "band")
    spares = F.create_map(*[F.lit(x) for b, p in plans.items() for x in (b, hot_spare(p[2]))]) if plans else F.create_map(F.lit(0), F.lit(1))
    crowded = hot.groupBy("doc", "band").agg(F.count("*").alias("n")).where(F.col("n") >= spares[F.col("band")]).select("doc", "band")
    meeting = materialize(spark, hot.join(crowded, ["doc", "band"]).select("doc", "subset"), "meeting")
    centres = materialize(spark, meeting.groupBy("subset").agg(F.min("doc").alias("first")), "centres")  # its own table, so that a hot subset's rows can be split in the join
    stars = found.where("not hot").select(F.col("a").alias("doc"), F.col("b").alias("first")).union(meeting.join(centres, "subset").select("doc", "first")).where("doc <> first")
    to_rep = rows.where("doc_id is not null and n_shingles > 0").join(classes, ["k1", "k2", "n_shingles"]).select("doc_id", "rep")
    a, b = to_rep.toDF("doc", "a"), to_rep.toDF("first", "b")
    candidates = materialize(spark, stars.distinct().join(a, "doc").join(b, "first").where("a <> b").select("a", "b").distinct(), "candidates")
    clusters = components(spark, candidates, "clusters").select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    named = classes.where("rep is not null")
    #: Only the texts of candidates are dealt out.
    near = may_hold(texts, F.col("doc_id"), id_bits(spark, clusters, "rep"))
    before = math.inf
    while percent > 0:
        large = clusters.join(clusters.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("cluster"), "cluster")
        large = materialize(spark, large.join(named, "rep").select("rep", "cluster", "k1", "k2"), "large")
        n = large.count()
        if n == 0 or n > 0.9 * before:
            break
        before = n
        smaller = closer(spark, large, near, k, percent)
        clusters = materialize(spark, clusters.join(large.select("cluster").distinct(), "cluster", "left_anti").select("rep", "cluster").union(smaller), "closer")
    #: A little more than the ratio of sizes that can link: these are in the same class, or in the next.
    whole = clusters.groupBy("cluster").agg((F.count("*") <= BLOCK).alias("small"))
    rank = F.when(F.col("small") | (percent < 1), 0).otherwise(F.floor(F.log(F.col("n_shingles").cast("double")) / (1.001 * math.log(100 / max(1, min(percent, 99))))).cast("int"))
    members = materialize(spark, clusters.join(whole, "cluster").join(named, "rep").withColumn("rank", rank).drop("small"), "members")
    sizes = members.groupBy("cluster", "rank").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    beside = [sizes.select("cluster", (F.col("rank") + step).alias("rank"), F.col("parts").alias(name)) for step, name in ((1, "below"), (-1, "above"))]
    for x in (sizes, *beside):
        members = members.join(x, ["cluster", "rank"], "left")
    members = members.fillna(0, ["below", "above"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    members = materialize(spark, members, "placed")

    def sets_of(batch):
        for few, sets in own_sets(batch, k):
            yield {c: few.column(c) for c in ("cluster", "rank", "parts", "below", "above", "part", "rep", "copies", "k1")} | {"shingles": sets}

    chosen = near.join(members, near.doc_id == members.rep).select("cluster", "rank", "parts", "below", "above", "part", "rep", "copies", "k1", "k2", "text")
    sets = map_batches(chosen, sets_of, "cluster long, rank int, parts int, below int, above int, part int, rep long, copies long, k1 long, shingles array<long>")

    def tasks_with(parts: str, low: F.Column, i, j, side) -> F.Column:
        """Of a member: its tasks with each of the `parts` others, named by (lower rank, is the other rank next to it, two parts)."""
        others = F.sequence(F.lit(0), F.greatest(F.col(parts), F.lit(1)) - 1)
        made = F.transform(others, lambda o: F.struct(F.xxhash64("cluster", low, F.lit(parts != "parts"), i(o), j(o)).alias("task"), side(o).alias("side")))
        return F.when(F.col(parts) > 0, made).otherwise(F.array().cast("array<struct<task:bigint,side:int>>"))

    own = F.col("part")
    #: Every pair of parts is one task of two blocks at most; side: -1 where a part meets itself.
    met = F.concat(
        tasks_with("parts", F.col("rank"), lambda o: F.least(own, o), lambda o: F.greatest(own, o), lambda o: F.when(o == own, -1).otherwise((own > o).cast("int"))),
        tasks_with("above", F.col("rank"), lambda o: own, lambda o: o, lambda o: F.lit(0)),
        tasks_with("below", F.col("rank") - 1, lambda o: o, lambda o: own, lambda o: F.lit(1)),
    )
    tasks = sets.withColumn("met", F.explode(met)).select("met.task", "met.side", "rep", "copies", "k1", "shingles")
    links = materialize(spark, tasks.repartition("task").sortWithinPartitions("task").mapInArrow(tidied(_verify(percent)), LINKS), "links")
    several = to_rep.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).where("b <> most").select("doc_id", "b")  # of doc_ids with different texts
    same = to_rep.join(several, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")
    found = components(spark, links.where("a <> b").select("a", "b").union(same), "components").select(F.col("node").alias("rep"), "component")
    degree = links.groupBy(F.col("a").alias("rep"), "k1").agg(F.sum("links").alias("links"))
    by_rep = classes.join(found, "rep", "left").join(degree, ["rep", "k1"], "left").select("k1", "k2", "n_shingles", "copies", F.coalesce("component", "rep").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    result = rows.join(by_rep, ["k1", "k2", "n_shingles"], "left")
    return result.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).alias("n_links"))


def keep_one(spark: SparkSession, docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """docs without the documents whose component holds a smaller doc_id; rows without doc_id stay."""
    gone = materialize(spark, jaccard_components(spark, docs, k, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    bits = id_bits(spark, gone, "__gone")
    doubtful = may_hold(docs, docs["doc_id"], bits)
    return may_hold(docs, docs["doc_id"], bits, negate=True).union(doubtful.join(gone, doubtful["doc_id"] == gone["__gone"], "left_anti"))
