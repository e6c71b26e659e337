"""Line de-duplication, n-gram join and passage removal against plain versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from braidgraph.llm import common, line_dedup, ngram_join, substring_dedup
from tests.llm import awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_sets(rows):
    out = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    return out


def plain_components(rows):
    """(doc_id, size, component, links) of each row; rows without id count through their equals."""
    sets = plain_sets(rows)
    n = len(rows)
    near = [[i != j and bool(sets[i]) and bool(sets[j]) and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, work = {i}, [i]
        while work:
            x = work.pop()
            for y in range(n):
                if near[x][y] and y not in seen:
                    seen.add(y)
                    work.append(y)
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids) if ids else None, sum(near[i])))
    return out


def key(r):
    return tuple(-1 if x is None else x for x in r)


def near_copies(seed, n, edits):
    rng = random.Random(seed)
    base = awkward.prose(rng, rng.randrange(12, 90)).split()
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = rng.choice(["a", "b", "c"])
        rows.append((i, " ".join(w)))
    return rows


def test_join_awkward(spark):
    rows = [r for r in awkward.texts() if r != (2, awkward.texts()[31][1])] + [(2, awkward.texts()[31][1])]
    got = [tuple(r) for r in ngram_join.jaccard_components(spark, awkward.documents(spark, rows)).select("doc_id", "n_shingles", "component_id", "n_links").collect()]
    assert sorted(got, key=key) == sorted(plain_components(rows), key=key)


@pytest.mark.parametrize("seed", range(3))
def test_join_near_copies(spark, seed, monkeypatch):
    rows = near_copies(seed, 60, 4) + [(1000 + i, t) for i, t in near_copies(seed + 50, 30, 2)]
    monkeypatch.setattr(ngram_join, "BLOCK", 8)  # clusters in several blocks
    monkeypatch.setattr(common, "EDGES_PER_TASK", 10)  # components by rounds
    got = [tuple(r) for r in ngram_join.jaccard_components(spark, awkward.documents(spark, rows)).select("doc_id", "n_shingles", "component_id", "n_links").collect()]
    assert sorted(got, key=key) == sorted(plain_components(rows), key=key)
    kept = sorted(r.doc_id for r in ngram_join.keep_one(spark, awkward.documents(spark, rows)).collect())
    assert kept == sorted({r[2] for r in plain_components(rows)})


def plain_documents(rows, k, percent):
    """(doc_id, size, component, links) of each row, by word sets; rows of one doc_id are one document."""
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    n, parent = len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = [[i != j and bool(sets[i]) and bool(sets[j]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    for i in range(n):
        for j in range(n):
            if near[i][j] or rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]:
                parent[find(i)] = find(j)
    out = []
    for i in range(n):
        ids = [rows[x][0] for x in range(n) if find(x) == find(i) and rows[x][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids) if ids else None, sum(near[i])))
    return out


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_join_repeated_rows(spark, k, percent):
    """Whole rows again, other texts under the same doc_id, null ids, and links through both."""
    rng = random.Random(percent)
    rows = awkward.texts() + near_copies(7, 40, 3)
    rows = [(None if i is None else i + 100 * (i < 40 and n > 60), t) for n, (i, t) in enumerate(rows)]
    rows += rng.sample([r for r in rows if len(r[1] or "") < 3000], 25) + [(2, "another text of this document " * 3), (700, "another text of this document " * 3), (2, None)]
    rows += [(rng.choice([101, 105, 120]), rng.choice(rows)[1]) for _ in range(6)]
    got = [tuple(r) for r in ngram_join.jaccard_components(spark, awkward.documents(spark, rows), k, percent).select("doc_id", "n_shingles", "component_id", "n_links").collect()]
    want = plain_documents(rows, k, percent)
    assert sorted(got, key=key) == sorted(want, key=key)


def shared_passage_rows(seed):
    """Families of copies around a passage that most documents share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(30)]
    rows = []
    for family in range(14):
        base = [word() for _ in range(rng.randrange(20, 90))]
        at = rng.randrange(len(base))
        base[at:at] = passage[: rng.randrange(10, 31)]
        for copy in range(rng.choice([1, 2, 8])):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = word()
            rows.append((20 * family + copy, " ".join(words)))
    return rows


def test_join_with_shared_passages(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rows = shared_passage_rows(1)
    got = [tuple(r) for r in ngram_join.jaccard_components(spark, awkward.documents(spark, rows), 5, 80).select("doc_id", "n_shingles", "component_id", "n_links").collect()]
    assert sorted(got, key=key) == sorted(plain_documents(rows, 5, 80), key=key)


@pytest.mark.parametrize("hot,sheaf,deleting", [(1, 60, 0), (1, 1 << 20, 0), (3, 400, 0), (2, 60, 3)])
def test_sheaves_lose_no_link(hot, sheaf, deleting, monkeypatch):
    """Through sheaves and ranges, with hot subsets met only by documents that can't spare them, linking documents stay in one cluster."""
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "SHEAF", sheaf)
    for seed in range(6):
        rows, bands = shared_passage_rows(seed), ngram_join.Bands(80)
        plans = {}
        for b in range(60):
            h, spare = bands.bound(b), 3 + bands.bound(b) // 2
            few = min(deleting, (h + spare) // 2)
            plans[b] = (h + spare - 2 * few, few, spare)
        sets = dict(zip([i for i, _ in rows], ngram_join.shingle_sets(pa.array([t for _, t in rows]), 5), strict=True))
        made, now = [], ngram_join.Sheaf(8)
        for i, s in sets.items():
            if now.add(i, *ngram_join.told(s, plans, bands)):
                made += now.out().to_pylist()
        if now.size:
            made += now.out().to_pylist()
        made.sort(key=lambda r: r["at"])
        batches = [pa.RecordBatch.from_pylist(made[k : k + 5], schema=common.arrow_schema(ngram_join.SHEAVES)) for k in range(0, len(made), 5)]
        found = [r for batch in ngram_join._settle_ranges(batches) for r in batch.to_pylist()]
        many = Counter((r["a"], r["band"]) for r in found if r["hot"])
        meeting = defaultdict(set)
        for r in found:
            if r["hot"] and many[r["a"], r["band"]] >= ngram_join.hot_spare(plans[r["band"]][2]):
                meeting[r["b"]].add(r["a"])
        parent = {i: i for i in sets}
        for a, b in [(r["a"], r["b"]) for r in found if not r["hot"]] + [(x, min(g)) for g in meeting.values() for x in g]:
            parent[common.find(parent, a)] = common.find(parent, b)
        linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(x := np.intersect1d(sets[a], sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - len(x)) and len(x) < max(len(sets[a]), len(sets[b]))]
        assert len(linked) > 10 and any(r["hot"] for r in found)
        assert all(common.find(parent, a) == common.find(parent, b) for a, b in linked)


@pytest.mark.parametrize("percent", [80, 90])
def test_hot_and_tiny_subsets_can_be_spared(percent):
    """Linking sets keep a signature in common that is neither left out as tiny nor as hot, whatever shared content is hot."""
    rng, bands, met = np.random.default_rng(percent), ngram_join.Bands(percent), 0
    plans = {b: ngram_join.allocate(bands.bound(b), bands.highs[b], 10**7, bands.growth) for b in range(60)}
    for _ in range(300):
        size = int(rng.integers(20, 300))
        a = rng.integers(0, 1 << 62, size, dtype=np.int64).view(np.uint64)
        less = int(size * (100 - percent) / 200)
        b = np.unique(np.concatenate([a[int(rng.integers(0, less + 1)) :], rng.integers(0, 1 << 62, int(rng.integers(0, less + 1)), dtype=np.int64).view(np.uint64)]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both):
            continue
        met += 1
        hot = rng.random() * 0.8
        left = []
        for s in (a, b):
            sig, band = ngram_join.told(s, plans, bands)
            is_hot = ((sig & ngram_join.MAY_BE_HOT) != 0) & ((sig >> np.uint64(20)) % np.uint64(1000) < np.uint64(int(1000 * hot)))
            count = np.bincount(band[is_hot], minlength=60)
            spares = np.array([ngram_join.hot_spare(plans[x][2]) for x in range(60)])
            group = sig >> np.uint64(1)  # whole and deleted subsets meet
            left.append((set(group[~is_hot].tolist()), set(group[is_hot & (count >= spares)[band]].tolist())))
        assert left[0][0] & left[1][0] or left[0][1] & left[1][1]
    assert met > 100


def test_join_empty(spark):
    assert ngram_join.jaccard_components(spark, awkward.documents(spark, [])).collect() == []


@pytest.mark.parametrize("plan", ["exact", "deleting", "mixed", "spare", "much to spare"])
def test_linking_sets_share_a_signature(plan):
    rng, bands = np.random.default_rng(1), ngram_join.Bands(90)
    plans = {}
    for b in range(60):
        h, spare = bands.bound(b), {"spare": 3, "much to spare": 9}.get(plan, 1)
        two = {"deleting": (h + spare) // 2, "mixed": (h + 1) // 4}.get(plan, 0)
        plans[b] = (h + spare - 2 * two, two, spare)
    met = 0
    for _ in range(900):
        size = int(rng.integers(9, 200))
        a = rng.integers(0, 1 << 62, size, dtype=np.int64).view(np.uint64)
        drop, add = int(rng.integers(0, size // 9 + 1)), int(rng.integers(0, size // 9 + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 62, add, dtype=np.int64).view(np.uint64)]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both) and not np.array_equal(a, b):
            met += 1
            assert len(np.intersect1d(ngram_join.signatures(a, plans, bands), ngram_join.signatures(b, plans, bands)))
    assert met > 100


def test_allocation_follows_cost():
    for h in range(1, 60):
        for n in (10, 10**6, 10**12):
            exact, deleting, spare = ngram_join.allocate(h, 9 * h + 8, n)
            assert exact + 2 * deleting == h + spare and spare >= 1 and exact >= 0
    assert ngram_join.allocate(20, 185, 10) == (21, 0, 1)  # few documents: the fewest signatures
    assert ngram_join.allocate(42, 380, 10**6)[2] > 3  # more documents: some agreements to spare
    assert ngram_join.allocate(1, 12, 10**9)[1] == 1  # small sets, many of them: an empty half would meet all others


def plain_repeats(rows, size):
    """(doc_id, words, removed, kept) with windows of `size` words."""
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - size + 1) if i is not None else ():
            g = tuple(w[s : s + size])
            first[g] = min(first.get(g, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {s + k for s in range(len(w) - size + 1) if i is not None and first[tuple(w[s : s + size])] < i for k in range(size)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("size", [50, 5])
def test_passages(spark, size, monkeypatch):
    monkeypatch.setattr(common, "CHUNK_BYTES", 700)
    rows = awkward.texts()
    got = [tuple(r) for r in substring_dedup.remove_repeats(spark, awkward.documents(spark, rows), size).collect()]
    assert sorted(got, key=key) == sorted(plain_repeats(rows, size), key=key)
    if size == 50:
        assert sum(r[2] for r in got) > 300


def test_passages_held_by_most_documents(spark):
    """A passage in most documents, repeated rows among them, and long texts of one word."""
    rng = random.Random(5)
    passage = awkward.prose(rng, 70)
    rows = [(i, f"{awkward.prose(rng, rng.randrange(30))} {passage} {awkward.prose(rng, rng.randrange(30))}") for i in range(300)]
    rows += [(400, "same " * 3000), (401, "same " * 200), (402, "same " * 49), *rows[:3]]
    got = [tuple(r) for r in substring_dedup.remove_repeats(spark, awkward.documents(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(plain_repeats(rows, 50), key=key)


def test_pairs_are_kept_whatever_the_task(monkeypatch):
    """Every pair whose minimiser several documents have is kept, from one task or many; few others are."""
    import pandas as pd
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = [(i, np.unique(rng.integers(0, 3000, 40)).tolist() + [7_000_000 + i]) for i in range(120)]
    true = Counter(m for _, mins in rows for m in mins)
    for chunk in (1 << 20, 500, 30):
        monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
        schema = pa.schema([("doc_id", pa.int64()), ("mins", pa.list_(pa.int64()))])
        batches = [pa.RecordBatch.from_pylist([{"doc_id": i, "mins": m} for i, m in rows[k : k + 10]], schema=schema) for k in range(0, 120, 10)]
        pairs = [b for b in substring_dedup._by_block(3)(batches)]
        table = pd.concat([b.to_pandas() for b in pairs])
        parts = pd.DataFrame(substring_dedup._sketch(pa.RecordBatch.from_pandas(table[table.block >= 0], preserve_index=False)))
        stream = []
        for block, part in parts.groupby("block"):
            bits = substring_dedup._merge(part).iloc[0]
            stream.append({"block": block, "is_pairs": False, "one": bits["bits0"], "two": bits["bits1"]})
            stream += [{"block": block, "is_pairs": True, "one": r.docs, "two": r["items"]} for _, r in table[table.block == block].iterrows()]
        kept = [x for b in substring_dedup._estimated([pa.RecordBatch.from_pylist(stream[k : k + 2]) for k in range(0, len(stream), 2)]) for x in zip(b["doc_id"].to_pylist(), b["item"].to_pylist(), strict=True)]
        for _, r in table[table.block < 0].iterrows():
            kept += list(zip(np.frombuffer(r.docs, np.int64).tolist(), np.frombuffer(r["items"], np.int64).tolist(), strict=True))
        once = {(i, m) for i, mins in rows for m in mins}
        # one pair of a minimiser that a task has twice stands for the others of that task
        assert {(i, m) for i, m in once if true[m] > 1} <= set(kept) <= once and len(set(kept)) < len(once) - 100


def test_passages_empty(spark):
    assert substring_dedup.remove_repeats(spark, awkward.documents(spark, [])).collect() == []


def test_sketch_never_underestimates():
    rng = np.random.default_rng(0)
    items = rng.integers(0, 5000, 20_000, dtype=np.int64).view(np.uint64)
    true = Counter(items.tolist())
    import pandas as pd

    parts = []
    for half in np.array_split(items, 3):
        for row in (0, 1):
            at, n = np.unique(substring_dedup.cells(half, row), return_counts=True)
            parts.append({"block": 0, "row": row, "cells": at.tobytes(), "counts": np.minimum(n, 2).astype(np.uint8).tobytes()})
    merged = substring_dedup._merge(pd.DataFrame(parts)).iloc[0]
    for row in (0, 1):
        at = substring_dedup.cells(items, row)
        bit = np.frombuffer(merged[f"bits{row}"], np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
        assert all(b for b, i in zip(bit.tolist(), items.tolist(), strict=True) if true[i] > 1)


@pytest.mark.parametrize("width", [1, 2, 5, 25])
def test_sliding_min(width):
    h = np.random.default_rng(width).integers(0, 99, 60)
    assert substring_dedup.sliding_min(h, width).tolist() == [h[i : i + width].min() for i in range(60 - width + 1)]


def plain_lines(rows, min_docs, similarity, min_words):
    """(doc_id, text, lines, dropped)."""
    parsed = []
    for i, t in rows:
        for p, line in enumerate(t.split("\n") if t else []):
            w = tuple("<*>" if re.search("[0-9]", x) else x for x in WORD.findall(line))
            if w:
                parsed.append((i, p, w, len(parsed)))
    docs, leaves = defaultdict(set), defaultdict(set)
    for i, _, w, _ in parsed:
        if i is not None:
            docs[w].add(i)
    for w in docs:
        if len(w) >= min_words:
            leaves[len(w), w[:3]].add(w)
    template = {}
    for leaf, kinds in leaves.items():
        if len(kinds) > 1 and sum(len(docs[w]) for w in kinds) >= min_docs:
            support = Counter()
            for w in kinds:
                for p, x in enumerate(w):
                    support[p, x] += len(docs[w])
            for w in kinds:
                kept = tuple((p, x) for p, x in enumerate(w) if support[p, x] >= min_docs)
                if 100 * len(kept) >= similarity * len(w):
                    template[w] = (leaf, kept)
    users = defaultdict(set)
    for i, _, w, _ in parsed:
        if i is not None:
            users[template.get(w, w)].add(i)
    out = []
    for i, t in rows:
        lines = t.split("\n") if t else []
        kept = []
        for line in lines:
            w = tuple("<*>" if re.search("[0-9]", x) else x for x in WORD.findall(line))
            of = users.get(template.get(w, w), ()) if w and i is not None else ()
            if not (len(of) >= min_docs and i > min(of)):
                kept.append(line)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_line_templates(spark, seed, monkeypatch):
    monkeypatch.setattr(common, "CHUNK_BYTES", 500)
    rng = random.Random(seed)
    rows = awkward.texts()
    for i in range(100, 130):
        lines = [awkward.prose(rng, rng.randrange(1, 15)) for _ in range(4)]
        lines += [f"posted by {rng.choice(['ann', 'bob', 'cyd'])}{rng.randrange(99)} on the {rng.randrange(30)} of may at noon sharp", f"read all about {rng.choice(['cats', 'dogs', 'birds', 'fish'])} in our next long weekly letter", "all the same"]
        lines += [f"a rare line with {awkward.prose(rng, 8)}", "  ", ""]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    got = [tuple(r) for r in line_dedup.dedup_lines(spark, awkward.documents(spark, rows), 6, 75, 8).collect()]
    want = plain_lines(rows, 6, 75, 8)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[3] for r in got) > 60
    full = line_dedup.rewrite(spark, awkward.documents(spark, rows), 6, 75, 8)
    assert full.columns == [*awkward.documents(spark, rows).columns, "__dropped"]
    assert sorted(((r.doc_id, r.text or "", r["__dropped"]) for r in full.collect()), key=key) == sorted(((r[0], r[1], r[3]) for r in want), key=key)


def test_repeated_rows_make_no_template(spark):
    """Every row twice, and two texts of one doc_id: lines that share two words of five beyond their head stay apart."""
    rng = random.Random(3)
    rows = []
    for i in range(200, 224):
        own = [f"w{'abcdefghijklmnopqrstuvwxyz'[i - 200]}{x}" for x in "pqrst"]
        rows.append((i, f"read all about this {' '.join(own)} today\n" + awkward.prose(rng, 9)))
    rows += [(i, f"read all about the {rng.choice(['cats', 'dogs'])} in our next long weekly letter") for i in range(300, 312)]
    rows += [(300, "read all about the cats in our next long weekly letter\nand one more"), (301, "another text of this document")]
    twice = [r for r in rows for _ in range(2)]
    got = [tuple(r) for r in line_dedup.dedup_lines(spark, awkward.documents(spark, twice)).collect()]
    assert sorted(got, key=key) == sorted(plain_lines(twice, 10, 75, 8), key=key)
    assert not any(r[3] for r in got if 200 <= r[0] < 224) and any(r[3] for r in got)


def test_lines_empty(spark):
    assert line_dedup.dedup_lines(spark, awkward.documents(spark, [])).collect() == []


def test_word_hashes_cut_like_split():
    import pyarrow as pa

    texts = [t for _, t in awkward.texts()]
    seen = {}
    for chunk in common.word_chunks(pa.array(texts, pa.string()).slice(3)):
        for row, a, b in chunk.rows():
            words = (texts[3 + row] or "").encode().split()
            assert len(words) == b - a
            for w, h in zip(words, chunk.hashes[a:b].tolist(), strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_patterned_words_differ():
    """Thue-Morse words and their complements, and words that differ in one place or in the order of eights."""
    a = bytes(97 + i.bit_count() % 2 for i in range(4096))
    words = [x for n in (8, 16, 64, 1024, 4096) for x in (a[:n], bytes(195 - c for c in a[:n]))]
    words += [b"abcdefgh12345678", b"12345678abcdefgh", b"x" * 7, b"x" * 8, b"x" * 9, b"x" * 17, b"x\0", b"x"]
    assert len(set(common.words_of(b" ".join(words)).hashes.tolist())) == len(words)


def test_components_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(common, "EDGES_PER_TASK", 7)
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(200 + rng.randrange(50), 200 + rng.randrange(50)) for _ in range(40)]
    edges = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "a long, b long").repartition(5)
    got = {r.node: r.component for r in common.components(spark, edges, "test").collect()}
    for a, b in pairs:
        if a != b:
            assert got[a] == got[b] <= min(a, b)
    assert {got[i] for i in range(61)} == {0}
