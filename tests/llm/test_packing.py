"""Packing: whole documents come back from the pieces; the two tokenizer libraries agree where the fast one is used."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from braidgraph.llm import packing
from tests.llm import awkward

PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("length", [16, 1024])
def test_round_trip(spark, length):
    rows = [*awkward.texts(), (90, "ends <|endoftext|> inside"), (91, "x" * 5000)]
    pieces = packing.pack(awkward.documents(spark, rows), length=length).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert sorted(map(str, by_doc)) == sorted({str(i) for i, _ in rows})
    padding = 0
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding == 0
    for i, found in by_doc.items():
        texts = [t for j, t in rows if j == i]
        want = sorted((start, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)) for t in texts for start, ids in [(0, ids_of(t))])
        if len(texts) == 1:
            ids, at = ids_of(texts[0]), 0
            for p in sorted(found, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids)
                assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(ids)
        else:
            assert sum(p.length for p in found) == sum(n for _, _, n in want)
    assert packing.pack(awkward.documents(spark, [])).collect() == []


def test_every_proven_character_is_cut_alike():
    encode = packing.Encoder("byte_bpe_50k.json")
    proven = [chr(c) for c in range(0x3000) if not packing.UNPROVEN.search(chr(c))]
    assert len(proven) > 200
    for c in proven:
        for t in (c, f"a{c}b", f" {c} ", f"1{c}2", f"!{c}!", f"{c}{c}", f"\n{c}\t x", f"'{c}s"):
            assert encode.fast.encode_ordinary(t) == PLAIN.encode(t, add_special_tokens=False).ids, repr(t)
    rng = random.Random(0)
    for _ in range(1500):
        t = "".join(rng.choice(proven) for _ in range(rng.randrange(40)))
        assert encode.ids(t) == PLAIN.encode(t, add_special_tokens=False).ids, repr(t)
    for t in ("日本語 <|endoftext|>", "𝔘 x", "<|endoftext|>", "a　b"):
        assert encode.ids(t) == PLAIN.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_curve(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = packing.hilbert_index(grid, bits)
    assert sorted(keys.tolist()) == list(range(len(grid)))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_keys_depend_on_text_alone():
    a = packing.curve_keys([b"one text", None, b"", b"other text"])
    assert a.tolist() == [packing.curve_keys([t])[0] for t in (b"one text", None, b"", b"other text")] and a[1] == a[2]


@pytest.mark.parametrize("run", [" ", "\n", " \t", "\xa0", "x", "7", "!", "日"])
def test_long_runs(run):
    """A million and more characters of one kind, at the front, inside and at the end."""
    encode = packing.encoder("byte_bpe_50k.json")
    long_ = run * (1_100_000 // len(run))
    t = f"a{long_}b"
    assert encode.ids(t) == PLAIN.encode(t, add_special_tokens=False).ids


def test_long_runs_are_packed(spark):
    rows = [(1, "a" + " " * 1_500_000 + "b"), (2, "\n" * 1_000_000), (3, "short"), (4, " " * 9_999 + "x" + " " * 10_000)]
    pieces = packing.pack(awkward.documents(spark, rows)).collect()
    assert {p.doc_id: p.doc_tokens for p in pieces} == {i: len(ids_of(t)) for i, t in rows}
