"""Phrases against plain counting."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillrank.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, most):
    """{(lang, rank): (phrase, a, l, r, n, score)} by counting every phrase."""
    counts, words = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            own = [w for w in re.split("[ \t]+", piece) if w]
            words[lang] += len(own)
            for size in range(1, 5):
                for k in range(len(own) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(own[k : k + size])] += 1
    out = {}
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= collocations.LEAST}
        covered = set()
        for longer, a in found.items():
            for size in range(2, len(longer)):
                for k in range(len(longer) - size + 1):
                    if 100 * a >= 80 * f[longer[k : k + size]]:
                        covered.add(longer[k : k + size])
        scored = []
        for p, a in found.items():
            if p not in covered:
                cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, text, left, right) in enumerate(sorted(scored)[:most]):
            out[lang, rank + 1] = text.decode(), -a, left, right, words[lang], -score
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{n}" for n in range(25)] + ["Été", "été", "É", "日本", "x\xa0y", "🙂"]
    out = []
    for n in range(500):
        own = []
        for _ in range(rng.randint(0, 60)):
            own.append(rng.choice(words[: rng.choice([4, 12, 31])]) + rng.choice(["", "", "", ",", ". ", "!?", "\n", "\r\n", "\t"]))
            if rng.random() < 0.2:
                own.append(rng.choice(["New York City Hall", "new  york\tcity", "in spite of", "a a a a a"]))
        out.append((" ".join(own), rng.choice(["en", "en", "de", None, ""])))
    out += [("in spite of all", "en")] * 200 + [(None, "en"), ("", None), (" \t ", "fr"), (".,;", "fr"), ("one two", "fr")]
    out += [("ab " * 30_000, "long"), ("z " * 29 + "z", "fr"), ("q " * 31, "es")]
    return out


@pytest.mark.parametrize("size, most", [(1 << 24, 2000), (3000, 40)])
def test_phrases_are_those_of_plain_counting(spark, rows, monkeypatch, size, most):
    monkeypatch.setattr(collocations, "SHARD_BYTES", size)
    frame = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], "text string, lang string, shard int, n int, phrase string, doc_id int").repartition(7)
    got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(frame, most).collect()}
    assert got == plain(rows, most)


def test_index_against_sorting():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 60, 300):
        for _ in range(5):
            ids = rng.integers(0, 3, n)
            ids[-1] = 0
            ends = (ids == 0).sum()
            own = ids + ends
            own[ids == 0] = np.arange(ends)
            want = sorted(range(n), key=lambda k: own[k:].tolist())
            assert collocations.suffix_array(ids).tolist() == want
            index = collocations.Index.of(ids)
            at = np.argsort(want)
            for row, place in enumerate(want):
                if place and ids[place - 1]:
                    assert index.step[row] == at[place - 1]


def test_scores_of_counts_beyond_64_bits(spark):
    """The arithmetic of the score, on counts that no test text can reach."""
    a, left, right = 7 * 10**17, 8 * 10**17, 9 * 10**17
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations.score("a", "l", "r").alias("s")).first()
    assert row.s == 2_000_000 * a // (left + right)


def test_no_documents(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0


def test_memory_of_an_index():
    """Bytes for each word and each byte of text, beside the results, stay below bounds that 64-bit copies of all words pass."""
    ids = np.random.default_rng(5).integers(0, 3_000, 300_000).astype(np.int32)
    tracemalloc.start()
    collocations.suffix_array(ids)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 * len(ids)


def test_words_by_slices(monkeypatch):
    texts = ["A b. c", None, "", "b\tA,, x  y", " . ", "é c!A"] * 5
    whole = collocations.symbols(pa.array(texts))
    monkeypatch.setattr(collocations, "SLICE_BYTES", 3)
    ids, words = collocations.symbols(pa.array(texts))
    assert ids.tolist() == whole[0].tolist() and words.to_pylist() == whole[1].to_pylist() == ["a", "b", "c", "x", "y", "é"]
    assert ids[:10].tolist() == [1, 2, 0, 3, 0, 2, 1, 0, 4, 5]


def test_bytes_of_phrases_that_are_sent():
    """A row of Spark's took 14 bytes in a shuffle; what a shard sends to one part has to take far fewer."""
    rng = np.random.default_rng(2)
    head = np.sort(rng.zipf(1.3, 20_000) % 5_000) * 977
    size = np.minimum(rng.zipf(2.0, 20_000), 1_000)
    found = np.cumsum(size + rng.integers(0, 3, 20_000)), size, head, rng.integers(0, 1 << 22, 20_000)
    data = collocations.packed(*found)
    assert len(data) < 7 * 20_000
    assert all((a == b).all() for a, b in zip(collocations.unpacked(data), found))
    part = collocations._parts_of(found[2], found[3], 50)
    assert 0 <= part.min() and part.max() < 50 and all(len(set(part[head == h])) <= 4 for h in np.unique(head)[:200])
    # One head alone is dealt out by its tails.
    assert len(set(collocations._parts_of(np.full(900, 7), found[3][:900], 50))) == 4
