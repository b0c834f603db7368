"""Repeated strings and alike documents against brute force."""

import random

import numpy as np
from brute import components, cut_repeats, sha256

from quillrank.llm import common, jaccard_join, shingles, suffix_dedup


def test_alike_documents(docs, no_docs):
    rows, frame = docs
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame).collect()}
    assert got == components(rows)
    assert jaccard_join.jaccard_components(no_docs).count() == 0


def test_large_groups_meet_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    monkeypatch.setattr(jaccard_join, "FEW", 3)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for n in range(90):
        own = list(base)
        for _ in range(rng.choice([1, 2, 2, 3])):
            own[rng.randrange(60)] = f"v{rng.randrange(500)}"
        rows.append((n, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows)


def test_one_id_with_two_texts_brings_them_together(spark):
    rows = [(1, "a b c d e f"), (2, "q r s t u v"), (2, "a b c d e f"), (3, "q r s t u v"), (None, "a b c d e f"), (4, None), (4, None)]
    got = sorted(map(tuple, jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 2, 1), (None, 2, None), (4, 0, 4), (4, 0, 4)], key=str)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(n, n + 1) for n in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = dict(map(tuple, common.components(edges).collect()))
    assert got == {**{n: 0 for n in range(61)}, 100: 100, 101: 100}


def test_bitmaps_bound_what_is_shared():
    rng = np.random.default_rng(0)
    import pyarrow as pa

    for _ in range(50):
        a = np.unique(rng.integers(0, 4000, rng.integers(1, 900), dtype=np.uint64))
        b = np.unique(np.r_[a[: rng.integers(0, len(a) + 1)], rng.integers(0, 4000, rng.integers(1, 900), dtype=np.uint64)])
        maps = jaccard_join.Bitmaps(pa.array([shingles.bitmap(shingles.mix(x), k) for x in (a, b) for k in (1,)], pa.binary()))
        unlike = maps.unlike(np.array([0]), np.array([1]))[0]
        assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - unlike) // 2


def test_suffixes_are_sorted(monkeypatch):
    rng = random.Random(3)
    for size, small in ((400, 10), (6000, 50), (20_000, 4096)):
        monkeypatch.setattr(suffix_dedup, "SMALL", small)
        part = bytes(rng.choice(b"ab") for _ in range(40))
        text = b"".join(rng.choice([part, part[:20], bytes(rng.choice(b"abc\xff\0") for _ in range(30))]) for _ in range(size // 20))
        count = len(text) - 99
        order, group = suffix_dedup.sort_suffixes(np.frombuffer(text + bytes(16), np.uint8), np.arange(count))
        found = [text[k : k + 100] for k in order]
        assert found == sorted(text[k : k + 100] for k in range(count))
        assert group.tolist() == np.r_[0, np.cumsum([a != b for a, b in zip(found[1:], found)])].tolist()


def test_repeated_strings(docs, no_docs):
    rows, frame = docs
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.removed_spans(frame).collect()}
    want = {i: (n, gone, spans, sha256(kept)) for i, (n, gone, spans, kept) in cut_repeats(rows).items()}
    assert got == want and sum(w[1] for w in want.values()) > 5000
    assert suffix_dedup.removed_spans(no_docs).count() == 0


def test_anchors_that_very_many_have(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LEAST", 20)
    monkeypatch.setattr(suffix_dedup, "MOST", 20)
    rng = random.Random(5)
    line = "This one line of seventy bytes or more stands in very many documents. "
    rows = [(n, line + "".join(rng.choice("abcdefgh ") for _ in range(120)) + (line * 3 if n % 9 == 0 else "")) for n in range(150)]
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.removed_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (n, gone, spans, sha256(kept)) for i, (n, gone, spans, kept) in cut_repeats(rows).items()}


def test_rows_with_one_id_follow_their_texts(spark):
    a, b = "a long text that is cut " * 8, "b another text altogether " * 8
    rows = [(2, b + a), (2, a), (2, a), (1, b), (None, a[:150])]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.removed_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    order = [(None, a[:150]), (1, b), (2, a), (2, a), (2, b + a)]
    want = cut_repeats(list(enumerate(t for _, t in order)))
    assert got == sorted((order[k][0] or 0, w[0], w[1]) for k, w in want.items())


def test_texts_without_repeats(docs):
    rows, frame = docs
    left = {r.doc_id: r for r in suffix_dedup.without_repeats(frame).collect()}
    for i, (n, gone, _, kept) in cut_repeats(rows).items():
        if gone and not kept.decode("utf-8", "ignore"):
            assert i not in left
        else:
            assert left[i].text == (kept.decode("utf-8", "ignore") if gone else dict(rows)[i]) and left[i].key == "k"
