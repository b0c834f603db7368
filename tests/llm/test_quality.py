"""Quality scores: held-out accuracy, calibration, n-grams against plain ones, nothing to learn from."""

import random
import zlib

import numpy as np
import pytest

from quillrank.llm import quality

MORE = "score double, slots int, label int, code long, held_out string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bdfgklmn") + rng.choice("aeioué") for _ in range(rng.randint(1, 4)))
    out, labels = [], []
    for n in range(1500):
        words = [word() for _ in range(rng.randint(4, 120))]
        low = n % 6 == 0
        if low:
            kind = n // 6 % 3
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + rng.choice(["$$$", "%%%"]) for w in words] if kind == 1 else [words[0]] * 9 + words
        out.append((n, " ".join(words)))
        labels.append((n, int(not low)))
    return out, labels


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0, 2, 3, 4, "x") for r in rows], f"doc_id long, text string, {MORE}")


def test_scores_of_held_out_rows(spark, rows):
    docs, labels = rows
    odd = [(2000, None), (2001, ""), (2002, " \n "), (3, docs[6][1]), (3, None), (None, "ba be bi"), (2003, "gafe " * 60_000), (2004, "\U0001f642 日本")]
    labels = spark.createDataFrame([*labels, (9000, 1), (None, 0), (4, None), (5, 7)], "doc_id long, quality int")
    model = quality.fit(frame(spark, docs + odd), labels)
    got = quality.score(frame(spark, docs + odd), model).toPandas()
    assert len(got) == len(docs) + len(odd) and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    known = got[got.doc_id.notna()]
    assert (known.held_out == [zlib.crc32(str(int(i)).encode()) % 3 == 1 for i in known.doc_id]).all()
    truth = {n: int(n % 6 != 0) for n, _ in docs}
    held = got[got.held_out & (got.doc_id < 1500) & (got.doc_id != 3)]
    label = np.array([truth[int(i)] for i in held.doc_id])
    assert len(held) > 400 and (held.predicted == label).mean() > 0.97
    assert (held.predicted[label == 0] == 0).mean() > 0.9
    assert abs(held.score.mean() - label.mean()) < 0.03
    empty = got[got.doc_id.isin([2000, 2001])].score
    assert empty.nunique() == 1


def test_held_out_labels_teach_nothing(spark, rows):
    docs, labels = rows
    turned = [(n, 1 - q if zlib.crc32(str(n).encode()) % 3 == 1 else q) for n, q in labels]
    first, second = (quality.fit(frame(spark, docs), spark.createDataFrame(own, "doc_id long, quality int")) for own in (labels, turned))
    assert np.array_equal(first.weights, second.weights) and (first.slope, first.offset) == (second.slope, second.offset)


def test_slots_are_those_of_plain_ngrams():
    rng = random.Random(1)
    slots_of = quality.Slots()
    for _ in range(300):
        text = "".join(rng.choice("abAB é日!?. \n") for _ in range(rng.randint(0, 60)))
        raw = text.encode()
        plain = set()
        for size in range(1, 4):
            plain |= {raw[k : k + size] for k in range(len(raw) - size + 1)}
        words, kinds = [], quality.KIND[np.frombuffer(raw, np.uint8)] if raw else []
        for byte, kind, before in zip(raw, kinds, [0, *kinds]):
            if kind and kind == before:
                words[-1] += bytes([byte]).lower()
            elif kind:
                words.append(bytes([byte]).lower())
        plain |= {(w,) for w in words} | set(zip(words, words[1:]))
        longest, run = 0, 0
        for a, b in zip(words, words[1:]):
            run = run + 1 if a == b else 0
            longest = max(longest, run)
        plain |= {("again", k) for k in range(1, min(longest, quality.REPEATS) + 1)}
        got = slots_of(text)
        assert len(set(got.tolist())) == len(got)
        assert len(plain) - 3 <= len(got) <= len(plain)


def test_descent_reaches_the_least_hinge_loss():
    rng = np.random.default_rng(2)
    rows = [rng.choice(12, rng.integers(2, 6), replace=False) for _ in range(60)]
    signs = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    ratios, costs = rng.normal(size=12), np.ones(60)
    weights, bias = quality.descend(rows, signs, ratios, costs)
    matrix = np.zeros((60, 13))
    for k, own in enumerate(rows):
        matrix[k, own] = ratios[own] / np.linalg.norm(ratios[own])
    matrix[:, 12] = 1
    loss = lambda w: 0.5 * w @ w + np.maximum(0, 1 - signs * (matrix @ w)).sum()
    plain, best = np.zeros(13), np.inf
    for step in range(20_000):
        over = signs * (matrix @ plain) < 1
        plain = plain - (plain - (signs[over, None] * matrix[over]).sum(0)) / (step + 20)
        best = min(best, loss(plain))
    assert loss(np.r_[weights, bias]) < best * 1.01


def test_without_labels(spark, rows):
    docs = frame(spark, rows[0][:40])
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(n, 1) for n in range(40)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    assert {r.predicted for r in quality.score(docs, quality.fit(docs, one)).collect()} == {1}
    empty = frame(spark, [])
    assert quality.score(empty, quality.fit(empty, one)).count() == 0
