"""Hard negatives against all pairs; bounds against products; what pruning leaves on clustered vectors."""

import numpy as np
import pytest

from quillrank.llm import hard_negatives as hn
from quillrank.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, size double, block int, v string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0, 2, "x", 3) for r in rows], SCHEMA)


def clustered(count, groups, width, spread, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, width))
    own = rng.integers(0, groups, count)
    values = (middles[own] + spread * rng.normal(size=(count, width))) * rng.choice([0.5, 1, 2], count)[:, None]
    return [(n, [float(x) for x in np.float32(v)], int(g % 10)) for n, (v, g) in enumerate(zip(values, own))]


def plain(rows):
    usable = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable[i] = max(usable.get(i, ([], 0)), ([float(np.float32(x)) for x in v], label))
    width = max(len(v) for v, _ in usable.values())
    whole = {i: (np.floor(256 * np.array(v + [0.0] * (width - len(v)))).astype(np.int64), (label + 1) % 10 if i % 7 == 0 else label) for i, (v, label) in usable.items()}
    out = set()
    for a, (v, label) in whole.items():
        if a % 100:
            continue
        score = {i: int(v @ w) for i, (w, _) in whole.items() if i != a}
        best = sorted((-score[i], i) for i in score if whole[i][1] == label)[:5]
        for p, positive in best:
            fit = sorted((-s, i) for i, s in score.items() if whole[i][1] != label and 30 * -p <= 100 * s <= 90 * -p)[:10]
            out |= {(a, positive, rank + 1, i, -p, -s) for rank, (s, i) in enumerate(fit)}
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("block, spread", [(4096, 0.3), (64, 0.3), (64, 3.0)])
def test_negatives_are_those_of_all_pairs(spark, monkeypatch, block, spread):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(hn, "STEP", 16)
    rows = clustered(1200, 14, 6, spread, 1)
    rows += [(5000 + n, rows[7][1], 3) for n in range(300)] + [(5000, [9.0] * 6, 2), rows[100]]
    rows += [(6000, None, 1), (6100, [1.0] * 6, None), (6200, [1.0, None] * 3, 1), (6300, [float("nan")] * 6, 1), (6400, [float("inf")] * 6, 1)]
    rows += [(None, [1.0] * 6, 1), (6500, [0.0] * 6, 1), (6600, [], 2), (6700, [2.0], 2), (6800, [1e4] * 6, 77)]
    assert got(hn.hard_negatives(frame(spark, rows), "vec_id", "embedding", "label")) == plain(rows)


def test_products_beyond_doubles(spark):
    rng = np.random.default_rng(8)
    rows = [(n, [float(np.float32(x)) for x in rng.integers(2**20, 2**21, 4)], n % 3) for n in range(300)]
    assert got(hn.hard_negatives(frame(spark, rows), "vec_id", "embedding", "label")) == plain(rows)


def test_bounds_hold_and_cut():
    rows = clustered(4000, 16, 24, 0.15, 3)
    values = np.floor(256 * np.array([v for _, v, _ in rows])).astype(np.int64)
    references = hn.directions(values[:1000].astype(float))
    import pyarrow as pa

    block = hn.Block({"id": pa.array(range(4000)), "label": pa.array([r[2] for r in rows]), "v": pa.array(values.tolist())}, references)
    left = []
    for q in range(0, 4000, 100):
        low, high = block.bounds(block.size[q], block.angles[q])
        score = values @ values[q]
        assert (low <= score).all() and (score <= high).all()
        least = np.sort(score)[-6]
        left.append((high >= least).mean())
    assert np.mean(left) < 0.3


def test_few_vectors(spark):
    none, one = frame(spark, []), frame(spark, [(100, [1.0, 2.0], 1)])
    for rows in (none, one, frame(spark, [(100, [0.0, 0.0], 1), (101, [0.0, 0.0], 1)])):
        assert hn.hard_negatives(rows, "vec_id", "embedding", "label").count() == 0
    zero = [(100, [0.0, 0.0], 1), (101, [0.0, 0.0], 1), (102, [1.0, 1.0], 2), (103, [0.0, 0.0], 4)]
    assert got(hn.hard_negatives(frame(spark, zero), "vec_id", "embedding", "label")) == plain(zero) != set()
