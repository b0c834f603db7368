"""Top products and nearest neighbours against all pairs."""

import numpy as np

from quillrank.llm import forest, top_products

SCHEMA = "vec_id long, embedding array<float>, size double, block int, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1.0, 2, "x") for i, v in rows], SCHEMA)


def odd_rows():
    rng = np.random.default_rng(1)
    rows = [(n, [float(x) for x in np.round(rng.normal(size=8) * rng.choice([0.1, 1, 3]), 1)]) for n in range(400)]
    rows += [(1000 + n, rows[7][1]) for n in range(60)] + [rows[0], rows[50]]
    return rows + [(2000, None), (2050, [1.0, None, 0.0]), (2100, [float("nan")] * 8), (2150, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]


def usable(rows):
    return {i: v for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}


def want(rows, score, keep=lambda v: True):
    own = {i: np.array(v, np.float32).astype(float) for i, v in usable(rows).items() if keep(v)}
    out = {}
    for q in own:
        if q % 50 == 0:
            order = sorted((-score(own[q], v), i) for i, v in own.items() if i != q)[:5]
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(order)]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_products_with_ties_and_unusable_rows(spark):
    rows = odd_rows()
    product = lambda a, b: int(np.floor(256 * a) @ np.floor(256 * b))
    assert got(top_products.top_products(frame(spark, rows), "vec_id", "embedding")) == want(rows, product)


def test_products_pruned_by_coordinates(spark, monkeypatch):
    monkeypatch.setattr(top_products, "SEEDS", 64)
    monkeypatch.setattr(top_products.vectors, "BLOCK", 128)
    rng = np.random.default_rng(2)
    rows = [(n, [float(x) for x in rng.normal(size=3) * 2]) for n in range(900)]
    product = lambda a, b: int(np.floor(256 * a) @ np.floor(256 * b))
    assert got(top_products.top_products(frame(spark, rows), "vec_id", "embedding")) == want(rows, product)
    part = top_products.Bucket(np.arange(900), np.floor(256 * np.array([v for _, v in rows])).astype(np.int64))
    at, scanned = part.by_coordinates(part.rows[0], part.size[0], 0.95)
    assert len(at) <= scanned < 900
    assert set(np.flatnonzero(part.unit @ part.unit[0] >= 0.95)) <= set(at.tolist())


def test_nearest_of_few_is_exact(spark):
    rows = [*odd_rows(), (2200, [0.0] * 8)]
    cosine = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    expected = want(rows, lambda a, b: round(cosine(a, b), 12), any)
    found = got(forest.nearest(frame(spark, rows), "vec_id", "embedding"))
    assert found.keys() == expected.keys()
    for q in found:
        assert np.allclose([s for _, _, s in found[q]], [s for _, _, s in expected[q]])
        assert [r for r, _, _ in found[q]] == [1, 2, 3, 4, 5]


def test_recall_of_many(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(9000, 24)).astype(np.float32)
    found = got(forest.nearest(frame(spark, [(n, v.tolist()) for n, v in enumerate(vectors)]), "vec_id", "embedding"))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = []
    for q in range(0, 9000, 50):
        score = unit @ unit[q]
        score[q] = -2
        hits.append(len({i for _, i, _ in found[q]} & set(np.argsort(-score)[:5].tolist())) / 5)
    assert np.mean(hits) >= 0.9


def test_no_vectors(spark):
    none, one = frame(spark, []), frame(spark, [(50, [1.0, 2.0])])
    for search in (top_products.top_products, forest.nearest):
        assert search(none, "vec_id", "embedding").count() == 0
        assert search(one, "vec_id", "embedding").count() == 0
