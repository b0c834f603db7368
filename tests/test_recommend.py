import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.functions import metrics
from quillrank.operators import recommend, splits
from quillrank.plans import ratings as plans


@pytest.fixture(scope="module")
def planted(spark):
    """Ratings 3 + u.v with rank-2 vectors from a hash; one user has rated nearly all, one item nearly everywhere."""
    rng = np.random.default_rng(5)
    u, v = rng.normal(size=(120, 2)), rng.normal(size=(90, 2))
    rows = [
        (a, b, float(np.clip(3 + u[a] @ v[b], 0, 5)))
        for a in range(120) for b in range(90)
        if rng.random() < 0.25 or (a == 7 and b < 86) or b == 11
    ]
    return spark.createDataFrame(rows, "user_id int, item_id int, rating double").repartition(4).cache()


@pytest.fixture(scope="module")
def model(planted):
    return recommend.fit_ratings(planted, rank=3, iterations=8, reg=0.05)


def brute_force(model, ratings, k):
    users = {r.id: np.array(r.features, "f4") for r in model.userFactors.collect()}
    items = {r.id: np.array(r.features, "f4") for r in model.itemFactors.collect()}
    seen = {(r.user_id, r.item_id) for r in ratings.collect()}
    best = {}
    for u, f in users.items():
        scored = sorted(((float(f @ g), i) for i, g in items.items() if (u, i) not in seen), reverse=True)
        best[u] = scored[:k]
    return best


@pytest.mark.parametrize("tiles", [(1024, 8192, 1 << 20), (30, 17, 1 << 20), (30, 17, 0)])
def test_recommendations_equal_brute_force(model, planted, tiles):
    users, items, size = tiles
    recs = recommend.recommend(
        model, planted, 10, user_tile=users, item_tile=items, broadcast_bytes=size
    ).collect()
    want = brute_force(model, planted, 10)
    got = {}
    for r in sorted(recs, key=lambda r: r["rank"]):
        got.setdefault(r.user_id, []).append((r.score, r.item_id))
    assert set(got) == {u for u in want if want[u]}
    for user, rows in got.items():
        assert [s for s, _ in rows] == pytest.approx([s for s, _ in want[user]], abs=1e-4)
    assert len(got[7]) == len(want[7]) < 10
    seen = {(r.user_id, r.item_id) for r in planted.collect()}
    assert not seen & {(r.user_id, r.item_id) for r in recs}


def test_recommendations_agree_with_the_built_in_list(model, planted):
    most = planted.groupBy("user_id").count().agg(F.max("count")).first()[0]
    wide = model.recommendForAllUsers(10 + most).select("user_id", F.explode("recommendations").alias("r"))
    kept = wide.select("user_id", "r.item_id", "r.rating").join(planted, ["user_id", "item_id"], "left_anti")
    per_user = {r.user_id: sorted(r.s, reverse=True)[:10]
                for r in kept.groupBy("user_id").agg(F.collect_list("rating").alias("s")).collect()}
    recs = recommend.recommend(model, planted, 10).groupBy("user_id").agg(F.collect_list("score").alias("s"))
    for r in recs.collect():
        assert sorted(r.s, reverse=True) == pytest.approx(per_user[r.user_id], abs=1e-4)


def test_chosen_users_and_score_range(model, planted, spark):
    users = spark.createDataFrame([(1,), (7,), (9999,)], "user_id int")
    recs = recommend.recommend(model, planted, 5, users=users, score_range=(0.0, 2.5)).collect()
    assert {r.user_id for r in recs} <= {1, 7}
    assert all(0 <= r.score <= 2.5 for r in recs)


def test_ties_go_to_the_larger_item(spark):
    from quillrank.functions.tiles import best_of_tile
    import pandas as pd

    tile = pd.DataFrame([{"user_ids": [1], "user_factors": [1.0], "item_ids": [3, 9, 5, 7],
                          "item_factors": [2.0, 2.0, 2.0, 1.0]}])
    seen = pd.DataFrame({"user_id": [1], "item_id": [9]})
    out = best_of_tile(tile, seen, 2, -np.inf, np.inf)
    assert list(out.item_id) == [5, 3]


def test_small_slices_give_the_same_tile(monkeypatch):
    from quillrank.functions import tiles
    import pandas as pd

    rng = np.random.default_rng(1)
    tile = pd.DataFrame([{"user_ids": np.arange(9), "user_factors": rng.integers(0, 3, 18).astype("f4"),
                          "item_ids": np.arange(20), "item_factors": rng.integers(0, 3, 40).astype("f4")}])
    seen = pd.DataFrame({"user_id": rng.integers(0, 12, 60), "item_id": rng.integers(0, 25, 60)})
    whole = tiles.best_of_tile(tile, seen, 4, 0, 9)
    monkeypatch.setattr(tiles, "CELLS", 40)
    assert whole.equals(tiles.best_of_tile(tile, seen, 4, 0, 9))
    assert not set(zip(whole.user_id, whole.item_id)) & set(zip(seen.user_id, seen.item_id))


def test_tiling_bounds_every_tile():
    assert recommend.tiling(15_000, 20_000, 600_000, 8) == (32, 1)
    users, items = recommend.tiling(10**9, 10**7, 10**12, 8_000)
    assert 10**9 / users <= recommend.USER_TILE and 10**7 / items <= recommend.ITEM_TILE
    assert 10**12 / users / items <= recommend.TILE_RATINGS
    assert recommend.tiling(100, 50, 0, 8_000) == (1, 1)


def test_model_beats_the_mean(planted):
    train, test = splits.random_split(planted, F.concat_ws("-", "user_id", "item_id"), 0.8)
    result = plans.evaluate_model(train, test, rank=3, iterations=10, reg=0.02)
    mean = train.agg(F.avg("rating")).first()[0]
    base = test.agg(metrics.rmse(F.col("rating"), F.lit(mean))).first()[0]
    assert result.rmse < 0.6 * base
    assert result.scored + result.dropped == test.count()


@pytest.mark.parametrize("block", [10, 16, 1024])
def test_shared_ranking_equals_brute_force(spark, block):
    rng = np.random.default_rng(2)
    n_users, n_items, k = 40, 95, 10
    rows = {(u, i) for u in range(n_users) for i in range(n_items) if rng.random() < 0.15}
    rows |= {(0, i) for i in range(n_items) if i % 13}  # nearly all rated
    rows |= {(1, i) for i in range(n_items)}  # all rated
    rows |= {(2, i) for i in range(60)}
    rows |= {(3, 94)}
    ratings = spark.createDataFrame([(u, i, (i * 7) % 5 + 1) for u, i in sorted(rows)] * 2,
                                    "user_id bigint, item_id bigint, rating int").repartition(5)
    ranked = recommend.item_means(ratings).cache()
    place = {r.item_id: r.position for r in ranked.collect()}
    got = {}
    for r in recommend.unseen_by_rank(ratings, ranked, k, block).collect():
        got.setdefault(r.user_id, []).append((r["rank"], r.item_id))
    for u in range(n_users):
        want = sorted((i for i in place if (u, i) not in rows), key=place.get)[:k]
        assert [i for _, i in sorted(got.get(u, []))] == want
        assert [n for n, _ in sorted(got.get(u, []))] == list(range(1, len(want) + 1))


def test_pair_space_adds_up(spark):
    ratings = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 3)], "user_id int, item_id int")
    items = spark.range(5).toDF("item_id")
    rows = {r.user_id: (r["items"], r.rated, r.unrated) for r in recommend.pair_space(ratings, items).collect()}
    assert rows == {1: (5, 2, 3), 2: (5, 1, 4)}


def test_most_pairs_are_never_scored(spark, monkeypatch):
    """Users are done long before the last item, and the lists are those of all pairs."""
    from quillrank.functions.tiles import Shape, best_of_tile
    import pandas as pd

    rng = np.random.default_rng(3)
    users, items = rng.normal(size=(40, 4)).astype("f4"), (rng.normal(size=(6000, 4)) * [3, 1, 1, .2] + [5, 0, 0, 1]).astype("f4")
    tables = [spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(t)], "id int, features array<float>") for t in (users, items)]
    scores = users.astype("f8") @ items.T
    seen = {(u, int(i)) for u in range(40) for i in np.argsort(-scores[u])[: u % 5]}
    rated = spark.createDataFrame(sorted(seen), "user_id int, item_id int")
    asked = []
    inner = recommend._by_tiles
    monkeypatch.setattr(recommend, "_by_tiles", lambda people, block, n, *more: asked.append((people.count(), n)) or inner(people, block, n, *more))
    got = {}
    for r in recommend.recommend_by_vectors(*tables, 4, rated, 5, item_tile=400, user_tile=16).orderBy("rank").collect():
        got.setdefault(r.user_id, []).append(r.item_id)
    for u in range(40):
        assert got[u] == [int(i) for i in np.argsort(-scores[u]) if (u, int(i)) not in seen][:5]
    assert sum(n * m for n, m in asked) < 0.6 * 40 * 6000
    # Inside a tile too: without the last items the lists are the same.
    shape = Shape.of(len(items), items.sum(0, dtype="f8"), items.T.astype("f8") @ items, float(np.linalg.norm(items, axis=1).max()))
    tile = pd.DataFrame([{"user_ids": np.arange(40), "user_factors": users.ravel(), "item_ids": np.arange(6000), "item_factors": items.ravel()}])
    none = pd.DataFrame({"user_id": [], "item_id": []}, dtype="i4")
    whole, cut = (best_of_tile(tile, none, 5, -np.inf, np.inf, s).sort_values(["user_id", "score"]) for s in (None, shape))
    assert list(whole.item_id) == list(cut.item_id)


def test_odd_vectors_are_not_lost(spark):
    """Equal items, items that differ in nothing and fewer items than asked for."""
    users = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, -1.0])], "id int, features array<float>")
    items = spark.createDataFrame([(n, [1.0, float(n // 4)]) for n in range(12)], "id int, features array<float>")
    rated = spark.createDataFrame([(1, 11), (2, 3)], "user_id int, item_id int")
    for tile in (3, 100):
        rows = recommend.recommend_by_vectors(users, items, 2, rated, 4, item_tile=tile).orderBy("user_id", "rank").collect()
        assert [(r.user_id, r.item_id) for r in rows] == [(1, 10), (1, 9), (1, 8), (1, 7), (2, 2), (2, 1), (2, 0), (2, 7)]
    flat = spark.createDataFrame([(n, [1.0, 1.0]) for n in range(12)], "id int, features array<float>")
    rows = recommend.recommend_by_vectors(users, flat, 2, rated, 20, item_tile=3).collect()
    assert len(rows) == 22


def test_blocks_of_a_large_fit():
    assert recommend.factor_blocks(100, 12) == 12 and recommend.factor_blocks(12_000_000, 12) == 12
    assert recommend.factor_blocks(29_000_000, 12) == recommend.factor_blocks(156_000_000, 12) == 8
    assert recommend.factor_blocks(400_000_000, 12) == 20


def test_blocks_of_a_large_fit_leave_memory_to_its_tasks(planted, monkeypatch):
    levels = []
    inner = recommend.ALS
    monkeypatch.setattr(recommend, "ALS", lambda **given: levels.append(given["intermediateStorageLevel"]) or inner(**given))

    def factors():
        return sorted((r.id, r.features) for r in recommend.fit_ratings(planted, rank=2, iterations=2).itemFactors.collect())

    kept = factors()
    monkeypatch.setattr(recommend, "KEPT_RATINGS", 100)
    assert factors() == kept and levels == ["MEMORY_AND_DISK", "DISK_ONLY"]
