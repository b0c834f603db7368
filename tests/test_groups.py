"""Ids of any type, blocks of unseen items, vectors without Python, factors across two groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.functions import encode
from quillrank.operators import categories, features, group_factors, joins, rating_ids, recommend


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_unseen_items_by_block(spark, monkeypatch):
    rng = random.Random(1)
    catalogue = sorted(rng.sample(range(200_000), 70_000))
    frame = spark.createDataFrame([(i,) for i in [*catalogue, catalogue[0], None]], "item_id long")
    seen = {1: set(catalogue), 2: set(rng.sample(catalogue, 100)) | {10**9}, 3: set(catalogue[:32_768]) | set(catalogue[65_536:]), 9: {catalogue[0]}}
    rows = [(u, i) for u, items in seen.items() for i in items] + [(2, next(iter(seen[2]))), (None, 5), (2, None)]
    users = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,), (None,)], "user_id long")
    result = joins.unseen_items(users, frame, spark.createDataFrame(rows, "user_id long, item_id long"))
    got = {(r.user_id, r.block): r.unseen for r in result.collect()}
    assert result.where("n_unseen <> size(unseen)").count() == 0
    for user in (1, 2, 3, 4):
        for block in (1, 2, 3):
            part = catalogue[(block - 1) * 32_768 : block * 32_768]
            assert got.pop((user, block)) == [i for i in part if i not in seen.get(user, set())]
    assert not got
    assert joins.unseen_items(users, frame.limit(0), spark.createDataFrame(rows, "user_id long, item_id long")).count() == 0
    nothing = joins.unseen_items(users, frame, spark.createDataFrame([], "user_id long, item_id long"))
    assert nothing.agg(F.sum("n_unseen")).first()[0] == 4 * len(catalogue)
    texts = joins.unseen_items(spark.createDataFrame([("a",)], "user_id string"), spark.createDataFrame([("y",), ("x",)], "item_id string"),
                               spark.createDataFrame([("a", "x")], "user_id string, item_id string"))
    assert texts.first().unseen == ["y"]


def test_vectors_are_added_up_without_python(spark):
    rng = random.Random(2)
    rows = [(n, [(f"f{rng.randrange(40)}", float(rng.randint(-3, 3))) for _ in range(rng.randint(0, 30))]) for n in range(200)]
    df = spark.createDataFrame(rows, f"id int, f array<{encode.FEATURE}>")
    result = features.hash_group(df, "f", 4)
    assert "Python" not in plan_of(result) and "Arrow" not in plan_of(result)
    slots = {r.name: r.s for r in df.select(F.explode("f").alias("t")).select("t.name", features.slot(F.col("t.name"), 4).alias("s")).collect()}
    got = {r.id: r.features for r in result.collect()}
    for n, terms in rows:
        want = {}
        for name, value in terms:
            want[slots[name]] = want.get(slots[name], 0.0) + value
        assert got[n].size == 16 and dict(zip(got[n].indices.tolist(), got[n].values.tolist())) == want
        assert got[n].indices.tolist() == sorted(want)


def test_dummy_vectors_of_many_levels(spark):
    rows = [(n, f"v{n % 1500}" if n % 7 else None, n % 3) for n in range(4000)]
    df = spark.createDataFrame(rows, "id int, a string, b int")
    coded, known = categories.dummy_vector(df, ["a", "b"])
    levels = [("a", v) for v in sorted({r[1] for r in rows} - {None})] + [("b", str(n)) for n in range(3)]
    assert [(r.column, r.level) for r in known.orderBy("place").collect()] == levels and len(levels) > 1000
    place = {level: n for n, level in enumerate(levels)}
    for r in coded.collect():
        want = sorted(place[c, str(v)] for c, v in (("a", r.a), ("b", r.b)) if v is not None)
        assert r.features.size == len(levels) and r.features.indices.tolist() == want and set(r.features.values) <= {1.0}
    other = spark.createDataFrame([(1, "new", 2), (2, "v8", None)], "id int, a string, b int")
    again = {r.id: r.features.indices.tolist() for r in categories.dummy_vector(other, ["a", "b"], known=known)[0].collect()}
    assert again == {1: [place["b", "2"]], 2: [place["a", "v8"]]}


@pytest.fixture(scope="module")
def ratings(spark):
    rng = np.random.default_rng(4)
    u, v = rng.normal(size=(80, 2)), rng.normal(size=(60, 2))
    rows = [(a, b, float(3 + 0.5 * (a % 3) + u[a] @ v[b])) for a in range(80) for b in range(60) if rng.random() < 0.6]
    return spark.createDataFrame(rows, "user_id int, item_id int, rating double").repartition(3).cache()


@pytest.mark.parametrize("user, item", [(lambda c: F.concat(F.lit("u"), c), lambda c: F.concat(F.lit("i"), c)),
                                        (lambda c: c.cast("long") + 10**10, lambda c: c.cast("long") * 10**12)])
def test_ids_of_any_type(spark, ratings, user, item):
    named = ratings.select(user(F.col("user_id")).alias("who"), item(F.col("item_id")).alias("what"), "rating")
    odd = spark.createDataFrame([(None, None, 1.0)], "a string, b string, rating double").select(
        F.col("a").cast(named.schema["who"].dataType).alias("who"), F.col("b").cast(named.schema["what"].dataType).alias("what"), "rating")
    model = rating_ids.fit(named.unionByName(odd), "who", "what", rank=4, iterations=6, reg=0.05)
    scored = rating_ids.predict_pairs(model, named)
    assert scored.columns == ["who", "what", "rating", "prediction"]
    assert scored.agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("rating"), 2)))).first()[0] < 0.6
    unknown = named.limit(1).withColumn("what", F.col("what").cast("string").cast(named.schema["what"].dataType)).unionByName(odd)
    assert rating_ids.predict_pairs(model, unknown).count() == 1
    assert rating_ids.predict_pairs(model, unknown, unknown="nan").where("isnan(prediction)").count() == 1
    recs = rating_ids.recommend(model, named, 5)
    assert recs.schema["who"].dataType == named.schema["who"].dataType
    assert recs.join(named, ["who", "what"]).count() == 0 and recs.groupBy("who").count().where("count <> 5").count() == 0
    one = named.select("who").limit(1)
    few = rating_ids.recommend(model, named, 5, users=one)
    same = {(r.who, r.what): r.score for r in recs.join(one, "who", "left_semi").collect()}
    assert {(r.who, r.what): pytest.approx(r.score, abs=1e-5) for r in few.collect()} == same
    # The same scores as with plain numbers in the order of the ids.
    pairs = scored.select("who", "what").collect()[:50]
    users = {r.who: r.number for r in model.users.collect()}
    items = {r.what: r.number for r in model.items.collect()}
    left = {r.id: r.features for r in model.model.userFactors.collect()}
    right = {r.id: r.features for r in model.model.itemFactors.collect()}
    found = {(r.who, r.what): r.prediction for r in scored.collect()}
    for p in pairs:
        assert found[p.who, p.what] == pytest.approx(np.dot(left[users[p.who]], right[items[p.what]]), abs=1e-4)


@pytest.fixture(scope="module")
def groups(ratings):
    return ratings.withColumns({
        "u": encode.group([encode.token("u", F.col("user_id")), encode.token("kind", F.col("user_id") % 3)]),
        "i": encode.group([encode.token("i", F.col("item_id")), encode.amount("half", F.lit(0.5))]), "label": F.col("rating")}).cache()


def rmse(df):
    return df.agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("label"), 2)))).first()[0]


def test_planted_interaction_between_groups_is_found(spark, groups):
    train, test = groups.where("(user_id * 7 + item_id) % 5 <> 0"), groups.where("(user_id * 7 + item_id) % 5 = 0")
    model = group_factors.fit(train, "u", "i", bits=18, rank=4, iterations=60)
    flat = group_factors.GroupFactors(18, False, model.bias, model.weights, np.zeros_like(model.factors))
    scored = group_factors.predict(model, test, "u", "i")
    assert rmse(scored) < 0.5 < 1.0 < rmse(group_factors.predict(flat, test, "u", "i"))
    # Two features of one side bring what each brings alone, and nothing together.
    alone = [[("u1", 1.0)], [("kind2", 2.0)], [("u1", 1.0), ("kind2", 2.0)], None]
    frame = spark.createDataFrame([(n, a, []) for n, a in enumerate(alone)], f"n int, u array<{encode.FEATURE}>, i array<{encode.FEATURE}>")
    for left, right in (("u", "i"), ("i", "u")):
        got = {r.n: r.prediction - model.bias for r in group_factors.predict(model, frame, left, right).collect()}
        assert got[2] == pytest.approx(got[0] + got[1], abs=1e-12) and got[3] == 0


def test_gradients_are_those_of_the_loss(spark, groups):
    rows = group_factors.hashed(groups.limit(200).select("label", "u", "i"), "u", "i", 5)
    rng = np.random.default_rng(1)
    model = group_factors.GroupFactors(5, False, 0.3, rng.normal(size=(2, 32)), rng.normal(size=(2, 32, 3)))
    parts = rows.mapInArrow(group_factors._gradients(spark.sparkContext.broadcast(model)), "side int, slot int, g0 double, g1 double, g2 double, g3 double")
    got = {(r.side, r.slot): list(r)[2:] for r in parts.groupBy("side", "slot").sum("g0", "g1", "g2", "g3").collect()}
    table = rows.toPandas()

    def loss():
        total = 0.0
        for _, r in table.iterrows():
            own = []
            for n, s in enumerate(group_factors.SIDES):
                at, x = list(r[f"__{s}_slots"]), np.array(r[f"__{s}_values"])
                own.append((model.weights[n, at] @ x, x @ model.factors[n, at]))
            total += 0.5 * (model.bias + own[0][0] + own[1][0] + own[0][1] @ own[1][1] - r["label"]) ** 2
        return total

    base, e = loss(), 1e-5
    for n in (0, 1):
        slot = next(s for side, s in got if side == n)
        model.weights[n, slot] += e
        assert (loss() - base) / e == pytest.approx(got[n, slot][0], rel=1e-2, abs=1e-2)
        model.weights[n, slot] -= e
        model.factors[n, slot, 1] += e
        assert (loss() - base) / e == pytest.approx(got[n, slot][2], rel=1e-2, abs=1e-2)
        model.factors[n, slot, 1] -= e


def test_recommendations_of_group_factors_equal_all_pairs(spark, groups):
    model = group_factors.fit(groups, "u", "i", bits=12, rank=3, iterations=8)
    users, items = groups.select("user_id", "u").distinct(), groups.select("item_id", "i").distinct()
    for limits in ({}, {"user_tile": 20, "item_tile": 13, "broadcast_bytes": 0}):
        recs = group_factors.recommend(model, users, items, groups, "u", "i", 6, **limits)
        got = {}
        for r in recs.orderBy("user_id", "rank").collect():
            got.setdefault(r.user_id, []).append((r.item_id, r.score))
        every = users.crossJoin(items).join(groups.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
        scores = {}
        for r in group_factors.predict(model, every, "u", "i").collect():
            scores.setdefault(r.user_id, {})[r.item_id] = r.prediction
        assert got.keys() == scores.keys()
        for u, best in got.items():
            want = sorted(scores[u].values(), reverse=True)[:6]
            assert [s for _, s in best] == pytest.approx(want, abs=1e-4)
            assert all(scores[u][i] == pytest.approx(s, abs=1e-4) for i, s in best)


def test_group_factors_of_classes_and_nothing(spark, groups):
    labelled = groups.withColumn("label", (F.col("rating") > 3.5).cast("int"))
    model = group_factors.fit(labelled, "u", "i", bits=12, rank=3, iterations=40, classify=True)
    scored = group_factors.predict(model, labelled, "u", "i")
    assert scored.where("prediction NOT BETWEEN 0 AND 1").count() == 0
    assert scored.where("(prediction > 0.5) = (label = 1)").count() > 0.85 * labelled.count()
    none = group_factors.fit(labelled.where("label > 5"), "u", "i", bits=8)
    assert none.bias == 0 and group_factors.predict(none, labelled.limit(3).select("u", "i"), "u", "i").count() == 3
    assert group_factors.predict(model, labelled.limit(0), "u", "i").count() == 0


def test_a_task_hands_on_one_gradient_per_slot():
    """Whatever the number of batches, and the same sums as row by row."""
    from types import SimpleNamespace

    import pyarrow as pa

    from quillrank.operators import group_factors as gf

    rng = np.random.default_rng(4)
    model = gf.GroupFactors(3, False, 0.5, rng.normal(size=(2, 8)), rng.normal(size=(2, 8, 2)))
    rows = [([int(a)], [1.0], sorted({int(b), int(c)}), [2.0] * len({int(b), int(c)}), float(y))
            for a, b, c, y in zip(*rng.integers(0, 8, (3, 50)), rng.normal(size=50))]
    names = ["__left_slots", "__left_values", "__right_slots", "__right_values", "label"]
    types = [pa.list_(pa.int32()), pa.list_(pa.float64())] * 2 + [pa.float64()]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    parts = [whole.slice(n, 10) for n in range(0, 50, 10)]
    out = [r for b in gf._gradients(SimpleNamespace(value=model))(iter(parts)) for r in b.to_pylist()]
    assert len({(r["side"], r["slot"]) for r in out}) == len(out)
    want = np.zeros((2, 8, 3))
    for ls, lv, rs, rv, y in rows:
        one = [(model.weights[n, s] @ np.array(v), np.array(v) @ model.factors[n, s]) for n, (s, v) in enumerate(((ls, lv), (rs, rv)))]
        error = model.bias + one[0][0] + one[1][0] + one[0][1] @ one[1][1] - y
        for n, (s, v) in enumerate(((ls, lv), (rs, rv))):
            for slot, value in zip(s, v):
                want[n, slot] += value * error * np.r_[1, one[1 - n][1]]
    for r in out:
        if r["side"] < 2:
            assert np.allclose([r["g0"], r["g1"], r["g2"]], want[r["side"], r["slot"]])


def test_a_fit_reads_packed_blocks(spark, monkeypatch):
    """Few rows a step, and the same gradients whatever the blocks: single features, several, none, other values than 1."""
    from types import SimpleNamespace

    import pyarrow as pa

    from quillrank.operators import group_factors as gf

    rng = random.Random(6)
    group = lambda p, n: [(f"{p}{rng.randrange(9)}", rng.choice([1.0, -0.5])) for _ in range(n)]
    rows = [([("a1", 1.0)], [(f"b{n % 5}", 1.0)], float(n % 3)) for n in range(40)]
    rows += [(group("a", rng.randrange(4)), group("b", rng.randrange(4)), rng.random()) for _ in range(60)] + [(None, [("b1", 1.0)], 2.0)]
    df = spark.createDataFrame(rows, f"u array<{encode.FEATURE}>, i array<{encode.FEATURE}>, label double")
    inner, written = gf.pin, []
    monkeypatch.setattr(gf, "pin", lambda *given: written.append(inner(*given)) or written[-1])
    model = gf.fit(df, "u", "i", bits=4, rank=2, iterations=2)
    assert len(written) == 1 and written[0].count() <= df.rdd.getNumPartitions() < len(rows)
    table = gf.hashed(df, "u", "i", 4).select("label", *[f"__{s}_{p}" for s in gf.SIDES for p in ("slots", "values")]).toArrow().combine_chunks()

    def gradients(pack, pool, step):
        monkeypatch.setattr(gf, "PACK", pack)
        monkeypatch.setattr(gf, "POOL", pool)
        blocks = gf._packed(iter(table.to_batches(max_chunksize=step)))
        out = [r for b in gf._block_gradients(SimpleNamespace(value=model))(blocks) for r in b.to_pylist()]
        assert len({(r["side"], r["slot"]) for r in out}) == len(out)
        return {(r["side"], r["slot"]): [r["g0"], r["g1"], r["g2"]] for r in out}

    whole = gradients(10**6, 10**6, 1000)
    for given in ((7, 20, 3), (40, 1, 40), (1, 50, 1)):
        some = gradients(*given)
        assert some.keys() == whole.keys() and all(np.allclose(some[k], whole[k]) for k in whole)
    assert list(gf._packed(iter([pa.RecordBatch.from_pylist([], schema=table.schema)]))) == []
