"""How work is cut where tables grow: what the plans look like, and that the rows stay the same."""

from pyspark.sql import functions as F

from quillrank.functions import encode
from quillrank.operators import joins, learn, rating_ids
from quillrank.plans.fixtures import view
from quillrank.queries import load
from quillrank.session import tasks_for

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_customers_use_all_slots(spark):
    for name in ("customer", "passengers"):
        assert view(spark, SF, name).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_products_are_rows_at_once(spark):
    assert "flatten" not in _plan(load()[0]["cross_pairs"](spark, SF))
    feature = "array<struct<name:string,value:double>>"
    rows = spark.createDataFrame([(1, [("a", 2.0), ("b", -1.0)], [("x", 3.0), ("y", 1.0)]), (2, [("a", 1.0)], []), (3, None, [("x", 1.0)])],
                                 f"k int, u {feature}, v {feature}")
    want = rows.select("k", F.explode(encode.interact(F.col("u"), F.col("v"))).alias("p"))
    got = encode.interact_rows(rows, "u", "v")
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() == 4


def test_rule_rows(spark):
    rows = spark.createDataFrame([(1, "a", 2.5), (2, None, None), (3, "", 1.0), (4, "skip", 0.0), (1, "a", 2.5)], "k long, t string, x double")

    def rule(row):
        if row["t"] == "skip":
            return None
        return {"g": [row["t"], ("x", row["x"]), None, (None, 1.0), ("n", 7)], "h": None if row["k"] == 3 else ["only"], "label": row["x"] and int(row["x"] == 1)}

    got = sorted(map(tuple, learn.featurize_rows(rows, rule, ["g", "h"], keep=["k"]).collect()))
    first = (1, [("a", 1.0), ("x", 2.5), ("n", 7.0)], [("only", 1.0)], 0.0)
    assert got == [first, first, (2, [("n", 7.0)], [("only", 1.0)], 0.0), (3, [("", 1.0), ("x", 1.0), ("n", 7.0)], [], 1.0)]
    unlabeled = learn.featurize_rows(rows.where("k = 4"), rule, ["g", "h"], labeled=False)
    assert unlabeled.columns == ["g", "h"] and unlabeled.count() == 0


def test_a_second_lookup_counts_the_plain_table(spark, monkeypatch):
    counted = []
    monkeypatch.setattr(joins, "fits_broadcast", lambda df, *a: False)
    monkeypatch.setattr(joins, "hot_keys", lambda df, *a, f=joins.hot_keys: counted.append(_plan(df)) or f(df, *a))
    rows = spark.createDataFrame([("u", "i", 1), ("v", "j", 2), ("x", "i", 3), ("u", "q", 4)], "user_id string, item_id string, rating int")
    users, items = (spark.createDataFrame(given, f"{c}_id string, number int") for given, c in (([("u", 0), ("v", 1)], "user"), ([("i", 0), ("j", 1)], "item")))
    model = rating_ids.KeyedModel(None, users, items)
    assert sorted(map(tuple, model.numbered(rows).select("user_id", "item_id", "rating").collect())) == [(0, 0, 1), (1, 1, 2)]
    left = model.numbered(rows, "left").select("user_id", "item_id", "rating").collect()
    assert sorted(map(tuple, left)) == [(-1, 0, 3), (0, -1, 4), (0, 0, 1), (1, 1, 2)]
    assert len(counted) == 4 and not any("Join" in plan for plan in counted)


def test_a_low_rank_fit_reads_few_rows_a_task(spark, monkeypatch):
    parts = []

    class Fit:
        def __init__(self, **given):
            pass

        def fit(self, df):
            parts.append((df.rdd.getNumPartitions(), df.count()))

    monkeypatch.setattr(learn, "FMRegressor", Fit)
    monkeypatch.setattr(learn, "FM_ROWS", 100, raising=False)
    rows = spark.range(1_000, numPartitions=2)
    learn.fit_fm(rows)
    monkeypatch.setattr(learn, "FM_ROWS", 10_000)
    learn.fit_fm(rows)
    assert parts == [(10, 1_000), (2, 1_000)]


def test_tiles_work_out_the_join_once(spark):
    tiles = load()[0]["union_tiles"](spark, SF)
    assert "Join" not in _plan(tiles)
    want = view(spark, SF, "ratings").selectExpr("user_id", "item_id", "rating", "order_key", "pmod(user_id, 4) AS tile")
    assert sorted(tiles.collect()) == sorted(want.collect())


def test_unseen_pairs_come_from_one_join_in_many_tasks(spark):
    pairs = load()[0]["unseen_pairs"](spark, SF)
    assert not [f for f in pairs.inputFiles() if "lineitem" in f]
    assert tasks_for(spark, 36_000_000) == 72 and tasks_for(spark, 3) == spark.sparkContext.defaultParallelism
    some = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (None, 1), (2, None)], "u long, i long")
    known = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 1)], "u long, i long")
    key = lambda r: tuple((v is not None, v) for v in r)
    want = [(None, 1), (1, 2), (2, None), (2, 1)]
    for tasks in (None, 3):
        assert sorted(map(tuple, joins.drop_known(some, known, ["u", "i"], tasks).collect()), key=key) == want


def test_rated_pairs_are_numbered_once(spark, monkeypatch):
    """Rounds of items read written numbers, not the joins with the ids again; the lists are the same."""
    rows = [(f"u{u}", f"i{i}", float((u * i) % 5 + 1)) for u in range(30) for i in range(40) if (u * 7 + i * 3) % 4] + [(None, "i1", 1.0)]
    ratings = spark.createDataFrame(rows, "user_id string, item_id string, rating double")
    model = rating_ids.fit(ratings, rank=2, iterations=2, blocks=2)
    given = []
    inner = rating_ids.plain.recommend_by_vectors
    monkeypatch.setattr(rating_ids.plain, "recommend_by_vectors", lambda *a: given.append(a[3]) or inner(*a))
    once, rounds = (sorted(map(tuple, rating_ids.recommend(model, ratings, 3, item_tile=tile).collect())) for tile in (1_000, 7))
    assert once == rounds and once and not {r[:2] for r in once} & {r[:2] for r in rows}
    assert not any("Join" in _plan(rated) for rated in given)
