import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quillrank.functions import encode, metrics, text
from quillrank.operators import categories, evaluate, features, learn, splits
from quillrank.sources import writers
from quillrank.streaming import scoring


@pytest.fixture(scope="module")
def planted(spark):
    """The label is the sign of a fixed linear function, with one label in twenty flipped."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 4))
    y = (x @ np.array([2.0, -1.0, 0.5, 0.0]) > 0) ^ (rng.random(1500) < 0.05)
    rows = [(n, int(y[n]), *map(float, x[n])) for n in range(1500)]
    return spark.createDataFrame(rows, "id int, target int, a double, b double, c double, d double").cache()


def examples(df):
    group = encode.group([encode.amount(c, F.col(c)) for c in "abcd"])
    return learn.featurize(df, {"f": group}, F.col("target"), keep=["id"])


def held_out_auc(spec, df, **kw):
    result = learn.run(spec, examples(df), key="id", **kw)
    return evaluate.auc(result.scored, "label", "score").first()[0], result


def test_logistic_finds_the_planted_signal(planted):
    auc, _ = held_out_auc(learn.logistic_regression(passes=8, l1=1e-4, l2=1e-4, bits=8), planted)
    assert auc > 0.9


def test_hidden_layer_finds_the_planted_signal(planted):
    auc, _ = held_out_auc(learn.logistic_regression(passes=30, nn=5, bits=5), planted)
    assert auc > 0.9


def test_trees_and_factors_find_the_planted_signal(planted):
    rows = features.assemble(planted, list("abcd")).withColumn("label", F.col("target").cast("double"))
    train, test = splits.random_split(rows, "id", 0.8)
    trees = learn.probability(learn.fit_gbt(train, 2, 6).transform(test))
    assert evaluate.auc(trees, "label", "score").first()[0] > 0.85
    fm = learn.probability(learn.fit_fm(train, 3, 40, step=0.1, classify=True).transform(test))
    assert evaluate.auc(fm, "label", "score").first()[0] > 0.85


def test_interactions_carry_an_xor(spark):
    rng = np.random.default_rng(8)
    bits = rng.integers(0, 2, size=(600, 2))
    rows = [(n, int(a ^ b), int(a), int(b)) for n, (a, b) in enumerate(bits)]
    df = spark.createDataFrame(rows, "id int, target int, a int, b int")
    group = encode.group([encode.token("a", F.col("a")), encode.token("b", F.col("b"))])
    made = learn.featurize(df, {"f": group}, F.col("target"), keep=["id"])
    plain = learn.run(learn.logistic_regression(passes=5, bits=10), made, key="id").scored
    crossed = learn.run(learn.logistic_regression(passes=5, bits=10, quadratic="ff"), made, key="id").scored
    assert evaluate.auc(plain, "label", "score").first()[0] < 0.75
    assert evaluate.auc(crossed, "label", "score").first()[0] > 0.99


def test_search_picks_the_better_penalty(planted):
    spec = learn.logistic_regression(passes=5, l2=[1e-6, 50.0, 200.0], bits=6)
    _, result = held_out_auc(spec, planted, metric=metrics.log_loss(F.col("label"), F.col("score")),
                             larger_is_better=False)
    assert result.spec.params["l2"] == 1e-6 and not result.spec.searched


def test_choices_of_ranges_and_lists():
    assert learn.choices([1, 5]) == [1, 2, 3, 4, 5]
    assert learn.choices([5, 10, 15, 20]) == [5, 10, 15, 20]
    assert learn.choices([1e-8, 1e-4]) == pytest.approx([1e-8, 1e-7, 1e-6, 1e-5, 1e-4])


def test_spec_refuses_unknown_parameters():
    with pytest.raises(TypeError):
        learn.logistic_regression(paces=3)
    assert learn.als(passes=10, cores=4, quadratic="cp", rank=10, nn=5, l2=0.01, power_t=0).params == {
        "passes": 10, "rank": 10, "l2": 0.01}


def test_two_tables_keep_keys_and_need_no_label(planted):
    train, test = splits.random_split(planted, "id", 0.5)
    made = learn.featurize(test.drop("target"), {"f": encode.group([encode.amount("a", F.col("a"))])}, keep=["id"])
    result = learn.run(learn.logistic_regression(bits=8), examples(train), made, key="id")
    assert result.scored.count() == test.count()
    assert set(result.scored.columns) >= {"id", "score", "prediction"}


def test_saved_model_scores_the_same(planted, tmp_path):
    rows = features.assemble(planted, list("abcd")).withColumn("label", F.col("target").cast("double"))
    model = learn.fit_logistic(rows)
    writers.save_model(model, str(tmp_path / "m"))
    again = writers.load_model(LogisticRegressionModel, str(tmp_path / "m"))
    pick = lambda m: sorted((r.id, r.s) for r in learn.probability(m.transform(rows), "s").select("id", "s").collect())
    assert pick(model) == pick(again)


def test_stream_scores_equal_batch_and_come_once(spark, planted, tmp_path):
    rows = features.assemble(planted, list("abcd")).withColumn("label", F.col("target").cast("double"))
    model = learn.fit_logistic(rows)
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    half = planted.filter("id < 700").repartition(5)
    half.write.parquet(source)

    def finish(df):
        return df.select("id", vector_to_array("probability")[1].alias("score"))

    def go():
        stream = scoring.arriving(spark, source, planted.schema)
        scored = scoring.score_stream(model, stream, lambda d: features.assemble(d, list("abcd")), finish)
        scoring.write_scores(scored, out, progress).awaitTermination()
        return {r.id: r.score for r in spark.read.parquet(out).collect()}, spark.read.parquet(out).count()

    first, n = go()
    assert n == 700 == len(first)
    planted.filter("id >= 700").write.mode("append").parquet(source)
    both, n = go()
    assert n == 1500 == len(both)
    want = {r.id: r.score for r in finish(model.transform(rows)).collect()}
    assert both == pytest.approx(want)


def test_hashed_slots_are_stable_and_add_up(spark):
    df = spark.createDataFrame([(1, 2.0, "x"), (2, None, "x")], "id int, n double, t string")
    group = encode.group([encode.amount("n", F.col("n")), encode.token("t_", F.col("t"))])
    rows = {r.id: r.features for r in features.hash_group(df.withColumn("f", group), "f", 20).collect()}
    assert sorted(rows[1].values) == [1.0, 2.0] and list(rows[2].values) == [1.0]
    assert rows[2].indices[0] in rows[1].indices
    clash = features.hash_group(df.withColumn("f", group), "f", 0).collect()
    assert {r.id: list(r.features.values) for r in clash} == {1: [3.0], 2: [1.0]}
    assert features.hash_group(df.withColumn("f", F.array().cast(f"array<{encode.FEATURE}>")), "f", 4
                               ).first().features.numNonzeros() == 0


def test_index_orders_by_count_then_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "t string")
    for few in (0, 100):
        rows = {r.t: r.idx for r in categories.category_freq(df, "t", few).collect()}
        assert rows == {"c": 0, "a": 1, "b": 2}
    kept = {r.t: r.i for r in categories.index_column(df, "t", "i").collect()}
    assert kept == {"c": 0.0, "a": 1.0, "b": 2.0, None: 3.0}
    with pytest.raises(ValueError):
        categories.dummies(df, ["t"], most=2)


def test_metrics_match_the_built_in_evaluators(spark, planted):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator

    rows = planted.select("target", F.col("a").alias("p"), F.col("target").cast("double").alias("label"))
    built_in = BinaryClassificationEvaluator(rawPredictionCol="p", numBins=0).evaluate(rows)
    assert evaluate.auc(rows, "label", "p").first()[0] == pytest.approx(built_in)
    rmse = RegressionEvaluator(predictionCol="p").evaluate(rows)
    assert evaluate.rmse(rows, "label", "p").first()["rmse"] == pytest.approx(rmse)


def test_title_rules():
    assert set(text.FULL_TITLES.values()) == {"Sir", "Mlle"} and "Mme" not in text.SHORT_TITLES


def test_search_moves_the_form_of_the_vectors(spark):
    rng = random.Random(5)
    rows = [(n, rng.randrange(2), rng.randrange(2), rng.randrange(400)) for n in range(1200)]
    df = spark.createDataFrame([(n, a, b, f"w{c}", float(a ^ b)) for n, a, b, c in rows], "id long, a int, b int, w string, label double")
    group = encode.group([encode.token("a_", F.col("a")), encode.token("b_", F.col("b"))])
    noise = encode.group([encode.token("", F.col("w"))])
    examples = learn.featurize(df, {"f": group}, F.col("label"), keep=["id"])
    metric = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    spec = learn.logistic_regression(passes=30, bits=12, quadratic=[None, "ff"])
    assert learn.search(spec, examples, "id", metric, True).params["quadratic"] == "ff"
    wide = learn.featurize(df.withColumn("label", F.col("a").cast("double")), {"f": group, "g": noise}, F.col("label"), keep=["id"])
    spec = learn.logistic_regression(passes=30, bits=[2, 10, 14][0:1] + [12, 13], quadratic=None)
    assert learn.search(spec, wide, "id", metric, True).params["bits"] > 2


def test_hidden_layer_takes_no_penalty():
    with pytest.raises(TypeError):
        learn.logistic_regression(nn=5, l1=0.1)


def test_small_shares_are_kept(spark):
    rows = spark.range(20_000)
    train, test = splits.random_split(rows, "id", 0.9997)
    assert train.count() + test.count() == 20_000 and 0 < test.count() < 20
    sizes = dict(splits.part_sizes(splits.with_split(rows, "id", {"a": 0.9997, "b": 0.0003})).collect())
    assert sizes["a"] == train.count() and sizes["b"] == test.count()


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1.0, 0.3), (1.0, 0.4)], "label double, score double")
    assert evaluate.auc(df, "label", "score").first().auc is None
    none = spark.createDataFrame([], "user_id int")
    assert evaluate.coverage(none, none).first().percent is None


def test_digits_to_the_very_end(spark):
    df = spark.createDataFrame([("12",), ("12\n",)], "t string")
    assert [r[0] for r in df.select(text.is_digits(F.col("t"))).collect()] == [True, False]
