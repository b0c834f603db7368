"""Learners, scoring, search and streaming. Fitted values have no SQL; tests check their quality."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions import encode, metrics, text
from quillrank.operators import features, group_factors, joins, learn, rating_ids, recommend, splits
from quillrank.plans import clicks, passengers, tournament
from quillrank.plans import ratings as rating_plans
from quillrank.plans.fixtures import view
from quillrank.queries.registry import query
from quillrank.queries.relational import FOUR_FIFTHS, HASHED
from quillrank.session import pin, scratch_path
from quillrank.streaming import published, scoring

ORDER = ["rated_at", "order_key", "line_no", "supp_key", "rating"]


def triples(spark: SparkSession, sf: str) -> DataFrame:
    """One rating per user and item, the last one."""
    return pin(joins.latest(view(spark, sf, "ratings"), ["user_id", "item_id"], ORDER, ["rating"]), "triples")


@query()
def als_fit_rmse(spark: SparkSession, sf: str) -> DataFrame:
    rows = pin(view(spark, sf, "ratings").select("user_id", "item_id", "rating"), "ratings")
    train, test = splits.random_split(rows, F.concat_ws("-", "user_id", "item_id"), 0.8)
    result = rating_plans.evaluate_model(train, test)
    return spark.createDataFrame([(result.rmse, result.scored, result.dropped)],
                                 "rmse double, scored bigint, dropped bigint")


@query()
def als_predict_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = triples(spark, sf)
    train, test = splits.random_split(rows, F.concat_ws("-", "user_id", "item_id"), 0.8)
    return recommend.predict_pairs(recommend.fit_ratings(train, iterations=5), test)


@query()
def als_recommend_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = triples(spark, sf)
    return recommend.recommend(recommend.fit_ratings(rows), rows, 10)


@query("""
WITH n AS (SELECT count(DISTINCT item_id) AS items FROM {ratings})
SELECT user_id, least(10, items - count(DISTINCT item_id)) AS recs, CAST(0 AS BIGINT) AS already_rated
FROM {ratings} CROSS JOIN n GROUP BY user_id, items""")
def als_recommend_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = triples(spark, sf)
    recs = recommend.recommend(recommend.fit_ratings(rows, rank=5, iterations=3), rows, 10)
    known = rows.select("user_id", "item_id", F.lit(1).alias("known"))
    return recs.join(known, ["user_id", "item_id"], "left").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("recs"), F.count("known").alias("already_rated")
    )


PREDICTED = f"""
WITH last AS (SELECT user_id, item_id, rating FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, item_id
                               ORDER BY rated_at DESC, order_key DESC, line_no DESC, supp_key DESC, rating DESC) AS rn
  FROM {{ratings}}) WHERE rn = 1),
b AS (SELECT *, {HASHED.replace('{key}', "concat_ws('-', user_id, item_id)")} AS bucket FROM last),
t AS (SELECT * FROM b WHERE bucket < {FOUR_FIFTHS})
SELECT user_id, item_id, rating FROM b
WHERE bucket >= {FOUR_FIFTHS} AND user_id IN (SELECT user_id FROM t) AND item_id IN (SELECT item_id FROM t)"""


#: The same without the condition that user and item are known.
PREDICTED_ALL = PREDICTED[:PREDICTED.index(" AND user_id IN")]


@query(PREDICTED)
def als_predicted_keys(spark: SparkSession, sf: str) -> DataFrame:
    train, test = splits.random_split(triples(spark, sf), F.concat_ws("-", "user_id", "item_id"), 0.8)
    scored = recommend.predict_pairs(recommend.fit_ratings(train, rank=5, iterations=3), test)
    return scored.filter(F.col("prediction").isNotNull()).select(
        F.col("user_id").cast("bigint"), F.col("item_id").cast("bigint"), "rating"
    )


def _renamed(spark: SparkSession, sf: str, user: Column, item: Column) -> tuple[DataFrame, DataFrame]:
    """Training and test ratings, split by the plain ids, under ids of another type."""
    rows = splits.random_split(triples(spark, sf), F.concat_ws("-", "user_id", "item_id"), 0.8)
    return tuple(part.select(user.alias("user_id"), item.alias("item_id"), "rating") for part in rows)


def _predicted(train: DataFrame, test: DataFrame) -> DataFrame:
    scored = rating_ids.predict_pairs(rating_ids.fit(train, rank=5, iterations=3), test)
    return scored.filter(F.col("prediction").isNotNull()).select("user_id", "item_id", "rating")


@query("SELECT 'u' || user_id AS user_id, 'i' || item_id AS item_id, rating FROM (" + PREDICTED + ") AS plain")
def als_predicted_text_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _predicted(*_renamed(spark, sf, encode.indicator("u", F.col("user_id")), encode.indicator("i", F.col("item_id"))))


@query("SELECT user_id + 10000000000 AS user_id, item_id + 20000000000 AS item_id, rating FROM (" + PREDICTED + ") AS plain")
def als_predicted_long_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _predicted(*_renamed(spark, sf, F.col("user_id") + 10**10, F.col("item_id") + 2 * 10**10))


@query("""
WITH n AS (SELECT count(DISTINCT item_id) AS items FROM {ratings})
SELECT 'u' || user_id AS user_id, least(10, items - count(DISTINCT item_id)) AS recs, CAST(0 AS BIGINT) AS already_rated
FROM {ratings} CROSS JOIN n GROUP BY user_id, items""")
def als_recommend_text_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = triples(spark, sf).withColumns({"user_id": encode.indicator("u", F.col("user_id")), "item_id": encode.indicator("i", F.col("item_id"))})
    recs = rating_ids.recommend(rating_ids.fit(rows, rank=5, iterations=3), rows, 10)
    known = rows.select("user_id", "item_id", F.lit(1).alias("known"))
    return recs.join(known, ["user_id", "item_id"], "left").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("recs"), F.count("known").alias("already_rated"))


@query()
def als_recommend_subset(spark: SparkSession, sf: str) -> DataFrame:
    rows = triples(spark, sf)
    users = view(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("user_id")
    )
    return recommend.recommend(recommend.fit_ratings(rows, iterations=5), rows, 10, users=users)


@query()
def evaluate_modes(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "ratings")
    return rating_plans.evaluate_modes(
        rows, ["order_key", "line_no", "item_id", "supp_key"], iterations=5
    )


def text_vectors(spark: SparkSession, sf: str, bits: int = 10) -> DataFrame:
    """Labelled documents as hashed word counts of their whole text."""
    rows = view(spark, sf, "text_examples").withColumn("words", F.split(text.clean(F.col("text")), " "))
    hashed = features.hash_tokens(rows, "words", bits)
    return pin(hashed.select("doc_id", F.col("label").cast("double").alias("label"), "features"), "texts")


def _split_texts(spark: SparkSession, sf: str, bits: int = 10) -> tuple[DataFrame, DataFrame]:
    return splits.random_split(text_vectors(spark, sf, bits), "doc_id", 0.8)


def _scores(scored: DataFrame, key: str) -> DataFrame:
    return learn.probability(scored).select(key, "label", "score", "prediction")


@query()
def logistic_elastic(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _split_texts(spark, sf)
    return _scores(learn.fit_logistic(train, l1=0.01, l2=0.01).transform(test), "doc_id")


@query()
def logistic_hashed_tol(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "clicks")
    train, test = splits.random_split(rows, "id", 0.8)
    model = clicks.fit(train, bits=14)
    return clicks.score(model, test, bits=14).select("id", "label", "score")


@query(f"""
SELECT id, label, CAST(1 AS INT) AS in_range FROM {{clicks}} WHERE {HASHED.replace('{key}', 'id')} >= {FOUR_FIFTHS}""")
def logistic_scored_keys(spark: SparkSession, sf: str) -> DataFrame:
    train, test = splits.random_split(view(spark, sf, "clicks"), "id", 0.8)
    scored = clicks.score(clicks.fit(train, bits=10, passes=5), test, bits=10)
    return scored.select("id", "label", F.col("score").between(0, 1).cast("int").alias("in_range"))


@query()
def logistic_quadratic(spark: SparkSession, sf: str) -> DataFrame:
    return passengers.fit_interactions(view(spark, sf, "passengers")).scored.select(
        "passenger_id", "label", "score"
    )


@query()
def logistic_dense_quadratic(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "embeddings").select(
        "vec_id", (F.col("label") >= 5).cast("int").alias("target"),
        *[F.get("embedding", n).alias(name) for n, name in enumerate(tournament.names())],
    )
    train, test = splits.random_split(rows, "vec_id", 0.8)
    return tournament.score(tournament.fit(train, passes=50), test).select("vec_id", "target", "score")


@query()
def mlp_one_hidden(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _split_texts(spark, sf, bits=8)
    return _scores(learn.fit_mlp(train, 5, 1 << 8).transform(test), "doc_id")


@query()
def fm_low_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = triples(spark, sf)
    tokens = F.array(encode.indicator("u", F.col("user_id")), encode.indicator("i", F.col("item_id")))
    hashed = features.hash_tokens(rows.withColumn("tokens", tokens), "tokens", 12)
    vectors = pin(hashed.select("user_id", "item_id", F.col("rating").cast("double").alias("label"),
                                "features"), "pairs")
    train, test = splits.random_split(vectors, F.concat_ws("-", "user_id", "item_id"), 0.8)
    return learn.fit_fm(train, 7, iterations=20).transform(test).select(
        "user_id", "item_id", "label", "prediction"
    )


def _pair_groups(rows: DataFrame) -> DataFrame:
    """Ratings with the user's and the item's features as two groups."""
    groups = {"u": encode.group([encode.token("u", F.col("user_id"))]), "i": encode.group([encode.token("i", F.col("item_id"))])}
    return rows.withColumns(groups).withColumn("label", F.col("rating").cast("double"))


@query(PREDICTED_ALL)
def group_factors_keys(spark: SparkSession, sf: str) -> DataFrame:
    train, test = splits.random_split(_pair_groups(triples(spark, sf)), F.concat_ws("-", "user_id", "item_id"), 0.8)
    model = group_factors.fit(train, "u", "i", bits=18, rank=7)
    scored = group_factors.predict(model, test, "u", "i")
    return scored.filter(F.col("prediction").isNotNull()).select("user_id", "item_id", "rating")


@query("""
WITH n AS (SELECT count(DISTINCT item_id) AS items FROM {ratings})
SELECT CAST(user_id AS BIGINT) AS user_id, least(10, items - count(DISTINCT item_id)) AS recs, CAST(0 AS BIGINT) AS already_rated
FROM {ratings} CROSS JOIN n GROUP BY user_id, items""")
def group_factors_recommend(spark: SparkSession, sf: str) -> DataFrame:
    rows = pin(_pair_groups(triples(spark, sf)), "pairs")
    model = group_factors.fit(rows, "u", "i", bits=18, rank=7)
    users, items = (rows.select(c, g).distinct() for c, g in (("user_id", "u"), ("item_id", "i")))
    recs = group_factors.recommend(model, users, items, rows, "u", "i", 10)
    known = rows.select("user_id", "item_id", F.lit(1).alias("known"))
    return recs.join(known, ["user_id", "item_id"], "left").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("recs"), F.count("known").alias("already_rated"))


@query()
def gbt_binary(spark: SparkSession, sf: str) -> DataFrame:
    named = splits.three_way(text_vectors(spark, sf, bits=8), "doc_id")
    fitting = named.filter("split <> 'test'").withColumn("held", F.col("split") == "validation")
    model = learn.fit_gbt(fitting, 2, 20, 1.0, validation="held")
    return _scores(model.transform(named.filter("split = 'test'")), "doc_id")


@query()
def search_holdout(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "passengers")
    spec = learn.logistic_regression(passes=[1, 5], l2=[1e-8, 1e-2], bits=10)
    examples = passengers.examples(rows)
    best = learn.search(spec, examples, "passenger_id", metrics.log_loss(F.col("label"), F.col("score")), False)
    chosen = [(name, float(best.params[name])) for name in spec.searched]
    return spark.createDataFrame(chosen, "parameter string, best double")


@query()
def train_and_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "passengers")
    train, test = splits.random_split(rows, "passenger_id", 0.5)
    return passengers.survivors(train, test.drop("survived"))


@query()
def train_and_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    result = passengers.fit_interactions(view(spark, sf, "passengers"))
    return result.scored.agg(
        metrics.log_loss(F.col("label"), F.col("score")).alias("log_loss"),
        metrics.accuracy(F.col("label"), F.col("prediction")).alias("accuracy"),
        F.count(F.lit(1)).alias("rows"),
    )


def _auc_row(spark: SparkSession, name: str, result: passengers.Scored) -> DataFrame:
    return spark.createDataFrame([(name, result.auc, result.rows.count())],
                                 "run string, auc double, rows bigint")


@query()
def passengers_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return _auc_row(spark, "indexed", passengers.fit_indexed(view(spark, sf, "passengers")))


@query()
def passengers_dummies(spark: SparkSession, sf: str) -> DataFrame:
    return _auc_row(spark, "dummies", passengers.fit_dummies(view(spark, sf, "passengers")))


@query()
def passengers_trees(spark: SparkSession, sf: str) -> DataFrame:
    return _auc_row(spark, "trees", passengers.fit_trees(view(spark, sf, "passengers")))


def _event_vectors(events: DataFrame) -> DataFrame:
    rows = events.withColumn("user_text", encode.indicator("u", F.col("user_id")))
    return features.hash_columns(rows, ["value", "user_text"], 10)


@query("SELECT event_id, 1 AS scored FROM {events}")
def score_stream(spark: SparkSession, sf: str) -> DataFrame:
    events = view(spark, sf, "events")
    labeled = _event_vectors(events.withColumn("label", encode.binary(F.col("event_type"), "click").cast("double")))
    model = learn.fit_logistic(pin(labeled.select("label", "features"), "events"), l2=0.01, iterations=5)
    stream = scoring.arriving(spark, f"{sf}/event[s].parquet", events.schema)

    def finish(scored: DataFrame) -> DataFrame:
        return scored.select("event_id", vector_to_array("probability")[1].alias("score"))

    scores = scoring.score_available(scoring.score_stream(model, stream, _event_vectors, finish))
    return scores.select("event_id", F.col("score").between(0, 1).cast("int").alias("scored"))


@query("SELECT event_id, CAST(2 AS BIGINT) AS version, 1 AS scored FROM {events}")
def score_stream_published(spark: SparkSession, sf: str) -> DataFrame:
    """Events scored by the newer of two published models."""
    events = view(spark, sf, "events")
    labeled = _event_vectors(events.withColumn("label", encode.binary(F.col("event_type"), "click").cast("double")))
    vectors = pin(labeled.select("label", "features"), "events")
    models = published.Published(spark, scratch_path(spark, "models"), LogisticRegressionModel)
    for l2 in (1.0, 0.01):
        models.publish(learn.fit_logistic(vectors, l2=l2, iterations=5))
    stream = scoring.arriving(spark, f"{sf}/event[s].parquet", events.schema)
    out = scratch_path(spark, "scores")
    published.score_with_published(
        models, stream, _event_vectors, lambda scored: scored.select("event_id", vector_to_array("probability")[1].alias("score")), out,
        scratch_path(spark, "progress")).awaitTermination()
    scores = spark.read.parquet(out)
    return scores.select("event_id", "version", F.col("score").between(0, 1).cast("int").alias("scored"))
