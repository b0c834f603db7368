"""Projections, predicates, joins, aggregates, row numbers, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions import encode, text
from quillrank.operators import categories, evaluate, impute, joins, ordered, recommend, splits
from quillrank.plans.fixtures import view
from quillrank.queries.registry import query
from quillrank.queries.scans import BASELINE_RECS, NUMBERS, TEXTS, WIDE_FIELDS, baseline_recs, wide_fields
from quillrank.session import pin, scratch_path, tasks_for
from quillrank.sources import writers

LINE_KEY = ["order_key", "line_no", "item_id", "supp_key"]


def big(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


@query('SELECT user_id AS "user", item_id AS item, rating, order_key FROM {ratings}')
def project_rename(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "ratings").select(
        F.col("user_id").alias("user"), F.col("item_id").alias("item"), "rating", "order_key"
    )


@query("SELECT pclass, sex, age, sibsp, parch, fare, embarked, survived FROM {passengers}")
def drop_columns(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "passengers").drop("passenger_id", "name").select(
        "pclass", "sex", "age", "sibsp", "parch", "fare", "embarked", "survived"
    )


@query("""
SELECT order_key, CAST(line_no AS BIGINT) AS line_no, item_id, round(pow(prediction - rating, 2), 6) AS sq_error
FROM {predictions}""")
def derive_sq_error(spark: SparkSession, sf: str) -> DataFrame:
    error = encode.squared_error(F.col("rating"), F.col("prediction"))
    return view(spark, sf, "predictions").select(
        "order_key", *big("line_no"), "item_id", F.round(error, 6).alias("sq_error")
    )


@query("""
SELECT passenger_id, age, embarked, fare FROM {passengers} WHERE age IS NOT NULL AND embarked IS NOT NULL""")
def drop_null_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "passengers").select("passenger_id", "age", "embarked", "fare")
    return joins.drop_nulls(rows, ["age", "embarked"])


_PRESENT = ", ".join([f"CASE WHEN {c} IS NOT NULL THEN concat('{c}:', CAST({c} AS VARCHAR)) END" for c in NUMBERS]
                     + [f"CASE WHEN {c} IS NOT NULL THEN concat('{c}_', {c}, ':1') END" for c in TEXTS])


@query(f"SELECT id, concat_ws(' ', {_PRESENT}) AS features FROM {{clicks}}")
def emit_present_features(spark: SparkSession, sf: str) -> DataFrame:
    made = encode.group([*[encode.amount(c, F.col(c)) for c in NUMBERS], *[encode.token(f"{c}_", F.col(c)) for c in TEXTS]])
    return view(spark, sf, "clicks").select("id", encode.group_text(made).alias("features"))


@query(WIDE_FIELDS + "SELECT id, pos, value FROM fields WHERE regexp_full_match(value, '[0-9]+')")
def filter_isdigit(spark: SparkSession, sf: str) -> DataFrame:
    return wide_fields(spark, sf).filter(text.is_digits(F.col("value"))).select("id", "pos", "value")


@query(WIDE_FIELDS + """
SELECT id, pos, value FROM fields WHERE regexp_full_match(replace(replace(value, '-', ''), '.', ''), '[0-9]+')""")
def filter_numeric_like(spark: SparkSession, sf: str) -> DataFrame:
    return wide_fields(spark, sf).filter(text.is_numeric_like(F.col("value"))).select("id", "pos", "value")


@query(WIDE_FIELDS + """
SELECT pos, sum(CAST(n AS BIGINT))::BIGINT AS numbers, sum(1 - n)::BIGINT AS categories FROM (
  SELECT pos, CASE WHEN regexp_full_match(replace(replace(value, '-', ''), '.', ''), '[0-9]+') THEN 1 ELSE 0 END AS n
  FROM fields) GROUP BY pos""")
def column_type_profile(spark: SparkSession, sf: str) -> DataFrame:
    numeric = text.is_numeric_like(F.col("value"))
    return wide_fields(spark, sf).groupBy("pos").agg(
        F.count_if(numeric).alias("numbers"), F.count_if(~numeric).alias("categories")
    )


@query("SELECT user_id, item_id, prediction, order_key FROM {predictions} WHERE prediction BETWEEN 0 AND 5")
def filter_pred_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "predictions").select("user_id", "item_id", "prediction", "order_key")
    return joins.in_range(rows, "prediction", 0, 5)


@query("""
SELECT user_id % 8 AS bucket, count(*) AS ratings, count(DISTINCT user_id) AS users FROM {ratings} GROUP BY 1""")
def modulo_bucket(spark: SparkSession, sf: str) -> DataFrame:
    # Ratings per user first: the few buckets then only add up users.
    per_user = view(spark, sf, "ratings").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return per_user.groupBy(joins.bucket_of("user_id", 8).alias("bucket")).agg(
        F.sum("n").alias("ratings"), F.count(F.lit(1)).alias("users")
    )


@query("""
SELECT order_key, CAST(line_no AS BIGINT) AS line_no, item_id, sq_error FROM (
  SELECT *, round(pow(nullif(prediction, 0) - rating, 2), 6) AS sq_error FROM {predictions}
) WHERE sq_error > 0""")
def filter_nan_errors(spark: SparkSession, sf: str) -> DataFrame:
    # A score of 0 stands for a pair that the model does not know; such a pair scores NaN.
    score = F.when(F.col("prediction") == 0, F.lit(float("nan"))).otherwise(F.col("prediction"))
    squared = encode.squared_error(F.col("rating"), score)
    error = F.when(F.isnan(squared), squared).otherwise(F.round(squared, 6))
    rows = view(spark, sf, "predictions").withColumn("sq_error", error)
    return joins.valid_errors(rows, "sq_error").select("order_key", *big("line_no"), "item_id", "sq_error")


@query("""
WITH n AS (SELECT count(DISTINCT p_partkey) AS items FROM {part})
SELECT user_id, items, count(DISTINCT item_id) AS rated, items - count(DISTINCT item_id) AS unrated
FROM {ratings} CROSS JOIN n GROUP BY user_id, items""")
def pair_space(spark: SparkSession, sf: str) -> DataFrame:
    items = view(spark, sf, "part").select(F.col("p_partkey").alias("item_id"))
    return recommend.pair_space(view(spark, sf, "ratings"), items)


@query("""
SELECT DISTINCT r.user_id, r.item_id + 1 AS item_id FROM {ratings} r JOIN {part} ON p_partkey = r.item_id + 1
WHERE NOT EXISTS (SELECT 1 FROM {ratings} k WHERE k.user_id = r.user_id AND k.item_id = r.item_id + 1)""")
def unseen_pairs(spark: SparkSession, sf: str) -> DataFrame:
    # Candidates: the item next in the catalogue to each rated one.
    pair = ["user_id", "item_id"]
    ratings = pin(view(spark, sf, "ratings").select(*pair), "ratings")
    tasks = tasks_for(spark, ratings.count())
    # The next items of distinct pairs are distinct too.
    rated = pin(ratings.repartition(tasks, *pair).distinct(), "rated")
    following = rated.select("user_id", (F.col("item_id") + 1).alias("item_id"))
    catalogue = view(spark, sf, "part").select(F.col("p_partkey").alias("item_id"))
    return joins.drop_known(joins.join_lookup(following, catalogue, "item_id"), rated, pair, tasks)


@query("""
SELECT l.rn, l.o_orderkey, r.o_totalprice FROM
  (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM {orders}) l JOIN
  (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) r ON l.rn = r.rn""")
def zip_by_position(spark: SparkSession, sf: str) -> DataFrame:
    orders = view(spark, sf, "orders")
    right = orders.select("o_totalprice", F.col("o_orderkey").alias("key"))
    return joins.attach_by_position(
        orders.select("o_orderkey"), right, ["o_orderkey"], [F.desc("o_totalprice"), "key"]
    ).select("rn", "o_orderkey", "o_totalprice")


@query("SELECT s.id, s.score, l.quality FROM {scored} s JOIN {labels} l ON s.id = l.doc_id")
def join_label_pred(spark: SparkSession, sf: str) -> DataFrame:
    labels = view(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    return joins.attach_by_key(view(spark, sf, "scored").select("id", "score"), labels, "id")


HASHED = "(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':0'), 1, 8))::BIGINT)"
FOUR_FIFTHS = round(2**32 * 0.8)


@query(f"""
WITH b AS (SELECT *, {HASHED.replace('{key}', 'order_key')} AS bucket FROM {{ratings}}),
train AS (SELECT * FROM b WHERE bucket < {FOUR_FIFTHS})
SELECT user_id, item_id, rating, order_key, CAST(line_no AS BIGINT) AS line_no FROM b
WHERE bucket >= {FOUR_FIFTHS} AND user_id IN (SELECT user_id FROM train) AND item_id IN (SELECT item_id FROM train)""")
def semi_known_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "ratings").select("user_id", "item_id", "rating", "order_key", *big("line_no"))
    train, test = splits.random_split(rows, "order_key", 0.8)
    return joins.known_only(test, train, ["user_id", "item_id"]).select(rows.columns)


@query("""
SELECT user_id, item_id, rating, rated_at, order_key, CAST(line_no AS BIGINT) AS line_no, supp_key FROM {ratings}""")
def ratings_from_orders(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "ratings").select(
        "user_id", "item_id", "rating", "rated_at", "order_key", *big("line_no"), "supp_key"
    )


@query("""
SELECT count(*) AS ratings, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items FROM {ratings}""")
def profile_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.counts(view(spark, sf, "ratings"))


@query("""
SELECT count(*) AS ratings, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items,
  TRUE AS users_within, TRUE AS items_within, TRUE AS merged_equal FROM {ratings}""")
def sketched_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of four parts of the ratings, stored and merged, against exact counts and the sketch of the whole."""
    rows, columns = view(spark, sf, "ratings"), ["user_id", "item_id"]
    path = scratch_path(spark, "sketches")
    for part in range(4):
        writers.append_sketches(evaluate.distinct_sketches(rows.where(F.col("order_key") % 4 == part), columns), path, f"part {part}")
    merged = evaluate.sketched_counts(evaluate.merged_sketches(spark.read.parquet(path), columns), columns)
    whole = evaluate.sketched_counts(evaluate.distinct_sketches(rows, columns), columns)
    exact, near = evaluate.counts(rows), evaluate.SKETCH_ERROR
    found = merged.select("rows", *[F.col(c).alias(f"m_{c}") for c in columns]).join(whole, "rows")
    # One row each; the number of ratings must agree exactly.
    joined = exact.join(found, exact["ratings"] == found["rows"])
    within = lambda c, n: F.abs(F.col(f"m_{c}") - F.col(n)) <= near * F.col(n)
    # Merging may estimate with a little less precision than counting in one go.
    equal = F.greatest(*[F.abs(F.col(f"m_{c}") - F.col(c)) / F.col(c) for c in columns]) <= near
    return joined.select("ratings", "users", "items", within("user_id", "users").alias("users_within"),
                         within("item_id", "items").alias("items_within"), equal.alias("merged_equal"))


@query("SELECT DISTINCT user_id FROM {ratings}")
def distinct_users(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "ratings").select("user_id").distinct()


@query("""
SELECT CAST(median(age) AS DOUBLE) AS age, CAST(median(fare) AS DOUBLE) AS fare, CAST(median(sibsp) AS DOUBLE) AS sibsp
FROM {passengers}""")
def median_per_column(spark: SparkSession, sf: str) -> DataFrame:
    return impute.exact_median(view(spark, sf, "passengers"), ["age", "fare", "sibsp"])


@query("""
SELECT CAST(median(l_extendedprice) AS DOUBLE) AS l_extendedprice, CAST(median(l_quantity) AS DOUBLE) AS l_quantity
FROM {lineitem}""")
def median_of_lines(spark: SparkSession, sf: str) -> DataFrame:
    return impute.exact_median(view(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"])


@query("""
SELECT (SELECT embarked FROM {passengers} WHERE embarked IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS embarked,
       (SELECT sex FROM {passengers} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS sex""")
def mode_per_column(spark: SparkSession, sf: str) -> DataFrame:
    return impute.exact_mode(view(spark, sf, "passengers"), ["embarked", "sex"])


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in ["id", "label", *NUMBERS, *TEXTS]) + " FROM {clicks}")
def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "clicks")
    return impute.null_profile(rows, rows.columns)


@query("""
SELECT user_id, item_id, rating FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, item_id
                               ORDER BY rated_at DESC, order_key DESC, line_no DESC, supp_key DESC, rating DESC) AS rn
  FROM {ratings}) WHERE rn = 1""")
def latest_rating(spark: SparkSession, sf: str) -> DataFrame:
    return joins.latest(view(spark, sf, "ratings"), ["user_id", "item_id"],
                        ["rated_at", "order_key", "line_no", "supp_key", "rating"], ["rating"])


@query("""
SELECT round(sqrt(avg(mse)), 6) AS rmse, count(*) AS buckets FROM (
  SELECT user_id % 8 AS bucket, avg(pow(prediction - rating, 2)) AS mse FROM {predictions} GROUP BY 1)""")
def bucketed_rmse(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.bucketed_rmse(
        view(spark, sf, "predictions"), "user_id", "rating", "prediction", 8
    ).withColumn("rmse", F.round("rmse", 6))


@query("""
SELECT c14, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c14) - 1 AS idx
FROM {clicks} WHERE c14 IS NOT NULL GROUP BY c14""")
def category_index(spark: SparkSession, sf: str) -> DataFrame:
    return categories.category_freq(view(spark, sf, "clicks"), "c14")


@query(BASELINE_RECS + """
, c AS (SELECT c_custkey AS user_id FROM {customer})
SELECT count(*) AS users, count(r.user_id) AS served, count(r.user_id) * CAST(100 AS DOUBLE) / count(*) AS percent
FROM c LEFT JOIN (SELECT DISTINCT user_id FROM recs) r ON c.user_id = r.user_id""")
def rec_coverage(spark: SparkSession, sf: str) -> DataFrame:
    users = view(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return evaluate.coverage(baseline_recs(spark, sf), users)


@query("""
SELECT 60000000 + row_number() OVER (ORDER BY o_orderkey) - 1 AS id, o_orderkey, o_totalprice FROM {orders}""")
def surrogate_ids(spark: SparkSession, sf: str) -> DataFrame:
    orders = view(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ordered.number_rows(orders, ["o_orderkey"], name="id", start=60_000_000)


RANKED = """
SELECT user_id, item_id, prediction, order_key, CAST(line_no AS BIGINT) AS line_no, supp_key,
       row_number() OVER (PARTITION BY user_id ORDER BY prediction DESC, item_id DESC, order_key, line_no, supp_key) AS rank
FROM {predictions}"""


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "predictions").select(
        "user_id", "item_id", "prediction", "order_key", *big("line_no"), "supp_key"
    )


def _rank_order() -> list:
    return [F.desc("prediction"), F.desc("item_id"), F.asc("order_key"), F.asc("line_no"), F.asc("supp_key")]


@query(RANKED)
def rank_per_user(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.number_rows(_predictions(spark, sf), _rank_order(), ["user_id"], "rank")


@query(f"SELECT * FROM ({RANKED}) WHERE rank <= 10")
def top_k_per_user(spark: SparkSession, sf: str) -> DataFrame:
    return joins.top_k(_predictions(spark, sf), "user_id", _rank_order(), 10)


@query(f"SELECT * FROM ({RANKED}) WHERE rank <= 10")
def top_k_two_phase(spark: SparkSession, sf: str) -> DataFrame:
    return joins.top_k_tiled(_predictions(spark, sf), joins.bucket_of("item_id", 4), "user_id", _rank_order(), 10)


@query("""
SELECT order_key, CAST(line_no AS BIGINT) AS line_no, item_id, supp_key, user_id FROM (
  SELECT *, lag(user_id) OVER (ORDER BY order_key, line_no, item_id, supp_key, rating) AS previous FROM {ratings}
) WHERE previous IS NULL OR previous <> user_id""")
def uniq_adjacent(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "ratings").select(*LINE_KEY, "rating", "user_id")
    kept = ordered.drop_adjacent_repeats(rows, "user_id", [*LINE_KEY, "rating"])
    return kept.select("order_key", *big("line_no"), "item_id", "supp_key", "user_id")


@query("""
SELECT user_id, prediction, order_key, CAST(line_no AS BIGINT) AS line_no, item_id, supp_key,
       row_number() OVER (ORDER BY user_id DESC, prediction DESC, order_key, line_no, item_id, supp_key) AS rn
FROM {predictions}""")
def sort_two_keys(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.desc("user_id"), F.desc("prediction"), *[F.asc(c) for c in LINE_KEY]]
    return ordered.number_rows(_predictions(spark, sf), order)


@query("""
SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def top_n_global(spark: SparkSession, sf: str) -> DataFrame:
    orders = view(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return joins.top_n(orders, 100, [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':7'), o_orderkey) AS rn FROM {orders}""")
def shuffle_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.shuffle_rows(view(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("""
SELECT p_partkey AS item_id FROM {part} EXCEPT
SELECT item_id FROM {ratings} JOIN {customer} ON user_id = c_custkey WHERE c_nationkey = 0""")
def except_ids(spark: SparkSession, sf: str) -> DataFrame:
    # Items that no customer of the first nation has rated.
    catalogue = view(spark, sf, "part").select(F.col("p_partkey").alias("item_id"))
    nation = view(spark, sf, "customer").filter("c_nationkey = 0").select(
        F.col("c_custkey").alias("user_id")
    )
    rated = joins.join_lookup(view(spark, sf, "ratings").select("user_id", "item_id"), nation, "user_id")
    return joins.except_ids(catalogue, rated, "item_id")


@query("""
WITH i AS (SELECT p_partkey AS item_id, row_number() OVER (ORDER BY p_partkey) AS n FROM {part}),
s AS (SELECT user_id, item_id FROM {ratings} UNION SELECT 0, p_partkey FROM {part}),
u AS (SELECT c_custkey AS user_id FROM {customer} UNION SELECT 0),
b AS (SELECT DISTINCT (n - 1) // 32768 + 1 AS block FROM i),
l AS (SELECT u.user_id, (n - 1) // 32768 + 1 AS block, i.item_id FROM u CROSS JOIN i
      WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = u.user_id AND s.item_id = i.item_id))
SELECT u.user_id, b.block, count(l.item_id) AS n_unseen,
  coalesce(string_agg(CAST(l.item_id AS VARCHAR), ' ' ORDER BY l.item_id), '') AS unseen
FROM u CROSS JOIN b LEFT JOIN l ON l.user_id = u.user_id AND l.block = b.block GROUP BY u.user_id, b.block""")
def array_unseen_items(spark: SparkSession, sf: str) -> DataFrame:
    # All customers, those without a rating too, and user 0, who has rated everything.
    catalogue = view(spark, sf, "part").select(F.col("p_partkey").alias("item_id"))
    all_rated = catalogue.select(F.lit(0).cast("bigint").alias("user_id"), "item_id")
    seen = view(spark, sf, "ratings").select("user_id", "item_id").union(all_rated)
    users = view(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).union(spark.range(1).toDF("user_id"))
    return joins.unseen_items(users, catalogue, seen).withColumn("unseen", F.array_join("unseen", " "))


@query(f"""
SELECT o_orderkey, CASE WHEN {HASHED.replace('{key}', 'o_orderkey')} < {FOUR_FIFTHS} THEN 'train' ELSE 'test' END AS split FROM {{orders}}""")
def split_hash_80_20(spark: SparkSession, sf: str) -> DataFrame:
    orders = view(spark, sf, "orders").select("o_orderkey")
    return splits.with_split(orders, "o_orderkey", {"train": 0.8, "test": 0.2})


@query("""
SELECT o_orderkey, CASE WHEN rn <= ceil(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':3'), o_orderkey) AS rn,
         count(*) OVER () AS n FROM {orders})""")
def split_exact_count(spark: SparkSession, sf: str) -> DataFrame:
    return splits.exact_split(view(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.8, 3)


@query(f"""
SELECT o_orderkey, CASE WHEN b < {round(2**32 * 0.1)} THEN 'test' WHEN b < {round(2**32 * 0.19)} THEN 'validation' ELSE 'train' END AS split FROM (
  SELECT o_orderkey, {HASHED.replace('{key}', 'o_orderkey')} AS b FROM {{orders}})""")
def split_three_way(spark: SparkSession, sf: str) -> DataFrame:
    return splits.three_way(view(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("""
SELECT o_orderkey, CASE WHEN rn <= 4000 THEN 'train' ELSE 'test' END AS split FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM {orders}
) WHERE rn <= 4000 OR rn > n - 1000""")
def split_ordered(spark: SparkSession, sf: str) -> DataFrame:
    orders = view(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return splits.ordered_split(orders, ["o_orderdate", "o_orderkey"], 4000, 1000).select(
        "o_orderkey", "split"
    )


@query("""
SELECT o_orderkey, CAST(floor((rn - 1) / ceil(n / CAST(7 AS DOUBLE))) AS BIGINT) AS chunk FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM {orders})""")
def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    return splits.chunk_rows(view(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@query("""
SELECT round(sqrt(avg(pow(p - rating, 2))), 6) AS rmse, count(p) AS scored, count(*) - count(p) AS dropped FROM (
  SELECT rating, nullif(prediction, 0) AS p FROM {predictions})""")
def eval_rmse(spark: SparkSession, sf: str) -> DataFrame:
    # A score of 0 stands for a pair that the model does not know.
    known = F.nullif(F.col("prediction"), F.lit(0.0))
    rows = view(spark, sf, "predictions").withColumn("prediction", known)
    return evaluate.rmse(rows, "rating", "prediction").withColumn("rmse", F.round("rmse", 6))


AUC = """
WITH c AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM {rows} GROUP BY score),
r AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT round(sum(pos * (below + CAST(neg AS DOUBLE) / 2)) / (sum(pos) * CAST(sum(neg) AS DOUBLE)), 9) AS auc FROM r"""


@query(AUC.replace("{rows}", "{scored}"))
def eval_auc(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.auc(view(spark, sf, "scored"), "label", "score").select(F.round("auc", 9).alias("auc"))


@query(AUC.replace("{rows}", """(
  SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_extendedprice AS score FROM {lineitem})"""))
def eval_auc_continuous(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "lineitem").select(
        encode.binary(F.col("l_returnflag"), "R").alias("label"), F.col("l_extendedprice").alias("score")
    )
    return evaluate.auc(rows, "label", "score").select(F.round("auc", 9).alias("auc"))


@query("""
SELECT round((avg(CASE WHEN label = 1 THEN d END) + avg(CASE WHEN label = 0 THEN 1 - d END)) / 2, 9) AS auc FROM (
  SELECT label, CASE WHEN score > CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS d FROM {scored})""")
def eval_auc_hard(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "scored").withColumn("decision", encode.threshold(F.col("score")))
    return evaluate.auc_hard(rows, "label", "decision").select(F.round("auc", 9).alias("auc"))


@query("""
SELECT round(-avg(CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END), 9) AS log_loss FROM (
  SELECT label, greatest(CAST(1e-15 AS DOUBLE), least(1 - CAST(1e-15 AS DOUBLE), score)) AS p FROM {scored})""")
def eval_log_loss(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.log_loss(view(spark, sf, "scored"), "label", "score").select(
        F.round("log_loss", 9).alias("log_loss")
    )


@query("SELECT round(avg(abs(prediction - rating)), 6) AS mae FROM {predictions}")
def eval_custom_metric(spark: SparkSession, sf: str) -> DataFrame:
    metric = F.round(F.avg(F.abs(F.col("prediction") - F.col("rating"))), 6)
    return evaluate.evaluate_with(view(spark, sf, "predictions"), metric, "mae")
