"""Sources and sinks: each query writes the given tables in an input shape and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions import encode, text
from quillrank.operators import joins, ordered, recommend
from quillrank.plans.fixtures import view
from quillrank.plans.passengers import text_example
from quillrank.queries.registry import query
from quillrank.session import pin, scratch_path
from quillrank.sources import readers, writers

RATING_ORDER = ["order_key", "line_no", "item_id", "supp_key", "rating"]


def as_text(df: DataFrame, column: str) -> str:
    path = scratch_path(df.sparkSession, "lines")
    df.select(F.col(column).alias("value")).write.text(path)
    return path


@query("""
SELECT CAST(split_part(line, '::', 1) AS BIGINT) AS user_id, CAST(split_part(line, '::', 2) AS BIGINT) AS item_id,
       CAST(split_part(line, '::', 3) AS DOUBLE) AS rating
FROM {rating_lines}""")
def scan_ratings_delimited(spark: SparkSession, sf: str) -> DataFrame:
    return readers.read_ratings(spark, as_text(view(spark, sf, "rating_lines"), "line"))


@query("""
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM {customer}""")
def scan_csv_typed(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    view(spark, sf, "customer").write.csv(path, header=True)
    read = readers.read_table(spark, path)
    return read.withColumns({c: F.col(c).cast("bigint") for c in ("c_custkey", "c_nationkey")})


@query("SELECT passenger_id, pclass, name, sex, age, sibsp, parch, fare, embarked, survived FROM {passengers}")
def scan_csv_quoted(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    rows = view(spark, sf, "passengers")
    rows.write.csv(path, header=True)
    return readers.read_table(spark, path, schema=rows.schema).select(
        "passenger_id", "pclass", "name", "sex", "age", "sibsp", "parch", "fare", "embarked", "survived"
    )


@query("""
SELECT label, i0, i1, i2, i3, i4, i5, i6, i7, i8, i9, i10, i11, i12, c13, c14, c15 FROM {clicks}""")
def scan_clicks_tsv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "tsv")
    view(spark, sf, "clicks").drop("id").write.csv(path, sep="\t")
    return readers.read_clicks(spark, path)


@query("""
SELECT label, i0, i1, i2, i3, i4, i5, i6, i7, i8, i9, i10, i11, i12, c13,
       CASE WHEN i3 > 0 THEN c14 END AS c14, CASE WHEN i3 > 1 THEN c15 END AS c15 FROM {clicks}""")
def scan_clicks_ragged(spark: SparkSession, sf: str) -> DataFrame:
    # Lines of one, two or three categories.
    path = scratch_path(spark, "tsv")
    rows = view(spark, sf, "clicks").drop("id")
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
    line = F.when(F.col("i3") > 1, F.concat_ws("\t", *fields)).when(F.col("i3") > 0, F.concat_ws("\t", *fields[:-1]))
    rows.select(line.otherwise(F.concat_ws("\t", *fields[:-2])).alias("value")).write.text(path)
    return readers.read_clicks(spark, path)


@query("""
SELECT CAST(CASE WHEN label = 1 THEN 1 ELSE -1 END AS DOUBLE) AS label, score AS prediction FROM {scored}""")
def scan_label_pred(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "scored").withColumn(
        "line", F.concat_ws(" ", encode.signed_label(F.col("label")), F.col("score"))
    )
    return readers.read_pairs(spark, as_text(rows, "line"))


@query("SELECT DISTINCT p_partkey AS item_id FROM {part}")
def item_dimension(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "part").withColumn("line", F.concat_ws("::", "p_partkey", "p_name", "p_type"))
    return readers.read_items(spark, as_text(rows, "line"))


@query("""
SELECT user_id, item_id, rating, order_key, CAST(line_no AS BIGINT) AS line_no
FROM {ratings} ORDER BY order_key, line_no, item_id, supp_key, rating LIMIT 1000""")
def limit_first_n(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.first_rows(view(spark, sf, "ratings"), 1000, RATING_ORDER).select(
        "user_id", "item_id", "rating", "order_key", F.col("line_no").cast("bigint")
    )


#: Number and category columns of the click view.
NUMBERS, TEXTS = [f"i{n}" for n in range(13)], ["c13", "c14", "c15"]

WIDE_FIELDS = """
WITH cut AS (
  SELECT string_split(replace(replace(line, 'false', '0'), 'true', '1'), ',') AS parts FROM {wide_lines}
), cleaned AS (
  SELECT [lower(replace(replace(replace(x, '"', ''), ' ', ''), ':', '')) FOR x IN parts] AS f FROM cut
), fields AS (
  SELECT f[1] AS id, CAST(f[len(f)] AS INT) AS label, CAST(generate_subscripts(f[2:len(f) - 1], 1) - 1 AS BIGINT) AS pos,
         unnest(f[2:len(f) - 1]) AS value
  FROM cleaned
)
"""


def wide_fields(spark: SparkSession, sf: str) -> DataFrame:
    """(id, label, pos, value) of every field of every wide line."""
    parsed = readers.parse_wide(view(spark, sf, "wide_lines"))
    return parsed.select("id", "label", F.posexplode("fields").alias("pos", "value")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


@query(WIDE_FIELDS + "SELECT id, label, pos, value FROM fields")
def parse_wide_row(spark: SparkSession, sf: str) -> DataFrame:
    return wide_fields(spark, sf)


@query("SELECT order_key, CAST(line_no AS BIGINT) AS line_no, unnest(string_split(line, '::')) AS part FROM {rating_lines}")
def explode_parts(spark: SparkSession, sf: str) -> DataFrame:
    lines = view(spark, sf, "rating_lines").withColumn("line_no", F.col("line_no").cast("bigint"))
    return readers.explode_lines(lines, "line", "::", "part")


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {documents}")
def explode_lines(spark: SparkSession, sf: str) -> DataFrame:
    return readers.explode_lines(view(spark, sf, "documents").select("doc_id", "text"), "text")


TEXT_PARTS = """
WITH p AS (
  SELECT passenger_id, CASE WHEN survived = 1 THEN 1 ELSE -1 END AS label, pclass, age, sibsp, parch, embarked, sex,
         lower(split_part(name, ',', 1)) AS last,
         lower(regexp_extract(split_part(name, ',', 2), '[A-Za-z]+')) AS title
  FROM {passengers}
)
"""


@query(TEXT_PARTS + """
SELECT concat_ws(' ', CAST(label AS VARCHAR), concat('''', CAST(passenger_id AS VARCHAR)), '|f',
         concat('passenger_class_', CAST(pclass AS VARCHAR)), concat('last_name_', last), concat('title_', title),
         concat('sex_', sex),
         CASE WHEN age IS NULL THEN NULL WHEN age = floor(age) THEN concat('age:', CAST(CAST(age AS BIGINT) AS VARCHAR))
              ELSE concat('age:', CAST(age AS VARCHAR)) END,
         concat('siblings_onboard:', CAST(sibsp AS VARCHAR)), concat('family_members_onboard:', CAST(parch AS VARCHAR)),
         CASE WHEN embarked IS NOT NULL THEN concat('embarked_', embarked) END) AS line
FROM p""")
def sparse_text_format(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "passengers").select(text_example().alias("line"))


@query(TEXT_PARTS + """, f AS (
  SELECT passenger_id, label, concat('passenger_class_', CAST(pclass AS VARCHAR)) AS name, CAST(1 AS DOUBLE) AS value FROM p
  UNION ALL SELECT passenger_id, label, concat('last_name_', last), 1 FROM p
  UNION ALL SELECT passenger_id, label, concat('title_', title), 1 FROM p
  UNION ALL SELECT passenger_id, label, concat('sex_', sex), 1 FROM p
  UNION ALL SELECT passenger_id, label, 'age', age FROM p WHERE age IS NOT NULL
  UNION ALL SELECT passenger_id, label, 'siblings_onboard', sibsp FROM p
  UNION ALL SELECT passenger_id, label, 'family_members_onboard', parch FROM p
  UNION ALL SELECT passenger_id, label, concat('embarked_', embarked), 1 FROM p WHERE embarked IS NOT NULL
)
SELECT CAST(label AS DOUBLE) AS label, CAST(passenger_id AS VARCHAR) AS tag, 'f' AS ns, name, value FROM f""")
def sparse_text_parse(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "examples")
    writers.write_sparse_text(view(spark, sf, "passengers"), text_example(), path)
    return readers.explode_features(readers.parse_sparse_text(spark.read.text(path)))


@query("""SELECT id AS "Id", (2 * score - 1 + 1) / CAST(2 AS DOUBLE) AS "Predicted" FROM {scored}""")
def submission_rows(spark: SparkSession, sf: str) -> DataFrame:
    signed = view(spark, sf, "scored").withColumn("raw", 2 * F.col("score") - 1)
    path = scratch_path(spark, "submission")
    writers.write_submission(
        writers.submission(signed.withColumn("p", encode.to_unit(F.col("raw"))), "id", "p"), path
    )
    return readers.read_table(spark, path, schema="Id bigint, Predicted double")


BASELINE_RECS = """
WITH rated AS (SELECT DISTINCT user_id, item_id FROM {ratings}),
means AS (SELECT item_id, round(avg(rating), 6) AS score FROM {ratings} GROUP BY item_id),
users AS (SELECT DISTINCT user_id FROM {ratings}),
unseen AS (
  SELECT u.user_id, m.item_id, m.score FROM users u CROSS JOIN means m
  WHERE NOT EXISTS (SELECT 1 FROM rated r WHERE r.user_id = u.user_id AND r.item_id = m.item_id)
), recs AS (
  SELECT user_id, item_id, score, rn AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id DESC) AS rn FROM unseen
  ) WHERE rn <= 10
)
"""


def baseline_recs(spark: SparkSession, sf: str) -> DataFrame:
    ratings = pin(view(spark, sf, "ratings").select("user_id", "item_id", "rating"), "ratings")
    return recommend.unseen_by_rank(ratings, recommend.item_means(ratings), 10)


@query(BASELINE_RECS + "SELECT user_id, item_id, score, rank FROM recs")
def recommend_baseline_topk(spark: SparkSession, sf: str) -> DataFrame:
    return baseline_recs(spark, sf)


@query(BASELINE_RECS + """
SELECT user_id AS user, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rank) AS products FROM recs GROUP BY user_id""")
def recs_as_arrays(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "recs")
    writers.write_recs(baseline_recs(spark, sf), path)
    records = spark.read.json(path, schema="user bigint, products array<bigint>")
    return records.select("user", F.array_join(F.col("products").cast("array<string>"), ",").alias("products"))


@query("""SELECT user_id, item_id, rating, order_key, user_id % 4 AS tile FROM {ratings}""")
def union_tiles(spark: SparkSession, sf: str) -> DataFrame:
    # Written once: each tile would work out the join again, with all lines in the few tasks of its part of the union.
    ratings = pin(view(spark, sf, "ratings").select("user_id", "item_id", "rating", "order_key"), "ratings")
    tile = joins.bucket_of("user_id", 4)
    return joins.union_all(
        [ratings.filter(tile == n).withColumn("tile", F.lit(n).cast("bigint")) for n in range(4)]
    )


@query("""
SELECT order_key, CAST(line_no AS BIGINT) AS line_no, split_part(line, '::', 1) AS user_text, split_part(line, '::', 2) AS item_text
FROM {rating_lines}""")
def scalar_split(spark: SparkSession, sf: str) -> DataFrame:
    line = F.col("line")
    return view(spark, sf, "rating_lines").select(
        "order_key", F.col("line_no").cast("bigint"),
        text.nth(line, "::", 0).alias("user_text"), text.nth(line, "::", 1).alias("item_text"),
    )
