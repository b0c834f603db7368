"""Scalar functions and feature building."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions import encode, text
from quillrank.operators import categories, features, impute, learn
from quillrank.plans import clicks, passengers, tournament, wide
from quillrank.plans.fixtures import view
from quillrank.queries.registry import query
from quillrank.queries.scans import NUMBERS, TEXTS, WIDE_FIELDS, wide_fields


@query(r"""
SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') AS cleaned FROM {documents}""")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query("""
SELECT id, lower(replace(replace(replace(replace(replace(line, 'false', '0'), 'true', '1'), '"', ''), ' ', ''), ':', '')) AS plain
FROM {wide_lines}""")
def scalar_replace(spark: SparkSession, sf: str) -> DataFrame:
    line = text.plain_value(text.booleans_to_digits(F.col("line")))
    return view(spark, sf, "wide_lines").select("id", line.alias("plain"))


TITLE = "trim(split_part(split_part(name, '.', 1), ',', 2))"


@query(f"SELECT passenger_id, {TITLE} AS title, split_part(name, ',', 1) AS last FROM {{passengers}}")
def title_extract(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("name")
    return view(spark, sf, "passengers").select(
        "passenger_id", text.title(name).alias("title"), text.last_name(name).alias("last")
    )


# The titles of text.FULL_TITLES, in SQL.
FULL_TITLE = f"""CASE WHEN {TITLE} = 'Mme' THEN 'Mlle'
  WHEN {TITLE} IN ('Capt', 'Don', 'Major', 'Dona', 'Lady', 'the Countess', 'Jonkheer') THEN 'Sir' ELSE {TITLE} END"""


@query(f"SELECT passenger_id, {FULL_TITLE} AS title FROM {{passengers}}")
def title_normalize(spark: SparkSession, sf: str) -> DataFrame:
    full = text.normalize_title(text.title(F.col("name")))
    return view(spark, sf, "passengers").select("passenger_id", full.alias("title"))


@query("""
SELECT passenger_id, CASE WHEN sex = 'male' THEN 1 ELSE 0 END AS male, CASE WHEN sex = 'male' THEN 0 ELSE 1 END AS gender
FROM {passengers}""")
def encode_binary(spark: SparkSession, sf: str) -> DataFrame:
    sex = F.col("sex")
    return view(spark, sf, "passengers").select(
        "passenger_id", encode.binary(sex, "male").alias("male"),
        encode.binary(sex, "male", hit=0).alias("gender"),
    )


@query("""
SELECT id, CASE WHEN label = 1 THEN 1 ELSE -1 END AS signed, CAST(label AS DOUBLE) AS unsigned FROM {clicks}""")
def encode_label(spark: SparkSession, sf: str) -> DataFrame:
    label = F.col("label")
    return view(spark, sf, "clicks").select(
        "id", encode.signed_label(label).alias("signed"), encode.unsigned_label(label).alias("unsigned")
    )


@query("SELECT id, concat('c13_', c13) AS c13, 'c14_' || c14 AS c14, concat('c15_', c15) AS c15 FROM {clicks}")
def indicator_names(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "clicks").select(
        "id", *[encode.indicator(f"{c}_", F.col(c)).alias(c) for c in ("c13", "c14", "c15")]
    )


DENSE = """
WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS n, unnest(embedding) AS v FROM {embeddings}),
f AS (SELECT vec_id, n, concat('feature', CAST(n AS VARCHAR)) AS name, CAST(v AS DOUBLE) AS value FROM e)
"""


def dense_rows(spark: SparkSession, sf: str) -> DataFrame:
    group = tournament.feature_group(F.col("embedding"))
    return view(spark, sf, "embeddings").select(
        "vec_id", (F.col("label") >= 5).cast("int").alias("target"), group.alias("f")
    )


@query(DENSE + "SELECT vec_id, name, value FROM f")
def dense_to_named(spark: SparkSession, sf: str) -> DataFrame:
    rows = dense_rows(spark, sf).select("vec_id", F.explode("f").alias("f"))
    return rows.select("vec_id", "f.name", "f.value")


@query(f"""
SELECT id, unnest({NUMBERS}) AS name, CAST(unnest([{', '.join(NUMBERS)}]) AS DOUBLE) AS value FROM {{clicks}}""")
def build_feature_map(spark: SparkSession, sf: str) -> DataFrame:
    built = encode.feature_map(F.array(*map(F.lit, NUMBERS)), F.array(*[F.col(n).cast("double") for n in NUMBERS]))
    return view(spark, sf, "clicks").select("id", F.explode(built).alias("name", "value"))


@query(WIDE_FIELDS + """
SELECT id, pos, TRY_CAST(value AS DOUBLE) AS as_double,
       CASE WHEN regexp_full_match(value, '[0-9]+') THEN CAST(value AS BIGINT) END AS as_long FROM fields""")
def scalar_cast(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("value")
    whole = F.when(text.is_digits(value), value.try_cast("bigint"))
    return wide_fields(spark, sf).select(
        "id", "pos", value.try_cast("double").alias("as_double"), whole.alias("as_long")
    )


@query("SELECT user_id, item_id, order_key, (prediction + 1) / CAST(2 AS DOUBLE) AS unit FROM {predictions}")
def rescale_unit(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "predictions").select(
        "user_id", "item_id", "order_key", encode.to_unit(F.col("prediction")).alias("unit")
    )


@query("""
SELECT id, CASE WHEN score > CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS strict,
       CASE WHEN 2 * score - 1 >= 0 THEN 1 ELSE 0 END AS inclusive FROM {scored}""")
def threshold_score(spark: SparkSession, sf: str) -> DataFrame:
    score = F.col("score")
    return view(spark, sf, "scored").select(
        "id", encode.threshold(score).alias("strict"),
        encode.threshold(2 * score - 1, 0, inclusive=True).alias("inclusive"),
    )


NUMERIC = "regexp_full_match(replace(replace(value, '-', ''), '.', ''), '[0-9]+')"


@query(WIDE_FIELDS + f"""
SELECT id, pos, CASE WHEN {NUMERIC} THEN CAST(value AS DOUBLE) END AS number, CASE WHEN NOT {NUMERIC} THEN value END AS category
FROM fields""")
def coerce_mixed(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("value")
    return wide_fields(spark, sf).select(
        "id", "pos", text.number_or_null(value).alias("number"), text.category_or_null(value).alias("category")
    )


@query("""
WITH m AS (SELECT CAST(median(age) AS DOUBLE) AS age FROM {passengers}),
e AS (SELECT embarked FROM {passengers} WHERE embarked IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT passenger_id, survived, pclass, name, sex, coalesce(p.age, m.age) AS age, sibsp, parch, fare, coalesce(p.embarked, e.embarked) AS embarked
FROM {passengers} p CROSS JOIN m CROSS JOIN e""")
def impute_table(spark: SparkSession, sf: str) -> DataFrame:
    return impute.impute(view(spark, sf, "passengers"))


INDEXED = f"""
WITH t AS (SELECT passenger_id, {FULL_TITLE} AS title FROM {{passengers}}),
lv AS (SELECT title, row_number() OVER (ORDER BY count(*) DESC, title) - 1 AS idx FROM t GROUP BY title)
"""


def _indexed(spark: SparkSession, sf: str) -> DataFrame:
    titled = view(spark, sf, "passengers").select(
        "passenger_id", text.normalize_title(text.title(F.col("name"))).alias("title")
    )
    return categories.index_column(titled, "title", "idx")


@query(INDEXED + "SELECT passenger_id, title, CAST(idx AS DOUBLE) AS idx FROM t JOIN lv USING (title)")
def string_index(spark: SparkSession, sf: str) -> DataFrame:
    return _indexed(spark, sf).select("passenger_id", "title", "idx")


@query(INDEXED + """
, s AS (SELECT max(idx) AS last FROM lv), n AS (SELECT unnest(generate_series(0, last - 1)) AS slot FROM s)
SELECT passenger_id, CAST(slot AS BIGINT) AS slot, CASE WHEN slot = idx THEN CAST(1 AS DOUBLE) ELSE 0 END AS value
FROM t JOIN lv USING (title) CROSS JOIN n""")
def one_hot_vector(spark: SparkSession, sf: str) -> DataFrame:
    coded = categories.one_hot(_indexed(spark, sf), "idx", "vec")
    slots = coded.select("passenger_id", F.posexplode(vector_to_array("vec")).alias("slot", "value"))
    return slots.withColumn("slot", F.col("slot").cast("bigint"))


@query("""
SELECT passenger_id, CASE WHEN embarked = 'C' THEN 1 ELSE 0 END AS "embarked_C",
       CASE WHEN embarked = 'Q' THEN 1 ELSE 0 END AS "embarked_Q", CASE WHEN embarked = 'S' THEN 1 ELSE 0 END AS "embarked_S",
       CASE WHEN sex = 'female' THEN 1 ELSE 0 END AS sex_female, CASE WHEN sex = 'male' THEN 1 ELSE 0 END AS sex_male
FROM {passengers}""")
def dummy_columns(spark: SparkSession, sf: str) -> DataFrame:
    return categories.dummies(
        view(spark, sf, "passengers").select("passenger_id", "embarked", "sex"), ["embarked", "sex"]
    )


@query("""
WITH lv AS (SELECT 0 AS nr, CAST(item_id AS VARCHAR) AS level FROM {ratings} UNION SELECT 1, CAST(supp_key AS VARCHAR) FROM {ratings}),
p AS (SELECT nr, level, row_number() OVER (ORDER BY nr, level) - 1 AS place, count(*) OVER () AS size FROM lv)
SELECT order_key, CAST(line_no AS BIGINT) AS line_no, item_id, supp_key, a.size, concat(a.place, ' ', b.place) AS entries
FROM {ratings} JOIN p a ON a.nr = 0 AND a.level = CAST(item_id AS VARCHAR) JOIN p b ON b.nr = 1 AND b.level = CAST(supp_key AS VARCHAR)""")
def dummy_vector_levels(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "ratings").select("order_key", F.col("line_no").cast("bigint").alias("line_no"), "item_id", "supp_key")
    coded, _ = categories.dummy_vector(rows, ["item_id", "supp_key"])
    stored = F.unwrap_udt("features")
    return coded.select(*rows.columns, stored["size"].cast("bigint").alias("size"), F.array_join(stored["indices"], " ").alias("entries"))


@query("""
SELECT passenger_id, CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS slot,
       unnest([CAST(pclass AS DOUBLE), CAST(sibsp AS DOUBLE), CAST(parch AS DOUBLE), fare]) AS value FROM {passengers}""")
def assemble_vector(spark: SparkSession, sf: str) -> DataFrame:
    vectors = features.assemble(view(spark, sf, "passengers"), ["pclass", "sibsp", "parch", "fare"])
    slots = vectors.select("passenger_id", F.posexplode(vector_to_array("features")).alias("slot", "value"))
    return slots.withColumn("slot", F.col("slot").cast("bigint"))


@query("""
SELECT id, CAST(coalesce(i0, 0) + coalesce(i1, 0) + coalesce(i2, 0) + i3 + i4 + i5 + i6 + i7 + i8 + i9 + i10 + i11 + i12
                + 2 + CASE WHEN c14 IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS total FROM {clicks}""")
def hash_features(spark: SparkSession, sf: str) -> DataFrame:
    # The slot of a name is the hash's own; what a row puts into all slots together is not.
    hashed = clicks.hashed(view(spark, sf, "clicks"), bits=8)
    total = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return hashed.select("id", total.alias("total"))


@query("""
SELECT passenger_id, round(CAST(coalesce(age, 0) AS DOUBLE) + sibsp + fare + 1, 6) AS total FROM {passengers}""")
def hash_weighted_group(spark: SparkSession, sf: str) -> DataFrame:
    group = encode.group([
        encode.amount("age", F.col("age")), encode.amount("siblings", F.col("sibsp")),
        encode.amount("fare", F.col("fare")), encode.token("sex_", F.col("sex")),
    ])
    hashed = features.hash_group(view(spark, sf, "passengers").withColumn("f", group), "f", bits=8)
    total = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return hashed.select("passenger_id", F.round(total, 6).alias("total"))


@query(DENSE + """
SELECT a.vec_id, concat(a.name, '^', b.name) AS name, a.value * b.value AS value
FROM f a JOIN f b ON a.vec_id = b.vec_id AND a.n < b.n""")
def quadratic_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = dense_rows(spark, sf).select("vec_id", F.explode(encode.interact_self(F.col("f"))).alias("p"))
    return pairs.select("vec_id", "p.name", "p.value")


@query(f"""
WITH i AS (SELECT c13, c14, c15, unnest({NUMBERS}) AS a, unnest([{', '.join(NUMBERS)}]) AS v FROM {{clicks}}),
p AS (SELECT a, v, unnest([concat('c13_', c13), CASE WHEN c14 IS NOT NULL THEN concat('c14_', c14) END, concat('c15_', c15)]) AS b FROM i)
SELECT concat(a, '^', b) AS name, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM p WHERE v IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def cross_pairs(spark: SparkSession, sf: str) -> DataFrame:
    left = encode.group([encode.amount(c, F.col(c)) for c in NUMBERS])
    right = encode.group([encode.token(f"{c}_", F.col(c)) for c in TEXTS])
    pairs = encode.interact_rows(view(spark, sf, "clicks").select(left.alias("left"), right.alias("right")), "left", "right")
    return pairs.groupBy(F.col("p.name").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p.value").alias("total")
    )


_I = ", ".join(f"CASE WHEN i{n} IS NOT NULL THEN concat('i{n}:', CAST(i{n} AS VARCHAR)) END" for n in range(13))


CLICK_FEATURES = f"""
SELECT id, concat_ws(' ', {_I}) AS i,
       concat_ws(' ', concat('c13_', c13, ':1'), CASE WHEN c14 IS NOT NULL THEN concat('c14_', c14, ':1') END,
                 concat('c15_', c15, ':1')) AS c
FROM {{clicks}}"""


@query(CLICK_FEATURES)
def click_features(spark: SparkSession, sf: str) -> DataFrame:
    groups = clicks.examples(view(spark, sf, "clicks"), keep=["id"])
    return groups.select("id", encode.group_text(F.col("i")).alias("i"), encode.group_text(F.col("c")).alias("c"))


@query(CLICK_FEATURES)
def click_features_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows by a Python rule over whole click rows."""
    def rule(row):
        return {"i": [(c, v) for c, v in row.items() if c[0] == "i" and c[1:].isdigit()],
                "c": [v and f"{c}_{v}" for c, v in row.items() if c[0] == "c"], "label": row["label"]}

    groups = learn.featurize_rows(view(spark, sf, "clicks"), rule, ["i", "c"], keep=["id"])
    return groups.select("id", encode.group_text(F.col("i")).alias("i"), encode.group_text(F.col("c")).alias("c"))


@query(f"""
SELECT passenger_id, CAST(survived AS DOUBLE) AS label, concat_ws(' ',
  concat('passenger_class_', CAST(pclass AS VARCHAR), ':1'), concat('last_name_', lower(split_part(name, ',', 1)), ':1'),
  concat('title_', {TITLE}, ':1'), concat('gender:', CASE WHEN sex = 'male' THEN '0' ELSE '1' END),
  concat('siblings_onboard:', CAST(sibsp AS VARCHAR)), concat('family_members_onboard:', CAST(parch AS VARCHAR)),
  concat('fare:', CASE WHEN fare = floor(fare) THEN CAST(CAST(fare AS BIGINT) AS VARCHAR) ELSE CAST(fare AS VARCHAR) END),
  CASE WHEN embarked IS NOT NULL THEN concat('embarked_', lower(embarked), ':1') END,
  CASE WHEN age = floor(age) THEN concat('age:', CAST(CAST(age AS BIGINT) AS VARCHAR)) END) AS f
FROM {{passengers}}""")
def passenger_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = passengers.examples(view(spark, sf, "passengers"))
    return rows.select("passenger_id", "label", encode.group_text(F.col("f")).alias("f"))


WIDE_FEATURES = WIDE_FIELDS + f"""
SELECT id, CASE WHEN {NUMERIC} THEN concat('i', CAST(pos AS VARCHAR)) ELSE concat('c_', CAST(pos AS VARCHAR), '_', value) END AS name,
       CASE WHEN {NUMERIC} THEN CAST(value AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS value FROM fields"""


@query(WIDE_FEATURES)
def wide_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = wide.examples(view(spark, sf, "wide_lines"))
    named = rows.select("id", F.explode(F.concat("i", "c")).alias("f"))
    return named.select("id", "f.name", "f.value")


@query(WIDE_FEATURES)
def wide_features_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows by a Python rule over whole lines."""
    def rule(row):
        text = row["line"].lower().replace("true", "1").replace("false", "0").translate({ord(c): None for c in '" :'})
        fields = text.split(",")[1:-1]
        numeric = lambda v: (plain := v.replace("-", "").replace(".", "")).isascii() and plain.isdigit()
        return {"i": [(f"i{n}", v) for n, v in enumerate(fields) if numeric(v)],
                "c": [f"c_{n}_{v}" for n, v in enumerate(fields) if not numeric(v)]}

    lines = view(spark, sf, "wide_lines").withColumn("id", F.col("id").cast("string"))
    rows = learn.featurize_rows(lines, rule, ["i", "c"], labeled=False, keep=["id"])
    return rows.select("id", F.explode(F.concat("i", "c")).alias("f")).select("id", "f.name", "f.value")
