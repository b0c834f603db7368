"""Tournament: 21 dense features, quadratic logistic model, a probability per row."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions import encode, metrics
from quillrank.operators import features, learn, splits
from quillrank.session import pin
from quillrank.sources import readers, writers

FEATURES = 21


def names() -> list[str]:
    return [f"feature{n}" for n in range(1, FEATURES + 1)]


_COLUMNS = ", ".join(f"{n} double" for n in names())
TRAIN_SCHEMA = f"{_COLUMNS}, target int"
TEST_SCHEMA = f"t_id string, {_COLUMNS}"


def feature_group(values: Column) -> Column:
    """The dense features by name; missing ones are left out."""
    return encode.named_features(values, "feature")


def expanded(rows: DataFrame) -> DataFrame:
    """Add ``features``: the dense features and all products of two of them."""
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names()]
    dense = rows.withColumn("dense", array_to_vector(F.array(*filled)))
    return features.dense_quadratic(dense, "dense", "features").drop("dense")


def fit(train: DataFrame, passes: int = 500, l1: float = 1e-4, l2: float = 1e-5) -> Model:
    """Quadratic logistic model on ``feature1..feature21`` and ``target``."""
    vectors = expanded(train).select(encode.unsigned_label(F.col("target")).alias("label"), "features")
    return learn.fit_logistic(pin(vectors, "tournament"), l1, l2, passes)


def score(model: Model, rows: DataFrame) -> DataFrame:
    """Rows with the probability ``score``."""
    return learn.probability(model.transform(expanded(rows))).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def playground(train: DataFrame, key: str | Column, passes: int = 500) -> float:
    """Log loss on a held-out fifth of the training rows."""
    fitting, held = splits.random_split(train, key, 0.8)
    scored = score(fit(fitting, passes), held)
    return scored.agg(metrics.log_loss(F.col("target"), F.col("score"))).first()[0]


def submit(spark: SparkSession, train_path: str, test_path: str, out_path: str, passes: int = 500) -> DataFrame:
    """Train on one file, score another, write ``"t_id","probability"``."""
    model = fit(readers.read_table(spark, train_path, schema=TRAIN_SCHEMA), passes)
    test = readers.read_table(spark, test_path, schema=TEST_SCHEMA)
    rows = writers.submission(score(model, test), "t_id", "score", ("t_id", "probability"))
    writers.write_submission(rows, out_path, quoted_header=True)
    return rows
