"""Output files: sparse text, submissions, recommendation records, run records, models."""

from __future__ import annotations

from datetime import datetime

from pyspark.ml import Model, PipelineModel
from pyspark.ml.util import JavaMLReadable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.metrics import micros_per_row
from quillrank.operators.recommend import recs_as_arrays

RUN_SCHEMA = "run string, at timestamp, metric string, value double, secs double, rows bigint"


def write_sparse_text(df: DataFrame, example: Column, path: str) -> None:
    """One text example per row."""
    df.select(example.alias("value")).write.mode("overwrite").text(path)


def submission(df: DataFrame, key: str, score: str, names: tuple[str, str] = ("Id", "Predicted")) -> DataFrame:
    """Key and score under the asked column names."""
    return df.select(F.col(key).alias(names[0]), F.col(score).alias(names[1]))


def write_submission(df: DataFrame, path: str, quoted_header: bool = False) -> None:
    """A two-column CSV with a header, plain or with quoted names.

    The files stay one per task. Every file carries the header, as Spark writes it.
    """
    if not quoted_header:
        df.write.mode("overwrite").csv(path, header=True)
        return
    # Only the header is quoted: its names carry the quotes and values are written as they are.
    named = df.toDF(*[f'"{c}"' for c in df.columns])
    named.write.mode("overwrite").option("quote", "").csv(path, header=True)


def write_recs(recs: DataFrame, path: str) -> None:
    """One JSON record per user: ``{"user": .., "products": [..]}``."""
    recs_as_arrays(recs).select(F.col("user_id").alias("user"), "products").write.mode("overwrite").json(path)


def run_record(spark: SparkSession, run: str, metric: str, value: float, secs: float, rows: int,
               at: datetime | None = None) -> DataFrame:
    """One row on a finished run, with its time per row."""
    row = (run, at or datetime.now(), metric, float(value), float(secs), int(rows))
    record = spark.createDataFrame([row], RUN_SCHEMA)
    return record.withColumn("us_per_row", micros_per_row(F.col("secs"), F.greatest("rows", F.lit(1))))


def append_metrics(record: DataFrame, path: str) -> None:
    """Add run records to the results table."""
    record.write.mode("append").parquet(path)


def append_sketches(sketches: DataFrame, path: str, run: str, at: datetime | None = None) -> None:
    """Add a run's sketches of distinct values to a table beside its run records."""
    stamp = F.lit(at or datetime.now()).cast("timestamp")
    sketches.withColumns({"run": F.lit(run), "at": stamp}).write.mode("append").parquet(path)


def save_model(model: Model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(kind: type[JavaMLReadable] | type[PipelineModel], path: str) -> Model:
    return kind.load(path)
