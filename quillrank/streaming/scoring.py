"""Scoring of arriving rows by a fitted model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillrank.session import scratch_path

Prepare = Callable[[DataFrame], DataFrame]


def arriving(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None,
             form: str = "parquet") -> DataFrame:
    """Files that appear under ``path`` (a folder or pattern) as a stream; a batch takes all there are unless told otherwise."""
    reader = spark.readStream.schema(schema).format(form)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def score_stream(model: Model, rows: DataFrame, prepare: Prepare, finish: Prepare) -> DataFrame:
    """The batch steps on a stream: prepare vectors, apply the model, keep the wanted columns.

    All steps work row by row, so nothing is held between batches.
    """
    return finish(model.transform(prepare(rows)))


def write_scores(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append scored rows to parquet files, each row once, until the present input is used up.

    ``checkpoint`` stays the same over restarts; new files go on from there.
    """
    return (
        scored.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def score_available(scored: DataFrame) -> DataFrame:
    """Score what is there now into the shared folder and read it back."""
    spark = scored.sparkSession
    path = scratch_path(spark, "scores")
    write_scores(scored, path, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.schema(scored.schema).parquet(path)
