"""Published models: a folder of versions that streams look at between batches."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.ml import Model, PipelineModel
from pyspark.ml.util import JavaMLReadable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillrank.sources.writers import load_model, save_model
from quillrank.streaming.scoring import Prepare

POINTERS = "version bigint, path string, at timestamp"


class Published:
    """A folder with one saved model a version and a small table of pointers to them.

    A version counts once its pointer is written, which is the last step of a publish,
    so a model that is still being written is never read. The folder is reached through
    Spark only. Of two publishes at once that took one number, the later pointer counts.
    """

    def __init__(self, spark: SparkSession, folder: str, kind: type[JavaMLReadable] | type[PipelineModel]):
        self.spark, self.folder, self.kind = spark, folder, kind
        self._loaded: tuple[str, Model] | None = None

    def pointers(self) -> DataFrame:
        """(version, path, at) of every publish; none before the first."""
        empty = self.spark.createDataFrame([], POINTERS)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/pointers")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return empty
        return self.spark.read.schema(POINTERS).parquet(f"{self.folder}/pointers")

    def newest(self) -> tuple[int, str] | None:
        """Number and path of the version that counts."""
        row = self.pointers().orderBy(F.desc("version"), F.desc("at"), F.desc("path")).first()
        return (row.version, row.path) if row else None

    def publish(self, model: Model) -> int:
        """Save ``model`` as the next version and point to it."""
        now = self.newest()
        version = now[0] + 1 if now else 1
        path = f"{self.folder}/models/{version}-{uuid.uuid4().hex}"
        save_model(model, path)
        self.spark.createDataFrame([(version, path, datetime.now())], POINTERS).coalesce(1).write.mode("append").parquet(f"{self.folder}/pointers")
        return version

    def current(self) -> tuple[int, Model]:
        """The version that counts, read only when it is another than last time."""
        now = self.newest()
        if now is None:
            raise ValueError(f"no model has been published in {self.folder}")
        if self._loaded is None or self._loaded[0] != now[1]:
            self._loaded = now[1], load_model(self.kind, now[1])
        return now[0], self._loaded[1]


def score_with_published(models: Published, rows: DataFrame, prepare: Prepare, finish: Prepare, path: str, checkpoint: str) -> StreamingQuery:
    """Score a stream's present input batch by batch, each with the version that counts when it begins.

    ``finish`` gives the wanted columns; ``version`` is added. A batch is written to
    a folder of its own, and a batch that is run again after a failure takes the place of what it
    had written, so no row comes twice and none mixes two versions.
    """

    def run(batch: DataFrame, number: int) -> None:
        version, model = models.current()
        scored = finish(model.transform(prepare(batch))).withColumn("version", F.lit(version).cast("bigint"))
        scored.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
