"""Published models: versions, pointers, and streams that change over between batches."""

import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quillrank.operators import features, learn
from quillrank.streaming import published, scoring


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(900).select("id", F.sin("id").alias("a"), (F.sin("id") > 0.2).cast("double").alias("label")).cache()


def models_of(rows):
    vectors = features.assemble(rows, ["a"])
    return [learn.fit_logistic(vectors, l2=l2) for l2 in (0.0, 1.0)]


def finish(df):
    return df.select("id", vector_to_array("probability")[1].alias("score"))


def scores(model, rows):
    return {r.id: r.score for r in finish(model.transform(features.assemble(rows, ["a"]))).collect()}


def test_a_stream_changes_over_to_a_new_version(spark, rows, tmp_path):
    first, second = models_of(rows)
    folder, source, out, progress = (str(tmp_path / n) for n in ("models", "in", "out", "progress"))
    store = published.Published(spark, folder, LogisticRegressionModel)
    assert store.newest() is None
    with pytest.raises(ValueError):
        store.current()
    assert store.publish(first) == 1
    rows.where("id < 600").repartition(4).write.parquet(source)
    seen = []

    def prepare(batch):
        # A new version arrives while the second batch is being made ready.
        seen.append(batch.count())
        if len(seen) == 2:
            assert published.Published(spark, folder, LogisticRegressionModel).publish(second) == 2
        return features.assemble(batch, ["a"])

    def go(prepare=prepare):
        stream = scoring.arriving(spark, source, rows.schema, files_per_trigger=1)
        published.score_with_published(store, stream, prepare, finish, out, progress).awaitTermination()
        return spark.read.parquet(out).collect()

    got = go()
    assert len(got) == len({r.id for r in got}) == 600 and len(seen) == 4
    by_batch = {}
    for r in got:
        by_batch.setdefault(r.batch, set()).add(r.version)
    assert [by_batch[n] for n in range(4)] == [{1}, {1}, {2}, {2}]
    want = {1: scores(first, rows), 2: scores(second, rows)}
    assert all(r.score == pytest.approx(want[r.version][r.id]) for r in got)
    rows.where("id >= 600").coalesce(1).write.mode("append").parquet(source)
    again = go()
    assert len(again) == len({r.id for r in again}) == 900
    assert {r.version for r in again if r.id >= 600} == {2}


def test_a_batch_run_again_takes_its_place(spark, rows, tmp_path):
    """The first try of a batch writes its rows and then fails; the next start runs it again."""
    first, _ = models_of(rows)
    folder, source, out, progress = (str(tmp_path / n) for n in ("models", "in", "out", "progress"))
    store = published.Published(spark, folder, LogisticRegressionModel)
    store.publish(first)
    rows.coalesce(1).write.parquet(source)
    stream = scoring.arriving(spark, source, rows.schema)
    finish(first.transform(features.assemble(rows.limit(50), ["a"]))).withColumn("version", F.lit(1).cast("bigint")).write.parquet(f"{out}/batch=0")
    published.score_with_published(store, stream, lambda b: features.assemble(b, ["a"]), finish, out, progress).awaitTermination()
    assert spark.read.parquet(out).count() == 900
