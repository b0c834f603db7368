"""Evaluation of a table of labels and scores; every result is a one-row DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions import metrics
from quillrank.functions.encode import squared_error
from quillrank.operators.joins import bucket_of
from quillrank.operators.ordered import running_before


def rmse(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Error, the scored rows it is over, and the rows without a score."""
    scored = F.col(prediction).isNotNull() & ~F.isnan(F.col(prediction).cast("double"))
    valid = F.when(scored, F.col(prediction))
    return df.agg(
        metrics.rmse(F.col(label), valid).alias("rmse"),
        F.count_if(scored).alias("scored"),
        F.count_if(~scored).alias("dropped"),
    )


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve (ties count half).

    Null when only one class is present. Rows shrink to one per distinct score before the sort, and the running count
    of negatives comes from sorted runs, so continuous scores do not meet in one task.
    """
    positive = F.col(label).cast("double") == 1
    counts = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    ranked = running_before(counts, ["score"], {"neg_before": F.col("neg")})
    below = F.col("neg_before").cast("double") + F.col("neg") / F.lit(2.0)
    wins = F.sum(F.col("pos").cast("double") * below)
    pairs = F.sum(F.col("pos").cast("double")) * F.sum(F.col("neg").cast("double"))
    return ranked.agg(F.try_divide(wins, pairs).alias("auc"))


def auc_hard(df: DataFrame, label: str, decision: str) -> DataFrame:
    return df.agg(metrics.auc_hard(F.col(label), F.col(decision)).alias("auc"))


def log_loss(df: DataFrame, label: str, probability: str) -> DataFrame:
    return df.agg(metrics.log_loss(F.col(label), F.col(probability)).alias("log_loss"))


def bucketed_rmse(df: DataFrame, user: str, label: str, prediction: str, buckets: int) -> DataFrame:
    """Mean squared error per worker bucket, then the root of the plain mean over buckets."""
    per_bucket = df.groupBy(bucket_of(user, buckets).alias("bucket")).agg(
        F.avg(squared_error(F.col(label), F.col(prediction))).alias("mse")
    )
    return per_bucket.agg(F.sqrt(F.avg("mse")).alias("rmse"), F.count(F.lit(1)).alias("buckets"))


def evaluate_with(df: DataFrame, metric: Column, name: str = "value") -> DataFrame:
    """Any metric given as an aggregate column."""
    return df.agg(metric.alias(name))


def coverage(recs: DataFrame, users: DataFrame, user: str = "user_id") -> DataFrame:
    """Users, users with a recommendation, and the share of them in percent."""
    served = recs.select(user).distinct().withColumn("served", F.lit(1))
    joined = users.select(user).distinct().join(served, user, "left")
    return joined.agg(
        F.count(F.lit(1)).alias("users"),
        F.count("served").alias("served"),
        F.try_divide(F.count("served") * F.lit(100.0), F.count(F.lit(1))).alias("percent"),
    )


def counts(df: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Rows, users and items of a ratings table."""
    return df.agg(
        F.count(F.lit(1)).alias("ratings"),
        F.countDistinct(user).alias("users"),
        F.countDistinct(item).alias("items"),
    )


#: Base-2 logarithm of a sketch's registers, and the relative error that a count exceeds in about one of 300 cases.
SKETCH_BITS = 14
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


def distinct_sketches(df: DataFrame, columns: Sequence[str], bits: int = SKETCH_BITS) -> DataFrame:
    """One row: ``rows`` and a mergeable sketch of the distinct values of each column, null values left out.

    A sketch takes about 2^bits bytes whatever the rows. Columns are text, binary or whole numbers.
    """
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.hll_sketch_agg(c, F.lit(bits)).alias(c) for c in columns])


def merged_sketches(sketches: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The sketches of several tables or runs as those of all of them, without a look at their rows."""
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), *[F.hll_union_agg(c).alias(c) for c in columns])


def sketched_counts(sketches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sketches to approximate distinct counts, within ``SKETCH_ERROR`` of the exact ones."""
    return sketches.withColumns({c: F.hll_sketch_estimate(c) for c in columns})
