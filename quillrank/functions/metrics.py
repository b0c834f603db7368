"""Metrics as aggregate columns, so that a score table shrinks to one row on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.functions.encode import squared_error

# Scores are kept this far from 0 and 1 before the logarithm.
LOG_LOSS_CLIP = 1e-15


def mse(label: Column, prediction: Column) -> Column:
    return F.avg(squared_error(label, prediction))


def rmse(label: Column, prediction: Column) -> Column:
    """Root mean squared error over the scored rows (null predictions do not count)."""
    return F.sqrt(mse(label, prediction))


def log_loss(label: Column, prediction: Column, clip: float = LOG_LOSS_CLIP) -> Column:
    p = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), prediction.cast("double")))
    return -F.avg(F.when(label.cast("double") == 1, F.ln(p)).otherwise(F.ln(F.lit(1.0) - p)))


def accuracy(label: Column, decision: Column) -> Column:
    return F.avg(F.when(label.cast("double") == decision.cast("double"), 1.0).otherwise(0.0))


def auc_hard(label: Column, decision: Column) -> Column:
    """Area under the curve of a 0/1 decision: the mean of the two class recalls."""
    positive = label.cast("double") == 1
    hit = F.when(positive, decision.cast("double"))
    miss = F.when(~positive, F.lit(1.0) - decision.cast("double"))
    return (F.avg(hit) + F.avg(miss)) / F.lit(2.0)


def micros_per_row(seconds: Column, rows: Column) -> Column:
    """Throughput: microseconds per row."""
    return seconds * F.lit(1_000_000.0) / rows.cast("double")
