"""Ratings: fit on a part, measure the error on the rest; or recommend to every user."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions import metrics
from quillrank.operators import evaluate, joins, learn, ordered, recommend, splits
from quillrank.operators.learn import ModelSpec
from quillrank.operators.recommend import fit_ratings
from quillrank.session import pin
from quillrank.sources import readers, writers

PAIR = ["user_id", "item_id"]


@dataclass
class Evaluation:
    """Error over the scored rows, and the rows whose user or item the model did not know."""

    rmse: float
    scored: int
    dropped: int


def split_ratings(ratings: DataFrame, order: Sequence, mode: str = "random", share: float = 0.9,
                  seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test): exact shares of the shuffled rows (``random``) or of the rows in order (``in_order``)."""
    if mode == "random":
        key = F.concat_ws("-", *[F.col(c) for c in order])
        named = pin(splits.exact_split(ratings, key, share, seed), "ratings")
    else:
        rows = ratings.count()
        head = int(rows * share)
        named = pin(splits.ordered_split(ratings, order, head, rows - head), "ratings")
    train, test = splits.parts(named, ["train", "test"])
    return train, test


def evaluate_model(train: DataFrame, test: DataFrame, rank: int = 10, iterations: int = 10,
                   reg: float = 0.1, seed: int = 7) -> Evaluation:
    """Fit on ``train``, measure on ``test``."""
    model = fit_ratings(train, rank, iterations, reg, seed)
    scored = recommend.predict_pairs(model, test, unknown="nan")
    return Evaluation(*evaluate.rmse(scored, "rating", "prediction").first())


def evaluate_modes(ratings: DataFrame, order: Sequence, **model) -> DataFrame:
    """The error with a random 90/10 split and with the split in row order, one row each."""
    # Written once: both splits read it several times.
    ratings = pin(ratings, "ratings")
    rows = []
    for mode in ("random", "in_order"):
        result = evaluate_model(*split_ratings(ratings, order, mode), **model)
        rows.append((mode, result.rmse, result.scored, result.dropped))
    return ratings.sparkSession.createDataFrame(rows, "mode string, rmse double, scored bigint, dropped bigint")


def rate(spark: SparkSession, ratings_path: str, results_path: str, spec: ModelSpec | None = None,
         num_ratings: int | None = None, title: str = "ratings") -> Evaluation:
    """``::`` ratings file: optional first rows, 80/20 split, fit (or search), error, run record."""
    start = time.time()
    rows = readers.with_file_order(readers.read_ratings(spark, ratings_path))
    if num_ratings:
        rows = ordered.first_rows(rows, num_ratings, readers.FILE_ORDER)
    ratings = pin(rows.select(*PAIR, "rating"), "ratings")
    result = learn.run(spec or learn.als(rank=10, passes=10), ratings, key=_pair_key(), larger_is_better=False,
                       metric=metrics.rmse(F.col("rating"), F.col("prediction")))
    held = splits.random_split(ratings, _pair_key(), 0.8)[1].count()
    error, scored = result.scored.agg(
        metrics.rmse(F.col("rating"), F.col("prediction")), F.count(F.lit(1))).first()
    record = writers.run_record(spark, title, "rmse", error, time.time() - start, ratings.count())
    writers.append_metrics(record, results_path)
    return Evaluation(error, scored, held - scored)


def _pair_key():
    return F.concat_ws("-", *PAIR)


def recommend_all(spark: SparkSession, ratings_path: str, recs_path: str, k: int = 10, rank: int = 25,
                  iterations: int = 40, reg: float = 0.05, num_ratings: int | None = None,
                  mode: str | None = None, score_range: tuple[float, float] | None = (0.0, 5.0), evaluate_only: bool = False,
                  ) -> Evaluation | None:
    """Headed CSV ratings: fit on all, best unseen items of every user to JSON records.

    A repeated pair keeps its last rating in file order. With ``mode`` (``random``
    or ``in_order``) the error on a tenth is measured too, with ``evaluate_only`` that alone and
    no model of all ratings is fitted.
    """
    if evaluate_only and mode is None:
        raise ValueError("choose a mode to evaluate with")
    rows = readers.with_file_order(readers.read_ratings(spark, ratings_path, sep=",", header=True))
    if num_ratings:
        rows = ordered.first_rows(rows, num_ratings, readers.FILE_ORDER)
    rows = pin(rows, "ratings")
    if not evaluate_only:
        ratings = pin(joins.latest(rows, PAIR, readers.FILE_ORDER, ["rating"]), "ratings")
        model = fit_ratings(ratings, rank, iterations, reg)
        writers.write_recs(recommend.recommend(model, ratings, k, score_range=score_range), recs_path)
    if mode is None:
        return None
    return evaluate_model(*split_ratings(rows, readers.FILE_ORDER, mode), rank=rank, iterations=iterations,
                          reg=reg)


def profile(ratings: DataFrame) -> DataFrame:
    """Ratings, users and items in one row."""
    return evaluate.counts(ratings)
