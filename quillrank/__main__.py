"""Jobs from files to files: ``python -m quillrank JOB ...`` or through spark-submit."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from quillrank.operators import evaluate, learn
from quillrank.plans import clicks, passengers, ratings, tournament, wide
from quillrank.session import build_session, drop_scratch
from quillrank.sources import readers, writers


def _ratings(spark: SparkSession, a: argparse.Namespace) -> None:
    spec = learn.als(passes=[5, 10], rank=[5, 10]) if a.search else learn.als(rank=10, passes=10)
    print(ratings.rate(spark, a.input, a.results, spec, a.num_ratings, a.title))


def _recommend(spark: SparkSession, a: argparse.Namespace) -> None:
    print(ratings.recommend_all(spark, a.input, a.output, a.k, a.rank, a.passes, num_ratings=a.num_ratings,
                                mode=a.evaluate, evaluate_only=a.evaluate_only))


def _clicks(spark: SparkSession, a: argparse.Namespace) -> None:
    clicks.submit(spark, a.train, a.test, a.output, a.bits)


def _tournament(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.playground:
        train = readers.with_file_order(readers.read_table(spark, a.train, schema=tournament.TRAIN_SCHEMA))
        print("log loss", tournament.playground(train, readers.file_key()))
    else:
        tournament.submit(spark, a.train, a.test, a.output)


def _wide(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.playground:
        scored = wide.playground(wide.read_lines(spark, a.train)).scored
        print("auc", evaluate.auc(scored, "label", "score").first()[0])
    else:
        wide.submit(spark, a.train, a.test, a.output)


def _passengers(spark: SparkSession, a: argparse.Namespace) -> None:
    start = time.time()
    rows = readers.read_table(spark, a.train, schema=passengers.SCHEMA)
    if a.test:
        test = readers.read_table(spark, a.test, schema=passengers.SCHEMA_UNLABELED)
        writers.write_submission(passengers.survivors(rows, test), a.output)
        return
    if a.model in ("interactions", "search"):
        scored = passengers.fit_interactions(rows, passengers.online_spec(a.model == "search")).scored
        auc = evaluate.auc(scored, "label", "score").first()[0]
    else:
        fits = {"indexed": passengers.fit_indexed, "dummies": passengers.fit_dummies, "trees": passengers.fit_trees}
        auc = fits[a.model](rows).auc
    print("auc", auc)
    record = writers.run_record(spark, f"passengers {a.model}", "auc", auc, time.time() - start, rows.count())
    writers.append_metrics(record, a.results)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillrank")
    top.add_argument("--master", help="left to spark-submit when not given")
    top.add_argument("--partitions", help="shuffle partitions")
    jobs = top.add_subparsers(required=True)

    def job(name, function, *options):
        sub = jobs.add_parser(name)
        for flag, settings in options:
            sub.add_argument(flag, **settings)
        sub.set_defaults(function=function)

    needed, count = {"required": True}, {"type": int}
    results = ("--results", {"default": "results"})
    files = [("--train", needed), ("--test", {}), ("--output", {"default": "submission"}),
             ("--playground", {"action": "store_true"})]
    job("ratings", _ratings, ("--input", needed), results, ("--num_ratings", count),
        ("--search", {"action": "store_true"}), ("--title", {"default": "ratings"}))
    job("recommend", _recommend, ("--input", needed), ("--output", needed), ("--num_ratings", count),
        ("--k", {**count, "default": 10}), ("--rank", {**count, "default": 25}),
        ("--passes", {**count, "default": 40}), ("--evaluate", {"choices": ["random", "in_order"]}),
        ("--evaluate_only", {"action": "store_true"}))
    job("clicks", _clicks, ("--train", needed), ("--test", needed), ("--output", needed),
        ("--bits", {**count, "default": 23}))
    job("tournament", _tournament, *files)
    job("wide", _wide, *files)
    job("passengers", _passengers, *files[:3], results,
        ("--model", {"choices": ["indexed", "dummies", "trees", "interactions", "search"], "default": "interactions"}))
    return top


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    conf = {"spark__sql__shuffle__partitions": args.partitions} if args.partitions else {}
    spark = build_session("quillrank", args.master, **conf)
    try:
        args.function(spark, args)
    finally:
        drop_scratch(spark)


if __name__ == "__main__":
    main()
