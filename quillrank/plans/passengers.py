"""Passenger survival: feature rules and the ways of fitting them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions import encode, metrics, text
from quillrank.operators import categories, evaluate, features, impute, joins, learn, splits
from quillrank.operators.learn import ModelSpec, RunResult
from quillrank.session import pin

# The columns of the passenger file in their order.
_TRAVEL = ("pclass int, name string, sex string, age double, sibsp int, parch int, ticket string, "
           "fare double, cabin string, embarked string")
SCHEMA = f"passenger_id int, survived int, {_TRAVEL}"
SCHEMA_UNLABELED = f"passenger_id int, {_TRAVEL}"


# The feature names of the text form, here and in ``feature_group``.


def text_example() -> Column:
    """A passenger as one sparse text example."""
    after_comma = text.clean(text.nth(F.col("name"), ",", 1))
    return encode.sparse_text(
        encode.signed_label(F.col("survived")),
        F.col("passenger_id"),
        [("f", [
            encode.indicator("passenger_class_", F.col("pclass")),
            encode.indicator("last_name_", F.replace(text.clean(text.last_name(F.col("name"))),
                                                     F.lit(" "), F.lit("_"))),
            encode.indicator("title_", text.nth(after_comma, " ", 0)),
            encode.indicator("sex_", text.clean(F.col("sex"))),
            encode.pair_text("age", F.col("age")),
            encode.pair_text("siblings_onboard", F.col("sibsp")),
            encode.pair_text("family_members_onboard", F.col("parch")),
            encode.indicator("embarked_", F.col("embarked")),
        ])],
    )


def feature_group(strict_digits: bool = True, strict_fare: bool = False) -> Column:
    """Class, last name, title, gender, family, fare, port, and the age.

    With ``strict_digits`` an age with a fraction counts as missing, with ``strict_fare`` a fare too.
    """
    age, fare = F.col("age"), F.col("fare")
    if strict_digits:
        age = F.when(age == F.floor(age), age)
    if strict_fare:
        fare = F.when(fare == F.floor(fare), fare)
    return encode.group([
        encode.token("passenger_class_", F.col("pclass")),
        encode.token("last_name_", text.clean(text.last_name(F.col("name")))),
        encode.token("title_", text.title(F.col("name"))),
        encode.amount("gender", encode.binary(F.col("sex"), "male", hit=0)),
        encode.amount("siblings_onboard", F.col("sibsp")),
        encode.amount("family_members_onboard", F.col("parch")),
        encode.amount("fare", fare),
        encode.token("embarked_", text.clean(F.col("embarked"))),
        encode.amount("age", age),
    ])


def examples(passengers: DataFrame, labeled: bool = True, strict_digits: bool = True, strict_fare: bool = False) -> DataFrame:
    """Passengers as examples with one feature group ``f``; whole ages and fares only, as :func:`feature_group` says."""
    label = F.col("survived") if labeled else None
    return learn.featurize(passengers, {"f": feature_group(strict_digits, strict_fare)}, label, keep=["passenger_id"])


def online_spec(search: bool = False) -> ModelSpec:
    """Logistic model with quadratic features; with ``search`` over passes and units of a hidden layer."""
    if search:
        # The published numbers of hidden units. Penalties are no part of a hidden layer here.
        return learn.logistic_regression(
            "passengers", passes=[10, 20, 50], quadratic="ff", nn=[5, 10, 15, 20], bits=10,
        )
    return learn.logistic_regression("passengers", passes=3, quadratic="ff", l1=0.001, bits=14)


def fit_interactions(passengers: DataFrame, spec: ModelSpec | None = None) -> RunResult:
    """Hold out a fifth, fit with quadratic features, score the held-out part."""
    metric = -metrics.log_loss(F.col("label"), F.col("score"))
    return learn.run(spec or online_spec(), examples(passengers), key="passenger_id", metric=metric)


def survivors(train: DataFrame, test: DataFrame, spec: ModelSpec | None = None, cut: float = 0.5, strict_digits: bool = True,
              strict_fare: bool = True) -> DataFrame:
    """Fit on one file and decide 0/1 for another: (PassengerId, Survived). Ages and fares with a fraction count as missing."""
    spec = spec or learn.logistic_regression("passengers", passes=3, quadratic="ff", bits=14)
    known, asked = (examples(t, labeled, strict_digits, strict_fare) for t, labeled in ((train, True), (test, False)))
    result = learn.run(spec, known, asked, key="passenger_id")
    decided = encode.threshold(F.col("score"), cut)
    return result.scored.select(
        F.col("passenger_id").alias("PassengerId"), decided.alias("Survived")
    )


@dataclass
class Scored:
    """Held-out rows with label, decision and score, and their metric row."""

    rows: DataFrame
    auc: float


def _finish(scored: DataFrame, decision: bool) -> Scored:
    rows = learn.probability(scored).select("passenger_id", "label", "prediction", "score")
    metric = (evaluate.auc_hard(rows, "label", "prediction") if decision
              else evaluate.auc(rows, "label", "score"))
    return Scored(rows, metric.first()[0])


def fit_indexed(passengers: DataFrame, iterations: int = 10, reg: float = 0.3) -> Scored:
    """Drop rows with gaps, index and one-hot the text columns, logistic model, hard decisions."""
    used = ["survived", "pclass", "sex", "age", "sibsp", "parch", "fare", "embarked"]
    titled = joins.drop_nulls(passengers, used).withColumn(
        "title", text.normalize_title(text.title(F.col("name")), text.SHORT_TITLES)
    )
    rows = categories.index_column(titled, "sex", "sex_idx")
    for column in ("embarked", "title"):
        rows = categories.index_column(rows, column, f"{column}_idx")
        rows = categories.one_hot(rows, f"{column}_idx", f"{column}_vec")
    vectors = features.assemble(
        rows, ["pclass", "age", "sibsp", "parch", "fare", "sex_idx", "embarked_vec", "title_vec"]
    ).select("passenger_id", F.col("survived").cast("double").alias("label"), "features")
    train, test = splits.random_split(pin(vectors, "examples"), "passenger_id", 0.8)
    return _finish(learn.fit_logistic(train, l2=reg, iterations=iterations).transform(test), True)


def dummied(passengers: DataFrame) -> DataFrame:
    """Impute, title, drop identifying columns, 0/1 columns for every level."""
    leaky = [c for c in ("name", "ticket", "cabin") if c in passengers.columns]
    full = impute.impute(passengers).withColumn(
        "title", text.normalize_title(text.title(F.col("name")))
    ).drop(*leaky)
    coded = full.withColumn("sex", encode.binary(F.col("sex"), "male"))
    return categories.dummies(coded, ["embarked", "title"])


def _vectors(passengers: DataFrame) -> DataFrame:
    table = dummied(passengers)
    columns = impute.feature_columns(table, ["passenger_id", "survived"])
    return pin(features.assemble(table, columns).select(
        "passenger_id", F.col("survived").cast("double").alias("label"), "features"), "examples")


def fit_dummies(passengers: DataFrame, iterations: int = 100, l2: float = 0.001) -> Scored:
    """Imputed and dummied table, logistic model, hard decisions."""
    train, test = splits.random_split(_vectors(passengers), "passenger_id", 0.8)
    return _finish(learn.fit_logistic(train, l2=l2, iterations=iterations).transform(test), True)


def fit_trees(passengers: DataFrame, rounds: int = 20) -> Scored:
    """Imputed and dummied table, boosted trees with early stop on a validation part, scores."""
    named = splits.three_way(_vectors(passengers), "passenger_id")
    test = named.filter(F.col("split") == "test")
    fitting = named.filter(F.col("split") != "test").withColumn("held", F.col("split") == "validation")
    return _finish(learn.fit_gbt(fitting, 2, rounds, 1.0, validation="held").transform(test), False)
