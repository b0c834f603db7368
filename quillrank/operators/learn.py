"""Learners by their usual parameters, search on a held-out part, training and scoring.

``logistic_regression`` and ``als`` describe a model. A list for a parameter asks
for a search: two numbers are the ends of a range, a longer list are the choices.
``run`` trains on one table and scores another, or its own held-out part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import (
    FMClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import FMRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillrank.functions.encode import FEATURE, interact, interact_self, unsigned_label
from quillrank.operators.features import hash_group
from quillrank.operators.recommend import fit_ratings
from quillrank.operators.splits import random_split
from quillrank.session import pin, shared_dir

# Values of a searched range that are tried side by side (real numbers evenly in the logarithm, ends included), and
# how often the range is narrowed to the neighbours of the best value so far.
RANGE_STEPS = 5
NARROWINGS = 3

# Up to this many whole numbers of a range are all tried.
ALL_TRIED = 8


@dataclass(frozen=True)
class ModelSpec:
    """What to fit: the kind of learner, its parameters, and the parameters to search."""

    kind: str
    params: dict[str, Any]
    name: str = "model"
    searched: dict[str, list] = field(default_factory=dict)
    ranges: frozenset[str] = frozenset()

    def using(self, **params: Any) -> ModelSpec:
        return replace(self, params={**self.params, **params}, searched={}, ranges=frozenset())


def logistic_regression(name: str = "model", **params: Any) -> ModelSpec:
    """Binary model over feature groups.

    ``passes`` iterations; ``l1``, ``l2`` penalties; ``bits`` hashed slots;
    ``quadratic`` two group letters (equal letters: within the group); ``nn``
    units of one hidden layer; ``termination`` stop tolerance.
    """
    defaults = {"passes": 10, "l1": 0.0, "l2": 0.0, "bits": 18, "quadratic": None, "nn": None,
                "termination": 1e-6}
    return _spec("logistic", name, defaults, params)


def als(name: str = "model", **params: Any) -> ModelSpec:
    """Rating model: ``rank`` factors, ``passes`` iterations, ``l2`` penalty."""
    return _spec("ratings", name, {"passes": 10, "rank": 10, "l2": 0.1}, params)


# Accepted for existing calls; Spark decides these itself (step schedule, workers, solver, input form).
_WITHOUT_EFFECT = {
    "bfgs", "cores", "holdout_off", "learning_rate", "decay_learning_rate", "power_t", "debug", "header",
}


def _spec(kind: str, name: str, defaults: dict, params: dict) -> ModelSpec:
    if kind == "ratings":
        # Interactions between user and item are the model itself; there is no hidden layer in it.
        params = {k: v for k, v in params.items() if k not in {"quadratic", "nn", "bits"}}
    unknown = set(params) - set(defaults) - _WITHOUT_EFFECT
    if unknown:
        raise TypeError(f"unknown parameters: {sorted(unknown)}")
    values = {**defaults, **{k: v for k, v in params.items() if k in defaults}}
    if values.get("nn") and (values["l1"] or values["l2"]):
        raise TypeError("a hidden layer takes no penalty: leave out l1 and l2")
    searched = {k: choices(v) for k, v in values.items() if isinstance(v, (list, tuple))}
    start = {k: searched[k][0] for k in searched}
    ranges = frozenset(k for k in searched if _is_range(values[k]))
    return ModelSpec(kind, {**values, **start}, name, searched, ranges)


def _is_range(values: Sequence) -> bool:
    return len(values) == 2 and all(isinstance(v, (int, float)) for v in values)


def choices(values: Sequence) -> list:
    """The values to try for a searched parameter, for a range those that are tried first."""
    return _between(*sorted(values)) if _is_range(values) else list(values)


def _between(low: float, high: float) -> list:
    if isinstance(low, int) and isinstance(high, int):
        if high - low < ALL_TRIED:
            return list(range(low, high + 1))
        return sorted({round(v) for v in np.linspace(low, high, RANGE_STEPS)})
    spaced = np.geomspace(low, high, RANGE_STEPS) if low > 0 else np.linspace(low, high, RANGE_STEPS)
    return [float(low), *(float(v) for v in spaced[1:-1]), float(high)]


def narrowed(tried: Sequence, best: float) -> list:
    """Values between the tried neighbours of the best one that have not been tried."""
    ordered = sorted(tried)
    at = ordered.index(best)
    low, high = ordered[max(at - 1, 0)], ordered[min(at + 1, len(ordered) - 1)]
    return [v for v in _between(low, high) if v not in tried]


# Rows that a task of a fit of low-rank interactions reads, about.
FM_ROWS = 500_000

# Numbers of a dense block of a hidden-layer fit.
MLP_BLOCK = 1 << 20


# -- single learners ---------------------------------------------------------------------------


def fit_logistic(
    df: DataFrame, l1: float = 0.0, l2: float = 0.0, iterations: int = 10, tol: float = 1e-6,
    features: str = "features", label: str = "label", depth: int = 2,
) -> Model:
    """Logistic regression by L-BFGS (OWL-QN with ``l1``); gradients are added up in a tree."""
    total = l1 + l2
    return LogisticRegression(
        featuresCol=features, labelCol=label, maxIter=iterations, tol=tol, regParam=total,
        elasticNetParam=l1 / total if total else 0.0, aggregationDepth=depth,
    ).fit(df)


def fit_mlp(df: DataFrame, hidden: int, inputs: int, iterations: int = 50, seed: int = 7,
            features: str = "features", label: str = "label", tol: float = 1e-6) -> Model:
    """One hidden layer of ``hidden`` units over ``inputs`` slots.

    Rows are stacked into dense blocks, so wider inputs make blocks of fewer rows.
    """
    return MultilayerPerceptronClassifier(
        featuresCol=features, labelCol=label, layers=[inputs, hidden, 2], maxIter=iterations, seed=seed, tol=tol,
        blockSize=max(1, min(128, MLP_BLOCK // inputs)),
    ).fit(df)


def fit_fm(df: DataFrame, factors: int = 7, iterations: int = 50, step: float = 0.05, reg: float = 0.0,
           classify: bool = False, seed: int = 7, features: str = "features", label: str = "label") -> Model:
    """Low-rank interactions of all slots with ``factors`` factors.

    The fit keeps its rows as objects, several times as large as in a written table; a task reads at most about ``FM_ROWS`` of them.
    """
    kind = FMClassifier if classify else FMRegressor
    parts = -(-df.count() // FM_ROWS)
    if parts > df.rdd.getNumPartitions():
        df = df.repartition(parts)
    return kind(featuresCol=features, labelCol=label, factorSize=factors, maxIter=iterations,
                stepSize=step, regParam=reg, seed=seed).fit(df)


def fit_gbt(df: DataFrame, depth: int = 2, iterations: int = 20, step: float = 1.0,
            validation: str | None = None, seed: int = 7, features: str = "features",
            label: str = "label") -> Model:
    """Boosted trees; stops early on the rows that column ``validation`` marks."""
    shared_dir(df.sparkSession)
    trees = GBTClassifier(featuresCol=features, labelCol=label, maxDepth=depth, maxIter=iterations,
                          stepSize=step, seed=seed)
    if validation:
        trees = trees.setValidationIndicatorCol(validation)
    return trees.fit(df)


def probability(df: DataFrame, output: str = "score") -> DataFrame:
    """Probability of the positive class as a plain column."""
    return df.withColumn(output, vector_to_array("probability")[1])


# -- specs over examples -----------------------------------------------------------------------


def featurize(df: DataFrame, groups: dict[str, Column], label: Column | None = None,
              keep: Sequence[str] = ()) -> DataFrame:
    """Rows to examples: kept key columns, one column per feature group, and the label if there is one.

    Training and scoring tables go through the same group columns; a scoring
    table just has no label.
    """
    columns = [F.col(c) for c in keep] + [column.alias(name) for name, column in groups.items()]
    if label is not None:
        columns.append(unsigned_label(label).alias("label"))
    return df.select(*columns)


def featurize_rows(df: DataFrame, rule: Callable[[dict[str, Any]], dict[str, Any] | None], groups: Sequence[str], labeled: bool = True,
                   keep: Sequence[str] = ()) -> DataFrame:
    """:func:`featurize` by a Python rule, for what no column expression can say.

    ``rule`` takes a row as a dictionary and returns its groups, each a list of
    names, (name, value) pairs or missing values, and its ``label``; or None to leave the row out.
    It runs over Arrow batches; the same rule serves training and scoring, where
    ``labeled`` is off and a label, if given, is not looked at. A name stands for an indicator of 1.
    """
    kept = df.select(*keep).schema
    schema = T.StructType([*kept, *(T.StructField(g, T._parse_datatype_string(f"array<{FEATURE}>")) for g in groups)])
    if labeled:
        schema = schema.add("label", "double")
    arrow = to_arrow_schema(schema)
    names, inputs = list(keep), df.columns

    def column(lists: list[list], kind: pa.DataType) -> pa.Array:
        """The features of all rows one after the other, cut into rows again by Arrow."""
        ends, name, value = [0], [], []
        for given in lists:
            for f in given:
                n, v = (f, 1.0) if isinstance(f, str) else f or (None, None)
                if n is not None and v is not None:
                    name.append(n)
                    value.append(float(v))
            ends.append(len(name))
        fields = pa.StructArray.from_arrays([pa.array(name, pa.string()), pa.array(value, pa.float64())], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields, type=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen, made = [], []
            # A row is a dictionary only while the rule looks at it.
            for n, values in enumerate(zip(*(c.to_pylist() for c in batch.columns)) if inputs else ((),) * batch.num_rows):
                found = rule(dict(zip(inputs, values)))
                if found is not None:
                    chosen.append(n)
                    made.append(found)
            left = batch if len(made) == batch.num_rows else batch.take(pa.array(chosen, pa.int64()))
            out = [left.column(inputs.index(c)).cast(arrow.field(c).type) for c in names]
            out += [column([m.get(g) or () for m in made], arrow.field(g).type) for g in groups]
            if labeled:
                out.append(pa.array([1.0 if m.get("label") is not None and float(m["label"]) == 1 else 0.0 for m in made], pa.float64()))
            yield pa.RecordBatch.from_arrays(out, schema=arrow)

    return df.mapInArrow(run, schema)


def _groups(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.simpleString() == "array<struct<name:string,value:double>>"]


def vectorize(df: DataFrame, bits: int, quadratic: str | None = None, output: str = "features") -> DataFrame:
    """All feature groups of the examples, with the asked interactions, as one hashed vector."""
    names = _groups(df)
    terms = [F.col(n) for n in names]
    if quadratic:
        left, right = quadratic
        terms.append(interact_self(F.col(left)) if left == right else interact(F.col(left), F.col(right)))
    return hash_group(df, F.concat(*terms), bits, output)


def fit(spec: ModelSpec, train: DataFrame) -> Model:
    """Fit a fully specified model on examples (or on rating triples)."""
    p = spec.params
    if spec.kind == "ratings":
        return fit_ratings(train, p["rank"], p["passes"], p["l2"])
    if p["nn"]:
        return fit_mlp(train, p["nn"], 1 << p["bits"], p["passes"], tol=p["termination"])
    return fit_logistic(train, p["l1"], p["l2"], p["passes"], p["termination"])


def prepare(spec: ModelSpec, examples: DataFrame) -> DataFrame:
    """What ``fit`` and ``predict`` read: a pinned table of vectors for a binary model, triples as they are for ratings."""
    if spec.kind == "ratings":
        return examples
    return vectorize(examples, spec.params["bits"], spec.params["quadratic"])


def predict(model: Model, spec: ModelSpec, prepared: DataFrame) -> DataFrame:
    """Prepared rows with ``prediction``; for a binary model also the probability ``score``."""
    scored = model.transform(prepared)
    if spec.kind == "ratings":
        return scored
    return probability(scored).drop("rawPrediction", "probability", "features")


def search(spec: ModelSpec, examples: DataFrame, key: str | Column, metric: Column,
           larger_is_better: bool, share: float = 0.8, seed: int = 0, parallelism: int = 4) -> ModelSpec:
    """Choose each searched parameter in turn by ``metric`` on a held-out part.

    ``metric`` is an aggregate column over the scored rows. One parameter moves
    at a time, the others stay, so the fits add up instead of multiplying. The
    fits for one parameter share the cluster, ``parallelism`` at a time. Examples
    are made into vectors once for each form of them that a parameter asks for.
    A range is tried at its ends and between, then again and again between the
    neighbours of the best value (``NARROWINGS`` times, or until no whole number is left).
    """
    current = spec.using()
    forms: dict[tuple, tuple[DataFrame, DataFrame]] = {}

    def parts(candidate: ModelSpec) -> tuple[DataFrame, DataFrame]:
        form = tuple(candidate.params.get(p) for p in ("bits", "quadratic"))
        if form not in forms:
            whole = prepare(candidate, examples)
            whole = pin(whole, "examples") if spec.kind == "ratings" else whole
            forms[form] = random_split(whole, key, share, seed)
        return forms[form]

    for name, values in spec.searched.items():

        def trial(value, name=name, base=current):
            candidate = base.using(**{name: value})
            train, held = parts(candidate)
            scored = predict(fit(candidate, train), candidate, held)
            return scored.agg(metric).first()[0], value

        results, best = [], None
        for _ in range(1 + NARROWINGS if name in spec.ranges else 1):
            for value in values:
                parts(current.using(**{name: value}))
            with ThreadPoolExecutor(parallelism) as pool:
                results += pool.map(inheritable_thread_target(examples.sparkSession)(trial), values)
            best = (max if larger_is_better else min)((r for r in results if r[0] is not None and not np.isnan(r[0])), key=lambda r: r[0])
            values = narrowed([r[1] for r in results], best[1]) if name in spec.ranges else []
            if not values:
                break
        current = current.using(**{name: best[1]})
    return current


@dataclass
class RunResult:
    """Scored rows, the fitted model and the parameters it was fitted with."""

    scored: DataFrame
    model: Model
    spec: ModelSpec


def run(spec: ModelSpec, train: DataFrame, predict_on: DataFrame | None = None, key: str | Column = "id",
        metric: Column | None = None, larger_is_better: bool = True, share: float = 0.8, seed: int = 0
        ) -> RunResult:
    """Fit on ``train`` and score ``predict_on``; without it, hold out ``1 - share`` of ``train``.

    A search needs ``metric``; it sees the training part only, split once more.
    """
    target = predict_on
    if target is None:
        train, target = random_split(pin(train, "examples"), key, share, seed)
    if spec.searched:
        if metric is None:
            raise ValueError("a searched parameter needs a metric")
        spec = search(spec, train, key, metric, larger_is_better, share, seed + 1)
    prepared, target = prepare(spec, train), prepare(spec, target)
    prepared = pin(prepared, "examples") if spec.kind == "ratings" else prepared
    model = fit(spec, prepared)
    return RunResult(predict(model, spec, target), model, spec)


