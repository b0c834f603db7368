"""Encodings of labels, scores and features.

A feature is a ``struct<name:string, value:double>``; a group of features is an
array of them, with missing ones left out. Indicators carry the value 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURE = "struct<name:string,value:double>"


def binary(col: Column, value: str, hit: int = 1) -> Column:
    """``hit`` (0 or 1) where the column equals ``value``, the other digit elsewhere."""
    return F.when(col == value, F.lit(hit)).otherwise(F.lit(1 - hit))


def signed_label(col: Column) -> Column:
    """1 for a positive example, -1 otherwise."""
    return F.when(col.cast("double") == 1, F.lit(1)).otherwise(F.lit(-1))


def unsigned_label(col: Column) -> Column:
    """1.0 for a positive example and 0.0 otherwise, as Spark ML learners want it."""
    return F.when(col.cast("double") == 1, F.lit(1.0)).otherwise(F.lit(0.0))


def to_unit(col: Column) -> Column:
    """A score in [-1, 1] as a probability-like value in [0, 1]."""
    return (col + F.lit(1.0)) / F.lit(2.0)


def threshold(col: Column, cut: float = 0.5, inclusive: bool = False) -> Column:
    """1 above the cut (or at it, when ``inclusive``), else 0."""
    hit = col >= cut if inclusive else col > cut
    return F.when(hit, F.lit(1)).otherwise(F.lit(0))


def squared_error(label: Column, prediction: Column) -> Column:
    return F.pow(prediction.cast("double") - label.cast("double"), F.lit(2.0))


def indicator(prefix: str, col: Column) -> Column:
    """Name of an indicator feature: prefix and value; null for a missing value."""
    return F.concat(F.lit(prefix), col.cast("string"))


def token(prefix: str, col: Column) -> Column:
    """An indicator feature ``prefix + value``; null for a missing value."""
    return _feature(indicator(prefix, col), F.lit(1.0))


def amount(name: str, col: Column) -> Column:
    """A weighted feature ``name:value``; null for a missing value."""
    return _feature(F.lit(name), col.cast("double"))


def _feature(name: Column, value: Column) -> Column:
    made = F.struct(name.alias("name"), value.alias("value"))
    return F.when(name.isNotNull() & value.isNotNull(), made)


def group(features: Sequence[Column]) -> Column:
    """A feature group from single features, missing ones left out."""
    return F.array_compact(F.array(*features))


def named_features(values: Column, prefix: str = "feature", start: int = 1) -> Column:
    """An array as a group of weighted features numbered by position; missing entries left out."""
    named = F.transform(
        values,
        lambda x, i: F.when(
            x.isNotNull(),
            F.struct(
                F.concat(F.lit(prefix), (i + F.lit(start)).cast("string")).alias("name"),
                x.cast("double").alias("value"),
            ),
        ),
    )
    return F.array_compact(named)


def feature_map(names: Column, values: Column) -> Column:
    """Names and values as one map."""
    return F.map_from_arrays(names, values)


def interact_self(features: Column) -> Column:
    """Products of every two features of one row's group (first before second)."""
    return F.flatten(
        F.transform(
            features,
            lambda a, i: F.transform(
                F.slice(features, i + F.lit(2), F.size(features)), lambda b: _product(a, b)
            ),
        )
    )


def interact(left: Column, right: Column) -> Column:
    """Products of every feature of one group with every feature of another, within a row."""
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: _product(a, b))))


def interact_rows(df: DataFrame, left: str, right: str, output: str = "p") -> DataFrame:
    """One row for each product of :func:`interact`, named ``output``, with the other columns.

    The groups are unfolded one after the other, so no row's products are an array, which takes several times as long.
    """
    one = df.withColumn("__left", F.explode(left)).withColumn("__right", F.explode(right))
    kept = [c for c in df.columns if c not in (left, right)]
    return one.select(*kept, _product(F.col("__left"), F.col("__right")).alias(output))


def _product(a: Column, b: Column) -> Column:
    return F.struct(
        F.concat(a["name"], F.lit("^"), b["name"]).alias("name"),
        (a["value"] * b["value"]).alias("value"),
    )


def sparse_text(label: Column, tag: Column | None, groups: Sequence[tuple[str, Sequence[Column]]]) -> Column:
    """One text example: ``label 'tag |ns name:value name``.

    The entries of a group are indicator names and :func:`pair_text`; missing ones are left out.
    """
    head = [label.cast("string")]
    if tag is not None:
        head.append(F.concat(F.lit("'"), tag.cast("string")))
    body = [F.concat_ws(" ", F.lit(f"|{name}"), *entries) for name, entries in groups]
    return F.concat_ws(" ", *head, *body)


def pair_text(name: str, col: Column) -> Column:
    """``name:value`` as text; null for a missing value."""
    return F.concat(F.lit(f"{name}:"), number_text(col))


def group_text(features: Column) -> Column:
    """A feature group as text, every feature with its value."""
    written = F.transform(features, lambda f: F.concat(f["name"], F.lit(":"), number_text(f["value"])))
    return F.array_join(written, " ")


def number_text(value: Column) -> Column:
    """A double as short text: no fraction part when it is whole."""
    whole = value == F.floor(value)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
