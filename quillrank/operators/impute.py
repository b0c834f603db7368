"""Null profile, exact medians and modes, and filling gaps with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.operators.ordered import running_before


def _missing(df: DataFrame, name: str) -> Column:
    col = F.col(name)
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return col.isNull() | F.isnan(col) if floating else col.isNull()


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: the number of missing values of every column, in one pass."""
    return df.agg(*[F.count_if(_missing(df, c)).alias(c) for c in columns or df.columns])


def split_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Columns by type: (numeric, categorical)."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return [c for c in df.columns if c not in text], text


def feature_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """All columns but ``exclude``, in schema order."""
    return [c for c in df.columns if c not in set(exclude)]


def _value_counts(df: DataFrame, columns: Sequence[str], as_type: str) -> DataFrame:
    """(name, value, n) for the given columns, counted before anything is sorted."""
    cast = df.select(*[F.when(~_missing(df, c), F.col(c)).cast(as_type).alias(c) for c in columns])
    if len(columns) == 1:
        long = cast.select(F.lit(columns[0]).alias("name"), F.col(columns[0]).alias("value"))
    else:
        long = cast.unpivot([], list(columns), "name", "value")
    return long.filter(F.col("value").isNotNull()).groupBy("name", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def _one_row(long: DataFrame, columns: Sequence[str]) -> DataFrame:
    return long.agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in columns])


def exact_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the exact median of every column, gaps ignored.

    Equal values are counted first; the counts get their rank from a range sort,
    so no task holds a whole column. Between two middle values the mean is taken.
    """
    counts = _value_counts(df, columns, "double")
    ranked = running_before(counts, ["value"], {"before": F.col("n")}, within=["name"])
    # One row per column name.
    sizes = ranked.groupBy("name").agg(F.sum("n").alias("total"))
    placed = ranked.join(F.broadcast(sizes), "name")

    def holds(position: Column) -> Column:
        return (F.col("before") <= position) & (position < F.col("before") + F.col("n"))

    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = placed.groupBy("name").agg(
        (
            (F.max(F.when(holds(low), F.col("value"))) + F.max(F.when(holds(high), F.col("value")))) / 2
        ).alias("value")
    )
    return _one_row(middle, columns)


def exact_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the most frequent value of every column; of equals the first in sort order."""
    counts = _value_counts(df, columns, "string")
    first = F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value")
    return _one_row(counts.groupBy("name").agg(first), columns)


def impute(df: DataFrame) -> DataFrame:
    """Fill gaps: the median for numbers, the most frequent value for text.

    Only columns that have gaps are looked at. Filled number columns become
    double, since a median may have a fraction.
    """
    gaps = null_profile(df).first().asDict()
    numeric, text = split_columns(df)
    numeric = [c for c in numeric if gaps[c]]
    text = [c for c in text if gaps[c]]
    fill = {}
    if numeric:
        fill.update(exact_median(df, numeric).first().asDict())
    if text:
        fill.update(exact_mode(df, text).first().asDict())
    fill = {c: v for c, v in fill.items() if v is not None}
    casts = {c: F.when(~_missing(df, c), F.col(c)).cast("double") for c in numeric}
    filled = df.withColumns(casts) if casts else df
    return filled.na.fill(fill) if fill else filled
