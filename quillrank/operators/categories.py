"""Category frequencies, indices, one-hot vectors and dummy columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.operators.features import pin_vectors, sparse
from quillrank.operators.joins import fits_broadcast, join_lookup, union_all
from quillrank.operators.ordered import number_rows
from quillrank.session import pin

# More levels than this do not become columns of their own.
MAX_DUMMIES = 1_000

# Up to this many levels are sorted in one task.
FEW_LEVELS = 100_000


def category_freq(df: DataFrame, column: str, few: int = FEW_LEVELS) -> DataFrame:
    """(column, n, idx): levels numbered from 0 by falling count, then by value.

    Up to ``few`` levels are numbered in one task; more are numbered in sorted runs.
    """
    counts = pin(
        df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")), "levels"
    )
    order = [F.desc("n"), F.asc(column)]
    if fits_broadcast(counts, few):
        number = F.row_number().over(Window.orderBy(*order)).cast("bigint") - 1
        return counts.withColumn("idx", number)
    return number_rows(counts, order, name="idx", start=0)


def index_column(df: DataFrame, column: str, output: str, missing: str = "keep") -> DataFrame:
    """Add the level index of ``column`` as a double.

    Levels stay in a table and are joined, so their number is not bound by the
    driver. A missing value gets the index after the last level (``keep``) or null.
    """
    levels = category_freq(df, column)
    lookup = levels.select(column, F.col("idx").cast("double").alias(output))
    indexed = join_lookup(df, lookup, column, "left")
    if missing == "keep":
        indexed = indexed.withColumn(output, F.coalesce(F.col(output), F.lit(float(levels.count()))))
    return indexed


def one_hot(df: DataFrame, index: str, output: str) -> DataFrame:
    """Index to indicator vector; the last level is the zero vector."""
    return OneHotEncoder(inputCols=[index], outputCols=[output]).fit(df).transform(df)


def levels(df: DataFrame, column: str, most: int = MAX_DUMMIES) -> list:
    """Sorted distinct values, refused above ``most``: use an index or hashing there."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} levels; index or hash it instead")
    return sorted(row[0] for row in rows)


def dummies(df: DataFrame, columns: Sequence[str], most: int = MAX_DUMMIES) -> DataFrame:
    """Replace each column by one 0/1 column per level, all levels kept."""
    made = []
    for column in columns:
        for level in levels(df, column, most):
            hit = F.coalesce((F.col(column) == level).cast("int"), F.lit(0))
            made.append(hit.alias(f"{column}_{level}"))
    return df.select(*[c for c in df.columns if c not in set(columns)], *made)


def dummy_vector(df: DataFrame, columns: Sequence[str], output: str = "features", known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All levels of all columns as one sparse 0/1 vector, whatever their number; and the table of levels.

    The levels, (column, level, place), are numbered column by column in sorted order, as
    text; each column is looked up in them, so neither the driver nor a plan holds a level.
    A missing value and a level that ``known`` levels of another table lack give no entry.
    The vectors are a pinned table.
    """
    if known is None:
        # Text and the column's place, so that levels of all columns are numbered in one run.
        named = [df.select(F.lit(n).alias("nr"), F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for n, c in enumerate(columns)]
        distinct = union_all(named).where(F.col("level").isNotNull()).distinct()
        known = pin(number_rows(distinct, ["nr", "level"], name="place", start=0).select("column", "level", F.col("place").cast("int")), "levels")
    size = known.count()
    rows = df
    for n, column in enumerate(columns):
        own = known.where(F.col("column") == column).select(F.col("level").alias(f"__key{n}"), F.col("place").alias(f"__place{n}"))
        rows = join_lookup(rows.withColumn(f"__key{n}", F.col(column).cast("string")), own, f"__key{n}", "left").drop(f"__key{n}")
    entry = [F.when(F.col(f"__place{n}").isNotNull(), F.struct(F.col(f"__place{n}").alias("place"), F.lit(1.0).alias("value"))) for n in range(len(columns))]
    pairs = F.array_sort(F.array_compact(F.array(*entry)))
    rows = rows.withColumn(output, sparse(pairs, size)).drop(*[f"__place{n}" for n in range(len(columns))])
    return pin_vectors(rows, [output]), known
