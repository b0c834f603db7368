"""Repeatable splits of a table: by hash, by exact count, in order, into equal parts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.operators.ordered import Order, number_rows, seeded_hash, shuffle_rows

# Places of the hash space; shares are cut to one of so many.
_PLACES = 2**32
# Hexadecimal digits of a hash that rows are counted by.
_DIGITS = 4


def hash_place(key: Column, seed: int = 0) -> Column:
    """A place in the hash space from the md5 of key and seed; the same on every run and every layout."""
    return F.conv(F.substring(seeded_hash(key, seed), 1, 8), 16, 10).cast("bigint")


def with_split(df: DataFrame, key: str | Column, weights: dict[str, float], seed: int = 0,
               name: str = "split") -> DataFrame:
    """Name each row's part; the parts get the given shares of the hash space. No shuffle."""
    place = hash_place(F.col(key) if isinstance(key, str) else key, seed)
    total, upto, part = sum(weights.values()), 0.0, None
    for label, weight in weights.items():
        upto += weight
        limit = round(_PLACES * upto / total)
        part = F.when(place < limit, label) if part is None else part.when(place < limit, label)
    return df.withColumn(name, part)


def random_split(df: DataFrame, key: str | Column, share: float = 0.8, seed: int = 0
                 ) -> tuple[DataFrame, DataFrame]:
    """(train, test) by hash of the key."""
    place = hash_place(F.col(key) if isinstance(key, str) else key, seed)
    limit = round(_PLACES * share)
    return df.filter(place < limit), df.filter(place >= limit)


def three_way(df: DataFrame, key: str, test: float = 0.1, validation: float = 0.1, seed: int = 0
              ) -> DataFrame:
    """Name the part of each row: first the test share, then the validation share of the rest."""
    rest = 1 - test
    weights = {"test": test, "validation": rest * validation, "train": rest * (1 - validation)}
    return with_split(df, key, weights, seed)


def exact_split(df: DataFrame, key: str | Column, share: float, seed: int = 0, name: str = "split"
                ) -> DataFrame:
    """Shuffle by hash and name exactly ``ceil(share * rows)`` rows ``train``, the others ``test``.

    Rows are counted by the first digits of their hash; only those with the digits
    at which the share is reached are sorted. ``df`` is read three times: give a scan or a pinned table.
    """
    key = F.col(key) if isinstance(key, str) else key
    # A null key has no hash and comes first, as in a sort.
    digits = F.coalesce(F.substring(seeded_hash(key, seed), 1, _DIGITS), F.lit(""))
    # At most 16 ** _DIGITS rows, and one for null keys.
    counts = sorted(df.groupBy(digits.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
    take = math.ceil(round(share * sum(n for _, n in counts), 6))
    before, border = 0, None
    for border, n in counts:
        if before + n >= take:
            break
        before += n
    clear = df.filter(digits != F.lit(border)).withColumn(name, F.when(digits < F.lit(border), "train").otherwise("test"))
    shuffled = shuffle_rows(df.filter(digits == F.lit(border)), key, seed, name="__n")
    part = F.when(F.col("__n") <= take - before, "train").otherwise("test")
    return clear.unionByName(shuffled.withColumn(name, part).drop("__n"))


def ordered_split(df: DataFrame, order: Order, head: int, tail: int, name: str = "split") -> DataFrame:
    """The first ``head`` rows are ``train`` and the last ``tail`` rows ``test``; the others go."""
    rows = df.count()
    numbered = number_rows(df, order, name="__n")
    part = F.when(F.col("__n") <= head, "train").when(F.col("__n") > rows - tail, "test")
    return numbered.withColumn(name, part).filter(F.col(name).isNotNull()).drop("__n")


def chunk_rows(df: DataFrame, order: Order, chunks: int, name: str = "chunk") -> DataFrame:
    """Deal rows in order to ``chunks`` parts of ``ceil(rows / chunks)`` rows; the last may be short."""
    size = max(math.ceil(df.count() / chunks), 1)
    numbered = number_rows(df, order, name="__n", start=0)
    return numbered.withColumn(name, F.floor(F.col("__n") / size).cast("bigint")).drop("__n")


def part_sizes(df: DataFrame, name: str = "split") -> DataFrame:
    """Rows per part."""
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("rows"))


def parts(df: DataFrame, names: Sequence[str], name: str = "split") -> list[DataFrame]:
    """One frame per named part."""
    return [df.filter(F.col(name) == n).drop(name) for n in names]
