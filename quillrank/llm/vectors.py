"""Vectors of a table as blocks that tasks can compare with blocks of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block and queries of a pack, about; hashing deals them out.
BLOCK, PACK = 4096, 512


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) with v as array<double>, without rows whose id, vector or any component is null or not finite.

    Rows that share an id count as one: the one with the largest vector.
    """
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", whole))
    return rows.groupBy("id").agg(F.max("v").alias("v"))


def length(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def blocks_of(count: Column, size: int = BLOCK) -> Column:
    """Number of blocks for a group of ``count`` rows."""
    return F.greatest(F.lit(1), F.ceil(count / size)).cast("int")


def deal(key: Column, blocks: Column) -> Column:
    """Block of a row in a group with so many of them."""
    return F.pmod(F.xxhash64(key), blocks.cast("long")).cast("int")


def matrix(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """A list column as matrix; missing components of shorter vectors are 0."""
    sizes = np.asarray(pc.list_value_length(column))
    out = np.zeros((len(column), width), kind)
    if len(column):
        out[np.arange(width) < sizes[:, None]] = np.asarray(column.flatten()).astype(kind)
    return out


def structs(row: pa.ListScalar) -> dict[str, pa.Array]:
    """Fields of a collected list of structs."""
    values = row.values
    return {values.type.field(i).name: values.field(i) for i in range(values.type.num_fields)}


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows (query_id, vec_id, score) of each query, with their rank; ties go to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of the scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


class Found:
    """The best rows of each query that a task has seen so far, cut down whenever they are many."""

    def __init__(self, k: int, most: int = 500_000):
        self.k, self.most, self.held, self.size = k, most, [], 0

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.held.append((query, ids, scores))
        self.size += len(query)
        if self.size > self.most:
            self.held = [self.best()]
            self.size = len(self.held[0][0])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and score of the k best of each query, each id once."""
        query, ids, scores = map(np.concatenate, zip(*self.held))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        fresh = np.r_[True, (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])]
        query, ids, scores = query[fresh], ids[fresh], scores[fresh]
        start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        rank = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
        keep = rank < self.k
        return query[keep], ids[keep], scores[keep]

    def batches(self) -> list[pa.RecordBatch]:
        if not self.size:
            return []
        return [pa.RecordBatch.from_arrays([pa.array(c) for c in self.best()], names=["query_id", "vec_id", "score"])]
