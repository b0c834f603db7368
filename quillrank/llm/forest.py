"""Approximate nearest neighbours: a forest of random-projection trees and one priority queue over all of them."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm import vectors
from quillrank.session import pin

#: Trees; rows that the planes are fitted on, at most; rows of a leaf, about, while the sample allows so many leaves.
TREES, SAMPLE, LEAF = 10, 20_000, 400
#: Leaf candidates of a query, repeats included, as a share of all rows, and at least.
EFFORT, LEAST = 1.5, 4_000


class Forest:
    """Complete binary trees of random planes through the middle of the sample rows that reach them."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth, self.trees = depth, trees
        self.planes = rng.standard_normal((trees, max(1, 2**depth - 1), sample.shape[1]))
        self.planes /= np.linalg.norm(self.planes, axis=2, keepdims=True)
        self.middles = np.zeros(self.planes.shape[:2])
        for tree in range(trees):
            node = np.zeros(len(sample), np.int64)
            for level in range(depth):
                for own in range(2**level - 1, 2 ** (level + 1) - 1):
                    here = sample[node == own] @ self.planes[tree, own]
                    self.middles[tree, own] = np.median(here) if len(here) else 0.0
                node = self._down(tree, node, sample)

    def _down(self, tree: int, node: np.ndarray, rows: np.ndarray) -> np.ndarray:
        side = np.einsum("ij,ij->i", rows, self.planes[tree][node]) > self.middles[tree][node]
        return 2 * node + 1 + side

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, numbered through the forest."""
        out = np.zeros((len(rows), self.trees), np.int64)
        for tree in range(self.trees):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = self._down(tree, node, rows)
            out[:, tree] = tree * 2**self.depth + node - (2**self.depth - 1)
        return out

    def probes(self, row: np.ndarray, counts: np.ndarray, wanted: float) -> list[int]:
        """Leaves to look into, nearest first over all trees, until they hold ``wanted`` rows."""
        margins = self.planes @ row - self.middles
        inner = 2**self.depth - 1
        queue = [(0.0, tree, 0) for tree in range(self.trees)]
        out: list[int] = []
        held = 0
        while queue and held < wanted:
            far, tree, node = heapq.heappop(queue)
            while node < inner:
                margin = margins[tree, node]
                heapq.heappush(queue, (max(far, abs(margin)), tree, 2 * node + 1 + int(margin <= 0)))
                node = 2 * node + 1 + int(margin > 0)
            leaf = tree * (inner + 1) + node - inner
            if counts[leaf]:
                out.append(leaf)
                held += counts[leaf]
        return out


def nearest(df: DataFrame, key: str, vector: str, k: int = 5, query_every: int = 50, effort: float = EFFORT) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest cosine that each query finds among all others.

    Queries are the rows whose key is divisible by ``query_every``. Planes are
    fitted on at most ``SAMPLE`` rows, chosen by a hash of the key; every row is put
    into a leaf of every tree. A query takes the leaves nearest to it over all trees
    until they hold ``effort`` times the number of rows, ``LEAST`` at least; small
    tables are thus searched whole. All candidates are then ranked by the cosine of
    the original vectors in double precision, ties to the smaller vec_id. Vectors
    that are null or zero or hold null or non-finite components take no part; of
    rows with one key that with the largest vector does; missing components of
    shorter vectors are 0. An empty table gives no rows; other columns are not read.

    Leaves are cut into blocks of about ``vectors.BLOCK`` rows, so that many equal
    vectors don't gather in one task.
    """
    spark = df.sparkSession
    rows = vectors.usable(df, key, vector).withColumn("size", vectors.length(F.col("v")))
    rows = pin(rows.where("size > 0"), "forest-rows")
    n, queries, width = rows.agg(F.count("*"), F.sum((F.col("id") % query_every == 0).cast("long")), F.max(F.size("v"))).first()
    schema = "query_id long, vec_id long, score double"
    if not n or not queries:
        return vectors.best(spark.createDataFrame([], schema), k)
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    sample = _unit(vectors.matrix(taken["v"].combine_chunks(), width))
    depth = max(0, min(int(np.ceil(np.log2(max(1, n / LEAF)))), int(np.log2(max(1, len(sample) / 16)))))
    forest = Forest(sample, TREES, depth)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = forest.leaves(_unit(vectors.matrix(batch["v"], width)))
            yield batch.append_column("leaves", pa.array(list(leaves), pa.list_(pa.int64())))

    indexed = rows.mapInArrow(put, "id long, v array<double>, size double, leaves array<long>")
    indexed = pin(indexed.select("id", "v", F.explode("leaves").alias("leaf")), "forest-leaves")
    # One row for each leaf of the forest; their number is bounded by the sample.
    sizes = indexed.groupBy("leaf").agg(F.count("*").alias("rows")).collect()
    counts = np.zeros(TREES * 2**depth, np.int64)
    for leaf, rows_in in sizes:
        counts[leaf] = rows_in
    blocks = spark.createDataFrame([(leaf, -(-c // vectors.BLOCK)) for leaf, c in sizes], "leaf long, blocks int")
    packed = (
        indexed.join(F.broadcast(blocks), "leaf").withColumn("block", vectors.deal(F.col("id"), F.col("blocks")))
        .groupBy("leaf", "block").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    )
    wanted = max(LEAST, effort * n)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [forest.probes(row, counts, wanted) for row in _unit(vectors.matrix(batch["v"], width))]
            yield batch.append_column("leaves", pa.array(found, pa.list_(pa.int64())))

    asked = rows.where(F.col("id") % query_every == 0).select("id", "v")
    asked = asked.mapInArrow(ask, "id long, v array<double>, leaves array<long>")
    asked = asked.withColumn("pack", vectors.deal(F.col("id"), F.lit(max(1, -(-queries // vectors.PACK)))))
    asked = asked.select("id", "v", "pack", F.explode("leaves").alias("leaf")).join(F.broadcast(blocks), "leaf")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.groupBy("leaf", "block", "pack").agg(F.collect_list(F.struct("id", "v")).alias("queries"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = vectors.Found(k)
        for batch in batches:
            for row, question in zip(batch["rows"], batch["queries"]):
                here, asking = vectors.structs(row), vectors.structs(question)
                ids, values = np.asarray(here["id"]), vectors.matrix(here["v"], width)
                own, queries_in = np.asarray(asking["id"]), vectors.matrix(asking["v"], width)
                score = cosines(queries_in, values)
                score[own[:, None] == ids] = -np.inf
                for q, line in zip(own, score):
                    at = vectors.top(ids, line, k)
                    at = at[line[at] > -np.inf]
                    found.add(np.full(len(at), q), ids[at], line[at])
        yield from found.batches()

    found = asked.join(packed.hint("shuffle_hash"), ["leaf", "block"]).select("rows", "queries").mapInArrow(rank, schema)
    return vectors.best(found.dropDuplicates(["query_id", "vec_id"]), k)


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``left`` with each row of ``right``; very large and very small ones are scaled first."""
    left, right = (m / np.abs(m).max(1, keepdims=True) if _far(m) else m for m in (left, right))
    # einsum adds up in one order whatever the shapes, so that equal vectors tie in every block.
    product = np.einsum("ij,kj->ik", left, right)
    size = [np.sqrt(np.einsum("ij,ij->i", m, m)) for m in (left, right)]
    return product / (size[0][:, None] * size[1])


def _far(m: np.ndarray) -> bool:
    top = np.abs(m).max(1)
    return bool(len(top)) and (top.max() > 1e150 or top.min() < 1e-150)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True) if len(rows) else rows
    return rows / np.sqrt((rows**2).sum(1, keepdims=True)) if len(rows) else rows
