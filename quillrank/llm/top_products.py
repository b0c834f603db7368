"""Exact largest inner products: buckets by length, pruned by length or by coordinates, then verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm import vectors
from quillrank.session import pin

#: The longest vectors, so many, give each query its first threshold.
SEEDS = 1024
#: Buckets at most; their edges are quantiles of the lengths.
BUCKETS = 256
#: Coordinates of a query that are looked at; below this local threshold they prune nothing worth while.
FOCUS, LOCAL_LEAST = 4, 0.2


class Bucket:
    """Part of a bucket: vectors by falling length, and for each coordinate the unit vectors' order."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        size = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-size, kind="stable")
        self.ids, self.rows, self.size = ids[order], rows[order], size[order]
        self.unit = self.rows / np.where(self.size > 0, self.size, 1)[:, None]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_length(self, size: float, least: float) -> int:
        """How many of the longest can reach the product ``least`` with a query of length ``size``."""
        if least <= 0 or not size:
            return len(self.ids) if least <= 0 else 0
        return int(np.searchsorted(-self.size, -(least / size) * (1 - 1e-9), side="right"))

    def by_coordinates(self, query: np.ndarray, size: float, local: float) -> tuple[np.ndarray, int]:
        """Places whose focus coordinates can reach cosine ``local``, and how many the narrowest coordinate left."""
        unit = query / size
        reach = np.arccos(min(1.0, local)) + 1e-7
        spans = []
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            if f not in self.sorted:
                order = np.argsort(self.unit[:, f], kind="stable")
                self.sorted[f] = order, self.unit[order, f]
            angle = np.arccos(np.clip(unit[f], -1, 1))
            low, high = np.cos(min(np.pi, angle + reach)) - 1e-9, np.cos(max(0.0, angle - reach)) + 1e-9
            order, values = self.sorted[f]
            first, last = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            spans.append((last - first, f, first, last, low, high))
        spans.sort(key=lambda s: s[0])
        count, f, first, last, _, _ = spans[0]
        at = self.sorted[f][0][first:last]
        for _, f, _, _, low, high in spans[1:]:
            at = at[(self.unit[at, f] >= low) & (self.unit[at, f] <= high)]
        return at, count

    def search(self, own: int, query: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and products of the k best rows with a product of ``least`` or more."""
        size = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        reach = self.by_length(size, least)
        longest = float(self.size[0]) if len(self.size) else 0.0
        local = least / (size * longest) if size * longest > 0 else 0.0
        if local > 1 + 1e-9:
            return self.ids[:0], np.zeros(0, np.int64)
        at: np.ndarray | slice = slice(0, reach)
        if local >= LOCAL_LEAST and reach:
            narrow, scanned = self.by_coordinates(query, size, local)
            # A range costs its narrowest list and what is left of it; the longest vectors are one dense run.
            if scanned + 4 * len(narrow) < reach:
                at = narrow
        ids, score = self.ids[at], self.rows[at] @ query
        keep = (ids != own) & (score >= least)
        ids, score = ids[keep], score[keep]
        chosen = vectors.top(ids, score, k)
        return ids[chosen], score[chosen]


def top_products(df: DataFrame, key: str, vector: str, k: int = 5, query_every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with all other rows.

    Components x become floor(scale * x). Queries are the rows whose key is
    divisible by ``query_every``. Exact, ties to the smaller vec_id; all rows, if
    fewer than k others. Vectors that are null or hold null or non-finite
    components take no part; of rows with one key that with the largest vector
    does; missing components of shorter vectors are 0. An empty table gives no
    rows; other columns are not read. Products are 64-bit integers, so components
    must stay below 2^31 / sqrt(size) after scaling.

    A query meets only buckets whose longest vector can reach its threshold, the
    k-th best product with the ``SEEDS`` longest vectors. Buckets are cut into
    blocks of about ``vectors.BLOCK`` rows, so equal lengths don't gather in a task.
    """
    spark = df.sparkSession
    rows = vectors.usable(df, key, vector)
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long")))
    rows = rows.withColumn("size", vectors.length(F.col("v").cast("array<double>")))
    rows = pin(rows, "product-rows")
    n, queries, width = rows.agg(F.count("*"), F.sum((F.col("id") % query_every == 0).cast("long")), F.max(F.size("v"))).first()
    schema = "query_id long, vec_id long, score long"
    if not n or not queries:
        return vectors.best(spark.createDataFrame([], schema), k)

    wanted = max(1, min(BUCKETS, n // vectors.BLOCK))
    edges = rows.agg(F.percentile_approx("size", [i / wanted for i in range(1, wanted)] or [0.5], 10_000)).first()[0]
    edges = sorted(set(edges)) if wanted > 1 else []
    bucket = F.size(F.filter(F.lit(edges).cast("array<double>"), lambda e: e < F.col("size"))) if edges else F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    # One row for each of at most BUCKETS buckets.
    known = rows.groupBy("bucket").agg(F.max("size").alias("longest"), vectors.blocks_of(F.count("*")).alias("blocks"))
    known = spark.createDataFrame(kept := known.collect(), known.schema)
    rows = rows.join(F.broadcast(known), "bucket")
    packed = (
        rows.withColumn("block", vectors.deal(F.col("id"), F.col("blocks")))
        .groupBy("bucket", "block").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    )

    seeds = rows.select("id", "v").orderBy(F.col("size").desc(), "id").limit(SEEDS).toArrow()
    seed = Bucket(np.asarray(seeds["id"]), vectors.matrix(seeds["v"].combine_chunks(), width, np.int64))

    def first_threshold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = np.asarray(batch["id"]), vectors.matrix(batch["v"], width, np.int64)
            least = []
            for own, row in zip(ids, values):
                score = (seed.rows @ row)[seed.ids != own]
                least.append(int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else None)
            yield batch.append_column("least", pa.array(least, pa.int64()))

    asked = rows.where(F.col("id") % query_every == 0).select("id", "v", "size")
    asked = asked.mapInArrow(first_threshold, "id long, v array<long>, size double, least long")
    asked = asked.withColumn("pack", vectors.deal(F.col("id"), F.lit(max(1, -(-queries // vectors.PACK)))))
    listed = F.array(*(F.struct(*(F.lit(b[c]).alias(c) for c in known.columns)) for b in kept))
    can = lambda b: F.coalesce(F.col("least") <= 0, F.lit(True)) | (F.col("size") * b["longest"] * (1 + 1e-9) >= F.col("least"))
    met = asked.withColumn("b", F.explode(F.filter(listed, can)))
    met = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("b.blocks") - 1)))
    met = met.select("id", "v", "least", "pack", "b.bucket", "block")
    met = met.groupBy("bucket", "block", "pack").agg(F.collect_list(F.struct("id", "v", "least")).alias("queries"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ask in zip(batch["rows"], batch["queries"]):
                fields, questions = vectors.structs(row), vectors.structs(ask)
                part = Bucket(np.asarray(fields["id"]), vectors.matrix(fields["v"], width, np.int64))
                out: list[tuple[np.ndarray, ...]] = []
                values = vectors.matrix(questions["v"], width, np.int64)
                for own, value, least in zip(np.asarray(questions["id"]), values, questions["least"].to_pylist()):
                    ids, score = part.search(own, value, -(2**62) if least is None else least, k)
                    out.append((np.full(len(ids), own), ids, score))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    found = met.join(packed.hint("shuffle_hash"), ["bucket", "block"]).select("rows", "queries").mapInArrow(search, schema)
    return vectors.best(found, k)
