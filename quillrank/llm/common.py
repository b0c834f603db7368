"""Reading tables, working through Arrow batches in small pieces, and joining groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.session import pin

#: Characters of text that a task works on at a time, so that its memory follows this and the longest text only.
PIECE_CHARS = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table, cut down to the named columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def pieces(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[list[list]]:
    """The batches' columns as lists, over runs of rows whose texts have about ``PIECE_CHARS`` characters.

    ``text`` is the place of the text column; a null text becomes an empty one.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        start, size = 0, 0
        for row in range(batch.num_rows):
            size += len(column[row].as_buffer() or b"") if column[row].is_valid else 0
            if size >= PIECE_CHARS or row + 1 == batch.num_rows:
                part = batch.slice(start, row + 1 - start)
                lists = [c.to_pylist() for c in part.columns]
                lists[text] = [x or "" for x in lists[text]]
                yield lists
                start, size = row + 1, 0


def by_piece(df: DataFrame, work: Callable[..., dict[str, list]], schema: str, text: int = 1) -> DataFrame:
    """Map ``df`` in Arrow batches: ``work`` takes the columns as lists and returns the new columns."""
    names = df.sparkSession.createDataFrame([], schema).schema.names
    types = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in pieces(batches, text):
            out = work(*lists)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], types.field(n).type) for n in names], schema=types)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def record_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch of a schema like ``a long, b binary``."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(columns, types)], names=names)


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """(id, component) of every id that ``edges`` (a, b) mention; component is the smallest id of the group.

    Large-star and small-star rounds: each step hooks a node's neighbours to the
    smallest one of them, so that chains halve and every round's edges number at
    most those of the round before. A round is a table in the shared folder.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = pin(edges.select("a", "b").where("a <> b").distinct(), label)
    before = None
    while True:
        # Large star: neighbours above a node go to the smallest of its neighbourhood.
        around = both(now)
        low = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = around.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a")
        hooked = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = pin(hooked.where("a <> b").distinct(), label)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    members = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return members.union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
