"""Low-rank interactions between two feature groups: products run across the groups, never within one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.operators import recommend as ranking
from quillrank.operators.features import added_up, slot
from quillrank.session import pin

SIDES = ("left", "right")
#: Spread of the first factors, decays and least denominator of the steps.
SPREAD, DECAY, LEAST = 0.1, (0.9, 0.999), 1e-8
#: Rows whose gradients a task works out at a time, gradient rows that it hands on at a time, and rows or features of a packed block.
POOL, OUT, PACK, PACKED_FEATURES = 200_000, 32_768, 50_000, 1_000_000
#: What a packed block holds: its rows, the sum of their labels, and as bytes the labels and each side's features.
BLOCK = "n int, total double, label binary, " + ", ".join(f"{s}_{p} binary" for s in SIDES for p in ("counts", "slots", "values"))


@dataclass
class GroupFactors:
    """Bias; per side a weight and ``rank`` factors of each of 2^bits slots.

    The score of an example is the bias, the weighted features of both sides, and the
    product of the two sides' summed factors. The arrays live on the driver while
    fitting, 2 * 2^bits * (rank + 1) numbers three times over, and go to every worker once a step.
    """

    bits: int
    classify: bool
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    @property
    def rank(self) -> int:
        return self.factors.shape[2]

    def sums(self, side: int, slots: np.ndarray, values: np.ndarray, rows: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Weighted features and summed factors of each row of one side."""
        linear = self.weights[side, slots] * values
        own = self.factors[side, slots] * values[:, None]
        if len(rows) == count and np.array_equal(rows, np.arange(count)):
            return linear, own
        linear = np.bincount(rows, linear, count)
        return linear, np.stack([np.bincount(rows, own[:, k], count) for k in range(self.rank)], 1)

    def scores(self, left: tuple, right: tuple) -> np.ndarray:
        return self.linked(self.bias + left[0] + right[0] + (left[1] * right[1]).sum(1))

    def linked(self, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(total, -500, 500))) if self.classify else total


def hashed(examples: DataFrame, left: str, right: str, bits: int) -> DataFrame:
    """Examples with the two groups as (slots, values) arrays, equal slots of a group added up; a pinned table."""
    return pin(_hashed(examples, left, right, bits), "groups")


def _hashed(examples: DataFrame, left: str, right: str, bits: int) -> DataFrame:
    rows = examples
    for side, group in zip(SIDES, (left, right)):
        pairs = F.transform(F.coalesce(F.col(group), F.array().cast(rows.schema[group].dataType)), lambda t: F.struct(
            slot(t["name"], bits).alias("place"), t["value"].alias("value")))
        rows = added_up(rows.withColumn(f"__{side}", pairs), f"__{side}")
    for side in SIDES:
        rows = rows.withColumns({f"__{side}_slots": F.transform(f"__{side}", lambda p: p["place"]),
                                 f"__{side}_values": F.transform(f"__{side}", lambda p: p["value"])}).drop(f"__{side}")
    return rows


def _side(batch: pa.RecordBatch, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and values of all rows, and the row of each."""
    slots, values = batch[f"__{side}_slots"], batch[f"__{side}_values"]
    rows = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(slots.offsets)))
    return np.asarray(slots.flatten()), np.asarray(values.flatten()), rows


def fit(examples: DataFrame, left: str, right: str, label: str = "label", bits: int = 18, rank: int = 7, iterations: int = 30,
        step: float = 0.1, reg: float = 1e-4, classify: bool = False, seed: int = 7) -> GroupFactors:
    """Fit squared error, or log loss over labels 0 and 1 with ``classify``, by gradients of the whole table.

    Each step is one pass over rows that are written once in packed blocks: tasks add up the gradients of the slots over all their rows,
    Spark adds these up by slot, and adaptive steps move the touched slots. ``reg`` pulls
    them to 0. Rows without a label teach nothing; an empty table gives a model that scores 0.
    """
    spark = examples.sparkSession
    rows = _hashed(examples.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), left, right), left, right, bits)
    rows = pin(rows.select("label", *[f"__{s}_{p}" for s in SIDES for p in ("slots", "values")]).mapInArrow(_packed, BLOCK), "groups")
    count, total = rows.agg(F.sum("n"), F.sum("total")).first()
    mean = total / count if count else None
    size = 1 << bits
    if classify and count:
        mean = float(np.clip(mean, 1e-6, 1 - 1e-6))
        mean = np.log(mean / (1 - mean))
    model = GroupFactors(bits, classify, float(mean or 0.0), np.zeros((2, size)),
                         np.random.default_rng(seed).normal(0, SPREAD, (2, size, rank)))
    if not count:
        return model
    first, second = np.zeros((2, size, rank + 1)), np.zeros((2, size, rank + 1))
    names = [f"g{k}" for k in range(rank + 1)]
    schema = "side int, slot int, " + ", ".join(f"{n} double" for n in names)
    bias_step = np.zeros(2)
    for turn in range(1, iterations + 1):
        shared = spark.sparkContext.broadcast(model)
        parts = rows.mapInArrow(_block_gradients(shared), schema)
        found = parts.groupBy("side", "slot").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
        shared.destroy()
        side, at = np.asarray(found["side"]), np.asarray(found["slot"])
        gradient = np.stack([np.asarray(found[n]) for n in names], 1) / count
        fix = [1 - d**turn for d in DECAY]
        own = side == len(SIDES)
        bias_step = np.array([DECAY[0] * bias_step[0] + (1 - DECAY[0]) * gradient[own, 0].sum(),
                              DECAY[1] * bias_step[1] + (1 - DECAY[1]) * gradient[own, 0].sum() ** 2])
        model.bias -= step * (bias_step[0] / fix[0]) / (np.sqrt(bias_step[1] / fix[1]) + LEAST)
        side, at, gradient = side[~own], at[~own], gradient[~own]
        # The pull is that of one row in ``count``, so that rare slots aren't pulled harder than frequent ones.
        gradient += reg / count * np.c_[model.weights[side, at], model.factors[side, at]]
        first[side, at] = DECAY[0] * first[side, at] + (1 - DECAY[0]) * gradient
        second[side, at] = DECAY[1] * second[side, at] + (1 - DECAY[1]) * gradient**2
        moved = step * (first[side, at] / fix[0]) / (np.sqrt(second[side, at] / fix[1]) + LEAST)
        model.weights[side, at] -= moved[:, 0]
        model.factors[side, at] -= moved[:, 1:]
    return model


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of examples, a row each; counts and values that are all 1 are left out."""
    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        label = np.asarray(batch["label"], "f8")
        columns = [pa.array([len(label)], pa.int32()), pa.array([float(label.sum())]), pa.array([label.tobytes()], pa.binary())]
        for side in SIDES:
            slots, values = batch[f"__{side}_slots"], batch[f"__{side}_values"]
            counts, slots, values = np.diff(np.asarray(slots.offsets)).astype("i4"), np.asarray(slots.flatten(), "i4"), np.asarray(values.flatten(), "f8")
            left_out = lambda numbers: b"" if (numbers == 1).all() else numbers.tobytes()
            columns += [pa.array([part], pa.binary()) for part in (left_out(counts), slots.tobytes(), left_out(values))]
        return pa.RecordBatch.from_arrays(columns, names=["n", "total", "label", *[f"{s}_{p}" for s in SIDES for p in ("counts", "slots", "values")]])

    held, rows, features = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        features += sum(len(batch[f"__{s}_slots"].flatten()) for s in SIDES)
        if rows >= PACK or features >= PACKED_FEATURES:
            yield block(held)
            held, rows, features = [], 0, 0
    if held:
        yield block(held)


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[tuple]]]:
    """Labels, and per side the (slots, values, row of each), of the rows of blocks: at least ``POOL`` or their features, but for the last.

    Values are None where all are 1, rows where each has one feature.
    """
    def side(held: list[dict], name: str) -> tuple:
        counts = [np.frombuffer(b[f"{name}_counts"], "i4") for b in held]
        slots = [np.frombuffer(b[f"{name}_slots"], "i4") for b in held]
        values, rows = None, None
        if any(b[f"{name}_values"] for b in held):
            values = np.concatenate([np.frombuffer(b[f"{name}_values"], "f8") if b[f"{name}_values"] else np.ones(len(s)) for b, s in zip(held, slots)])
        if any(len(c) for c in counts):
            rows = np.concatenate([c if len(c) else np.ones(b["n"], "i4") for b, c in zip(held, counts)])
            rows = np.repeat(np.arange(len(rows)), rows)
        return np.concatenate(slots).astype(np.intp), values, rows

    def pool(held: list[dict]) -> tuple[np.ndarray, list[tuple]]:
        return np.concatenate([np.frombuffer(b["label"], "f8") for b in held]), [side(held, s) for s in SIDES]

    held, size = [], 0
    for batch in batches:
        for block in batch.to_pylist():
            held.append(block)
            size += max(block["n"], *[len(block[f"{s}_slots"]) // 4 for s in SIDES])
            if size >= POOL:
                yield pool(held)
                held, size = [], 0
    if held:
        yield pool(held)


def _gradients(shared):
    """:func:`_block_gradients` of rows that are not packed."""
    run = _block_gradients(shared)
    return lambda batches: run(_packed(batches))


def _block_gradients(shared):
    """Gradients of the slots that a task's rows touch, added up over all its rows: one row a slot and side."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = ["side", "slot", *[f"g{k}" for k in range(model.rank + 1)]]
        size = 1 << model.bits
        # One table a factor: numbers of one table are looked up several times as fast as rows of all.
        tables = [[model.weights[n], *np.ascontiguousarray(model.factors[n].T)] for n in range(len(SIDES))]
        gradient, touched, total = np.zeros((len(SIDES), model.rank + 1, size)), np.zeros((len(SIDES), size), bool), 0.0
        times = lambda numbers, values: numbers if values is None else numbers * values
        for label, given in _pooled(batches):
            sums = []
            for n, (slots, values, rows) in enumerate(given):
                own = (times(t[slots], values) for t in tables[n])
                sums.append([x if rows is None else np.bincount(rows, x, len(label)) for x in own])
            score = model.bias + sums[0][0] + sums[1][0]
            for mine, other in zip(sums[0][1:], sums[1][1:]):
                score += mine * other
            error = model.linked(score) - label
            for n, (slots, values, rows) in enumerate(given):
                at = slice(None) if rows is None else rows
                pull = times(error[at], values)
                touched[n, slots] = True
                gradient[n, 0] += np.bincount(slots, pull, size)
                for k, other in enumerate(sums[1 - n][1:]):
                    gradient[n, k + 1] += np.bincount(slots, pull * other[at], size)
            total += float(error.sum())
        for n in range(len(SIDES)):
            places = np.flatnonzero(touched[n])
            for first in range(0, len(places), OUT):
                at = places[first : first + OUT]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), n, np.int32)), pa.array(at.astype(np.int32)), *map(pa.array, gradient[n][:, at])], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([len(SIDES)], pa.int32()), pa.array([0], pa.int32()), pa.array([total]),
                                          *[pa.array([0.0])] * model.rank], names=names)

    return run


def predict(model: GroupFactors, examples: DataFrame, left: str, right: str, output: str = "prediction") -> DataFrame:
    """Examples with their score; a missing group or unknown features add nothing."""
    rows = hashed(examples, left, right, model.bits)
    made = [f"__{s}_{p}" for s in SIDES for p in ("slots", "values")]
    kept = [c for c in rows.columns if c not in made]
    schema = rows.select(*kept).withColumn(output, F.lit(0.0)).schema
    shared = examples.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shared.value
            sums = [own.sums(n, *_side(batch, s), batch.num_rows) for n, s in enumerate(SIDES)]
            columns = [batch[c] for c in kept] + [pa.array(own.scores(*sums))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, output])

    return rows.mapInArrow(run, schema)


def side_vectors(model: GroupFactors, rows: DataFrame, key: str, group: str, side: int) -> DataFrame:
    """(id, features): one vector per row of a side, whose inner products with the other side's are the scores.

    Behind the summed factors stand two coordinates for what a side adds alone: the left one
    brings its weights with the bias and a 1, the right one a 1 and its weights.
    """
    one = rows.select(F.col(key).cast("int").alias("id"), F.col(group).alias("own"), F.col(group).alias("none"))
    given = hashed(one, "own", "none", model.bits).select("id", "__left_slots", "__left_values")
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shared.value
            linear, factors = own.sums(side, *_side(batch, "left"), batch.num_rows)
            alone, one = linear + (own.bias if side == 0 else 0.0), np.ones(batch.num_rows)
            vectors = np.column_stack([factors, *((alone, one) if side == 0 else (one, alone))]).astype(np.float32)
            listed = pa.ListArray.from_arrays(np.arange(0, vectors.size + 1, vectors.shape[1], dtype=np.int32), pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([batch["id"], listed], names=["id", "features"])

    return pin(given.mapInArrow(run, "id int, features array<float>"), "sides")


def recommend(model: GroupFactors, users: DataFrame, items: DataFrame, ratings: DataFrame, left: str, right: str, k: int = 10,
              **limits) -> DataFrame:
    """The best ``k`` unrated items of each of ``users`` (user_id, left) among ``items`` (item_id, right), by tiles.

    Ids are whole numbers of 32 bits; each user and item has one row.
    """
    ours = side_vectors(model, users, "user_id", left, 0)
    theirs = side_vectors(model, items, "item_id", right, 1)
    return ranking.recommend_by_vectors(ours, theirs, model.rank + 2, ratings, k, **limits)
