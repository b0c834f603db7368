"""Quality of texts: n-gram indicators scaled by naive-Bayes log-count ratios under a linear hinge-loss model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import pieces
from quillrank.session import pin

#: N-grams are hashed to 2**BITS slots: runs of 1 to CHARACTERS bytes, 1 to WORDS words or runs of other signs, and how
#: often one of these follows itself, up to REPEATS times.
BITS, CHARACTERS, WORDS, REPEATS = 18, 3, 2, 4
#: Added to the counts of both classes together.
SMOOTH = 2.0
#: Labelled rows of each class that the hinge-loss model is fitted on at most, and bytes of their texts together.
PER_CLASS, SAMPLE_BYTES = 3_000, 8 << 20
#: Labels up to so many rows are sent to the texts; above, texts are shuffled to their labels.
BROADCAST = 2_000_000
#: Slots that are counted together.
BLOCK = 1 << 14
#: Cost of an error, rounds of coordinate descent at most, change of a dual variable at which it ends.
COST, ROUNDS, CLOSE = 1.0, 30, 1e-2
#: Share of the fitted weights; the rest is their mean size, the same for all n-grams.
OWN = 0.75
#: Parts of the training rows; each is scored without itself to calibrate the scores.
FOLDS = 3
#: Rows whose crc32 leaves HELD_OUT when divided by this are not learned from.
MODULUS, HELD_OUT = 3, 1

#: Byte values from 1, A-Z as lower case.
FOLDED = np.arange(1, 257, dtype=np.uint64)
FOLDED[65:91] += np.uint64(32)
#: Kinds of bytes: 0 space, 1 letters, digits and what lies beyond ASCII, 2 other signs.
KIND = np.full(256, 2, np.uint8)
KIND[[*b"\x09\x0a\x0b\x0c\x0d\x20"]] = 0
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
#: Odd multipliers of the hashes.
STEP, MIX, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint32(0x9E3779B1)


def held_out(key: str) -> Column:
    """Whether a row is kept from learning, by the crc32 of its id as text."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(MODULUS)) == HELD_OUT, F.lit(False))


class Slots:
    """Slots of the n-grams that a text has. Works in arrays as long as the text."""

    def __init__(self):
        self.last = np.zeros(1 << BITS, np.int32)

    def __call__(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        if not raw.size:
            return np.zeros(0, np.int32)
        found = []
        wide = raw.astype(np.uint32) + np.uint32(1)
        run = wide
        for size in range(1, CHARACTERS + 1):
            if size > 1:
                run = run[:-1] * np.uint32(257) + wide[size - 1 :]
            if not len(run):
                break
            found.append(((run + np.uint32(size << 26)) * SPREAD) >> np.uint32(32 - BITS))
        words = _words(raw)
        run = words
        for size in range(1, WORDS + 1):
            if size > 1:
                run = run[:-1] * STEP + words[size - 1 :]
            if not len(run):
                break
            found.append(_slot(run + np.uint64(size)))
        same = words[1:] == words[:-1]
        run = same
        for size in range(1, REPEATS + 1):
            if not run.any():
                break
            found.append(_slot(np.array([size << 48], np.uint64)))
            run = run[:-1] & same[size:]
        slots = np.concatenate(found).astype(np.intp)
        # Each slot keeps the place of its last n-gram; that one alone stands for it.
        places = np.arange(len(slots), dtype=np.int32)
        self.last[slots] = places
        return slots[self.last[slots] == places].astype(np.int32)


def _slot(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * MIX
    return (values >> np.uint64(64 - BITS)).astype(np.uint32)


def _words(raw: np.ndarray) -> np.ndarray:
    """Hash of each word and each run of other signs, A-Z as lower case."""
    kind = KIND[raw]
    new = np.empty(len(raw) + 1, bool)
    new[0] = new[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:-1])
    begin = np.flatnonzero(new)
    long = np.diff(begin)
    # Sums of byte times power of its place in the run.
    powers = np.cumprod(np.full(int(long.max()), STEP, np.uint64))
    place = np.arange(len(raw)) - np.repeat(begin[:-1], long)
    sums = np.add.reduceat(FOLDED[raw] * powers[place], begin[:-1])
    return sums[kind[begin[:-1]] > 0]


@dataclass
class Model:
    """Weight of each slot times its log-count ratio, ratios, bias, and slope and offset of the calibrated score."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, slots: np.ndarray) -> float:
        size = float(np.sqrt((self.ratios[slots].astype(np.float64) ** 2).sum()))
        return float(self.weights[slots].sum(dtype=np.float64)) / (size or 1.0) + self.bias

    def score(self, slots: np.ndarray) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.slope * self.margin(slots) + self.offset, -500, 500))))


def log_ratios(positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Log of the smoothed share of each slot's count in the one class over that in the other.

    What is added to the counts is dealt out by the classes' sizes, so that rare n-grams lean to neither class.
    """
    total = positive.sum(), negative.sum()
    if not min(total):
        return np.zeros(len(positive))
    p, q = (c + SMOOTH * t / sum(total) for c, t in zip((positive, negative), total))
    return np.log(p / total[0]) - np.log(q / total[1])


def descend(rows: list[np.ndarray], signs: np.ndarray, ratios: np.ndarray, costs: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of least hinge loss, by coordinate descent over the dual variables of the rows.

    Rows are scaled to unit length; the bias is the weight of a feature that is 1 everywhere.
    """
    weights, bias = np.zeros(len(ratios)), 0.0
    values = []
    for slots in rows:
        own = ratios[slots]
        size = np.sqrt((own**2).sum())
        values.append(own / (size or 1.0))
    squares = np.array([float((v**2).sum()) + 1.0 for v in values])
    dual = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    active = np.arange(len(rows))
    for turn in range(ROUNDS):
        whole = len(active) == len(rows)
        moved_most, moved_rows = 0.0, []
        for k in rng.permutation(active):
            slots, value = rows[k], values[k]
            gradient = signs[k] * (weights[slots] @ value + bias) - 1
            moved = min(max(dual[k] - gradient / squares[k], 0.0), costs[k]) - dual[k]
            if moved:
                weights[slots] += (moved * signs[k]) * value
                bias += moved * signs[k]
                dual[k] += moved
                moved_most = max(moved_most, abs(moved))
                moved_rows.append(k)
        if moved_most < CLOSE and whole:
            break
        # Rows that rest are left out until the others rest or the last rounds come.
        active = np.array(moved_rows) if moved_most >= CLOSE and turn % 5 < 4 else np.arange(len(rows))
    return weights, bias


def calibrated(margins: np.ndarray, labels: np.ndarray, importance: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits the labels best, by Newton steps on smoothed targets."""
    total = [float(importance[labels == c].sum()) for c in (0, 1)]
    target = np.where(labels == 1, (total[1] + 1) / (total[1] + 2), 1 / (total[0] + 2))
    slope, offset = 1.0, float(np.log((total[1] + 1) / (total[0] + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -500, 500)))
        error, spread = importance * (p - target), importance * p * (1 - p) + 1e-12
        g = np.array([error @ margins, error.sum()])
        h = np.array([[spread @ margins**2 + 1e-6, spread @ margins], [spread @ margins, spread.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -4, 4)
        slope, offset = slope - move[0], offset - move[1]
        if np.abs(move).max() < 1e-9:
            break
    return max(slope, 0.0), offset


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model of the labels 0 and 1 of documents that are not held out.

    Log-count ratios are counted over all of these; the hinge-loss model is
    fitted on ``PER_CLASS`` rows of each class at most, those with the smallest hashes, and fewer
    where their texts have more than ``SAMPLE_BYTES``. Rows without a text, id or label 0
    or 1 teach nothing; an id with several labels or texts counts with each. With one class only,
    every score is that class's smoothed share; without labels it is 1/2.
    """
    labels = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").distinct()
    labels = pin(labels, "quality-labels")
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where(~held_out(key) & F.col(text).isNotNull())
    small = labels.count() <= BROADCAST
    rows = rows.join(F.broadcast(labels) if small else labels, "id").withColumn("code", F.xxhash64("id"))
    rows = rows.select("text", "label", "code", F.pmod("code", F.lit(FOLDS)).cast("int").alias("fold"), F.octet_length("text").alias("bytes"))
    rows = rows if small else pin(rows, "quality-rows")
    # 2**BITS slots by FOLDS parts and 2 classes, whatever the number of rows.
    counts = rows.select("text", "label", "fold").mapInArrow(_counted, "part int, packed binary")
    counts = counts.repartition(2 * FOLDS * max(1, (1 << BITS) // BLOCK), "part").mapInArrow(_summed, "kind int, slot int, n long").toArrow()
    table = np.zeros((2 * FOLDS, 1 << BITS))
    if counts.num_rows:
        table[np.asarray(counts["kind"]), np.asarray(counts["slot"])] = np.asarray(counts["n"])
    sizes = rows.groupBy("fold", "label").count().collect()
    of_class = [sum(r["count"] for r in sizes if r.label == c) for c in (0, 1)]
    if not min(of_class):
        share = (of_class[1] + 1) / (sum(of_class) + 2)
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    chosen = []
    for c in (0, 1):
        ordered = rows.where(F.col("label") == c).select("code", "bytes").orderBy("code", "bytes").limit(PER_CLASS).collect()
        keep = int(np.searchsorted(np.cumsum([r["bytes"] for r in ordered]), SAMPLE_BYTES, side="right"))
        chosen.append((F.col("label") == c) & (F.col("code") <= ordered[min(max(keep, 1), len(ordered)) - 1].code))
    picked = rows.where(chosen[0] | chosen[1]).select("code", "text", "label", "fold")
    sample = picked.mapInArrow(_featured, "code long, label int, fold int, slots array<int>").toArrow()
    sample = sample.sort_by([("code", "ascending"), ("label", "ascending")])
    label_of, fold_of = np.asarray(sample["label"]), np.asarray(sample["fold"])
    listed = sample["slots"].combine_chunks()
    flat, ends = np.asarray(listed.flatten()), np.asarray(listed.offsets)
    own = [flat[a:b] for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0])]
    signs = np.where(label_of == 1, 1.0, -1.0)
    # The sample has other shares of the classes than all rows have.
    importance = np.array([of_class[c] / max(1, int((label_of == c).sum())) for c in (0, 1)])[label_of]
    costs = COST * np.array([len(own) / (2 * max(1, int((label_of == c).sum()))) for c in (0, 1)])[label_of]

    def learn(rows_in: np.ndarray, table_in: np.ndarray) -> Model:
        ratios = log_ratios(table_in[FOLDS:].sum(0), table_in[:FOLDS].sum(0))
        weights, bias = descend([own[k] for k in rows_in], signs[rows_in], ratios, costs[rows_in])
        even = np.abs(weights[weights != 0]).mean() if weights.any() else 0.0
        return Model((ratios * ((1 - OWN) * even + OWN * weights)).astype(np.float32), ratios.astype(np.float32), bias, 1.0, 0.0)

    margins = np.zeros(len(own))
    for fold in range(FOLDS):
        others = np.flatnonzero(fold_of != fold)
        without = table.copy()
        without[[fold, FOLDS + fold]] = 0
        part = learn(others, without)
        for k in np.flatnonzero(fold_of == fold):
            margins[k] = part.margin(own[k])
    model = learn(np.arange(len(own)), table)
    model.slope, model.offset = calibrated(margins, label_of, importance)
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slots_of = Slots()
    for code, text, label, fold in pieces(batches):
        slots = [slots_of(t) for t in text]
        ends = np.cumsum([0, *map(len, slots)], dtype=np.int32)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*slots, np.zeros(0, np.int32)])))
        columns = [pa.array(code, pa.int64()), pa.array(label, pa.int32()), pa.array(fold, pa.int32()), listed]
        yield pa.RecordBatch.from_arrays(columns, names=["code", "label", "fold", "slots"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each class and part have each slot, a packed row for each block of slots."""
    table, slots_of, seen = np.zeros((2 * FOLDS, 1 << BITS), np.int32), Slots(), False
    for texts, label, fold in pieces(batches, 0):
        seen = True
        for text, c, f in zip(texts, label, fold):
            table[c * FOLDS + f, slots_of(text)] += 1
    if seen:
        rows = [(n, row) for n, row in enumerate(table.reshape(-1, min(BLOCK, 1 << BITS))) if row.any()]
        packed = [zstandard.ZstdCompressor(level=3).compress(row.tobytes()) for _, row in rows]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int32()), pa.array(packed, pa.binary())], names=["part", "packed"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = min(BLOCK, 1 << BITS)
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, packed in zip(batch["part"].to_pylist(), batch["packed"].to_pylist()):
            row = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.int32)
            totals[part] = totals.get(part, 0) + row.astype(np.int64)
    for part, total in totals.items():
        kind, first = divmod(part * size, 1 << BITS)
        slot = np.flatnonzero(total)
        columns = [pa.array(np.full(len(slot), kind, np.int32)), pa.array((slot + first).astype(np.int32)), pa.array(total[slot])]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "slot", "n"])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, from its whole text alone.

    ``score`` is the calibrated probability of label 1; null and empty texts and
    texts without known n-grams get the score of a text without any. Rows with one id
    each get their own score, null ids are not held out, an empty table gives none;
    other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), F.col(key).cast("long").alias("doc_id"), held_out(key).alias("held_out"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots_of, known = Slots(), shared.value
        for texts, ids, held in pieces(batches, 0):
            scores = np.array([known.score(slots_of(t)) for t in texts])
            columns = [pa.array(ids, pa.int64()), pa.array(held), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
