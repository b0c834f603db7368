"""Hard negatives: angles to reference directions bound each score, and only rows that can matter are multiplied."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm import vectors
from quillrank.session import pin

#: Reference directions, rows that they are found on, and rounds in which they move to the middle of their rows.
REFERENCES, SAMPLE, ROUNDS = 16, 20_000, 5
#: What is added to each angle bound; far above the rounding of a computed angle.
ANGLE = 1e-6
#: Numbers from here on are not exact as doubles.
EXACT = 2.0**53
#: Rows whose bound is looked at together; after each run the least score that matters is raised.
STEP = 512


def directions(sample: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors that lie in the middle of groups of the sample: far-apart rows, moved to their groups' means."""
    size = np.sqrt((sample**2).sum(1))
    unit = sample[size > 0] / size[size > 0][:, None]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    chosen = [0]
    near = unit @ unit[0]
    while len(chosen) < min(count, len(unit)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    middle = unit[chosen]
    for _ in range(ROUNDS):
        own = (unit @ middle.T).argmax(1)
        total = np.zeros_like(middle)
        np.add.at(total, own, unit)
        length = np.sqrt((total**2).sum(1))
        middle = np.where(length[:, None] > 1e-9, total / np.where(length > 1e-9, length, 1)[:, None], middle)
    return middle


def measured(rows: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of each row and its angles to the references; a row without length has angle 0."""
    size = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
    cosine = rows @ references.T / np.where(size > 0, size, 1)[:, None]
    return size, np.where(size[:, None] > 0, np.arccos(np.clip(cosine, -1, 1)), 0.0)


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; as doubles where these are exact."""
    widest = float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, rows.shape[1])
    if widest < EXACT:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    return rows @ query


class Block:
    """Rows of one cell: ids, labels, integer vectors, lengths and angles to the references."""

    def __init__(self, fields: dict[str, pa.Array], references: np.ndarray):
        width = references.shape[1]
        self.ids, self.labels = np.asarray(fields["id"]), np.asarray(fields["label"])
        self.rows = vectors.matrix(fields["v"], width, np.int64)
        self.exact = float(np.abs(self.rows).max(initial=0))
        self.real = self.rows.astype(np.float64)
        self.size, self.angles = measured(self.rows, references)

    def bounds(self, size: float, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score each row can have with a query of this length and these angles.

        The angle between two vectors is at least the difference of their angles to a
        reference and at most the sum, or what is left of the full turn beyond pi.
        """
        near, far = np.zeros(len(self.ids)), np.full(len(self.ids), np.pi)
        for k, angle in enumerate(angles):
            own = self.angles[:, k]
            np.maximum(near, np.abs(own - angle), out=near)
            np.minimum(far, np.minimum(own + angle, 2 * np.pi - own - angle), out=far)
        length = self.size * size
        low = np.floor(length * (np.cos(np.minimum(far + ANGLE, np.pi)) - 1e-9)) - 1
        return low, np.ceil(length * (np.cos(np.maximum(near - ANGLE, 0)) + 1e-9)) + 1

    def scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        if self.exact * float(np.abs(query).max(initial=0)) * max(1, len(query)) < EXACT:
            return (self.real[at] @ query.astype(np.float64)).astype(np.int64)
        return self.rows[at] @ query

    def positives(self, own: int, label: int, query: np.ndarray, size: float, angles: np.ndarray, least: float, k: int):
        """Ids and scores of the k best other rows of the label, if they reach ``least``."""
        _, high = self.bounds(size, angles)
        at = np.flatnonzero((self.labels == label) & (self.ids != own) & (high >= least))
        return self._best(at, high, query, least, np.inf, k)

    def negatives(self, label: int, query: np.ndarray, size: float, angles: np.ndarray, windows: list[tuple[int, int]], k: int):
        """(number of the window, ids, scores): the k best rows of other labels in each window."""
        low, high = self.bounds(size, angles)
        other = self.labels != label
        # Windows that share rows multiply them once.
        known = np.zeros(len(self.ids), np.int64)
        done = np.zeros(len(self.ids), bool)
        for number, (least, most) in enumerate(windows):
            at = np.flatnonzero(other & (high >= least) & (low <= most))
            yield number, *self._best(at, high, query, least, most, k, known, done)

    def _best(self, at, high, query, least, most, k, known=None, done=None):
        """The k best of the rows ``at`` with a score from ``least`` to ``most``, those with the highest bounds first."""
        at = at[np.argsort(-high[at], kind="stable")]
        ids, scores = self.ids[:0], np.zeros(0, np.int64)
        for start in range(0, len(at), STEP):
            part = at[start : start + STEP]
            if len(scores) >= k and high[part[0]] < scores[-1]:
                break
            if known is None:
                own = self.scores(part, query)
            else:
                new = part[~done[part]]
                known[new], done[new] = self.scores(new, query), True
                own = known[part]
            keep = (own >= least) & (own <= most)
            ids, scores = np.r_[ids, self.ids[part[keep]]], np.r_[scores, own[keep]]
            best = vectors.top(ids, scores, k)
            ids, scores = ids[best], scores[best]
        return ids, scores


def hard_negatives(
    df: DataFrame, key: str, vector: str, label: str, anchor_every: int = 100, k_positive: int = 5, k_negative: int = 10,
    low: int = 30, high: int = 90, scale: int = 256, changed_every: int = 7, labels: int = 10,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor and positive.

    Components x become floor(scale * x), scores are integer inner products. Rows
    whose key is divisible by ``changed_every`` first change their label to
    (label + 1) % ``labels``; 0 changes none. Anchors are rows whose key is divisible by
    ``anchor_every``; positives the ``k_positive`` best other rows of the same label,
    negatives the ``k_negative`` best rows of other labels whose score is from ``low`` to
    ``high`` hundredths of the positive's. Ties go to the smaller id; fewer rows, if
    there are fewer. A negative positive score has an empty window.

    Rows with a null key, label or vector or any null or non-finite component take no part;
    of rows with one key that with the largest (vector, label) does; missing components of shorter
    vectors are 0. An empty table gives no rows; other columns are not read. Products must stay
    below 2^63.

    Rows lie in the cell of their nearest reference direction, cut into blocks of
    about ``vectors.BLOCK`` rows, so that a hot label or cell fills many tasks. An
    anchor meets the cells whose range of angles and lengths lets a score reach its
    least score or windows; in a block the stored angles decide which rows are multiplied.
    """
    spark = df.sparkSession
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", whole))
    rows = rows.groupBy("id").agg(F.max(F.struct("v", "label")).alias("r")).select("id", "r.label", "r.v")
    if changed_every:
        rows = rows.withColumn("label", F.when(F.col("id") % changed_every == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label")))
    rows = pin(rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long"))), "negative-rows")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    count, width, anchors = rows.agg(F.count("*"), F.max(F.size("v")), F.count_if(F.col("id") % anchor_every == 0)).first()
    if not anchors:
        return spark.createDataFrame([], schema)

    sample = rows.select("v").orderBy(F.xxhash64("id")).limit(SAMPLE).toArrow()
    references = directions(vectors.matrix(sample["v"].combine_chunks(), width))
    if not len(references):
        references = np.eye(1, width)
    stored = pin(rows.mapInArrow(_located(references), "id long, label long, v array<long>, size double, angles array<double>, cell int"), "negative-angles")
    spans = [F.min(F.col("angles")[k]).alias(f"low{k}") for k in range(len(references))]
    spans += [F.max(F.col("angles")[k]).alias(f"high{k}") for k in range(len(references))]
    # One row a reference.
    cells = stored.groupBy("cell").agg(vectors.blocks_of(F.count("*")).alias("blocks"), F.max("size").alias("longest"), *spans).collect()
    parts = {c.cell: c.blocks for c in cells}
    split = F.element_at(F.create_map(*(F.lit(x) for pair in parts.items() for x in pair)), F.col("cell"))
    packed = stored.withColumn("block", vectors.deal(F.col("id"), split))
    packed = packed.groupBy("cell", "block").agg(F.collect_list(F.struct("id", "label", "v")).alias("rows"))
    packed = pin(packed, "negative-blocks")
    asked = stored.where(F.col("id") % anchor_every == 0).select("id", "label", "v", "size", "angles")
    packs = max(1, -(-anchors // vectors.PACK))

    first = asked.withColumn("windows", F.array(F.struct(F.lit(0).cast("long").alias("positive"), F.lit(-(2**62)).alias("low"), F.lit(2**62).alias("high"))))
    # The own cell's nearest block first: its positives give each anchor a score that others must reach.
    first = first.withColumn("least", F.lit(None).cast("long"))
    own = first.withColumn("cell", F.array_position("angles", F.array_min("angles")).cast("int") - 1)
    own = own.withColumn("block", vectors.deal(F.col("id"), F.element_at(F.create_map(*(F.lit(x) for pair in parts.items() for x in pair)), F.col("cell"))))
    near = _searched(_met(own, packs), packed, references, k_positive, True)
    least = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list("score"), False).alias("s"))
    least = least.select(F.col("anchor_id").alias("id"), F.try_element_at("s", F.lit(k_positive)).alias("least"))
    asked_again = first.drop("least").join(least, "id", "left")
    found = _searched(_met(_cells(asked_again, cells, len(references)), packs), packed, references, k_positive, True)
    order = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id")
    positives = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k_positive)
    positives = pin(positives.select("anchor_id", F.col("vec_id").alias("positive"), F.col("score").alias("positive_score")), "positives")

    # Whole scores from ceil(low * p / 100) to floor(high * p / 100).
    window = F.struct("positive", F.expr(f"-floor(-{low} * cast(positive_score as decimal(20,0)) / 100)").cast("long").alias("low"),
                      F.expr(f"floor({high} * cast(positive_score as decimal(20,0)) / 100)").cast("long").alias("high"))
    windows = positives.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(window).alias("windows"))
    windows = windows.withColumn("windows", F.filter("windows", lambda w: w["low"] <= w["high"])).where(F.size("windows") > 0)
    asked = asked.join(windows, "id").withColumn("least", F.array_min(F.transform("windows", lambda w: w["low"])))
    found = _searched(_met(_cells(asked, cells, len(references)), packs), packed, references, k_negative, False)
    order = Window.partitionBy("anchor_id", "positive").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k_negative)
    return best.join(positives, ["anchor_id", "positive"]).select(
        "anchor_id", F.col("positive").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def _located(references: np.ndarray):
    """Length, angles to the references and nearest reference of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = vectors.matrix(batch["v"], references.shape[1], np.int64)
            size, angles = measured(rows, references)
            listed = pa.ListArray.from_arrays(np.arange(0, angles.size + 1, len(references), dtype=np.int32), pa.array(angles.ravel()))
            cell = pa.array(angles.argmin(1).astype(np.int32)) if len(rows) else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("id", "label", "v")), pa.array(size), listed, cell],
                                             names=["id", "label", "v", "size", "angles", "cell"])

    return run


def _cells(asked: DataFrame, cells: list, references: int) -> DataFrame:
    """The anchors with every block of the cells in which a score can reach ``least``."""
    listed = F.array(*(F.struct(
        F.lit(c.cell).alias("cell"), F.lit(c.blocks).alias("blocks"), F.lit(c.longest).alias("longest"),
        F.array(*(F.lit(c[f"low{k}"]) for k in range(references))).alias("low"),
        F.array(*(F.lit(c[f"high{k}"]) for k in range(references))).alias("high")) for c in cells))

    def reaches(c):
        gaps = F.transform(F.arrays_zip(F.col("angles"), c["low"], c["high"]), lambda z: F.greatest(z["angles"] - z["high"], z["low"] - z["angles"], F.lit(0.0)))
        near = F.greatest(F.array_max(gaps) - ANGLE, F.lit(0.0))
        top = F.col("size") * c["longest"] * (F.cos(near) + 1e-9)
        # Short rows of a cell that lies beyond a right angle score highest; they can't reach above 0.
        top = F.ceil(F.greatest(top, F.lit(0.0))) + 1
        return F.coalesce(F.col("least") <= top, F.lit(True))

    met = asked.withColumn("c", F.explode(F.filter(listed, reaches)))
    return met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("c.blocks") - 1))).withColumn("cell", F.col("c.cell")).drop("c")


def _met(asked: DataFrame, packs: int) -> DataFrame:
    """Anchors of one block in packs."""
    question = F.struct("id", "label", "v", "size", "angles", "least", "windows")
    asked = asked.withColumn("pack", vectors.deal(F.col("id"), F.lit(packs)))
    return asked.groupBy("cell", "block", "pack").agg(F.collect_list(question).alias("questions"))


def _searched(met: DataFrame, packed: DataFrame, references: np.ndarray, k: int, same: bool) -> DataFrame:
    """(anchor_id, positive, vec_id, score) of the best rows in each block: of the own label, or of others in each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ask in zip(batch["rows"], batch["questions"]):
                block, asked = Block(vectors.structs(row), references), vectors.structs(ask)
                values = vectors.matrix(asked["v"], references.shape[1], np.int64)
                angles = vectors.matrix(asked["angles"], len(references))
                out: list[tuple[np.ndarray, ...]] = []
                for number, (own, label, size, least) in enumerate(zip(*(asked[c].to_pylist() for c in ("id", "label", "size", "least")))):
                    about = values[number], size, angles[number]
                    if same:
                        ids, scores = block.positives(own, label, *about, -np.inf if least is None else least, k)
                        out.append((np.full(len(ids), own), np.zeros(len(ids), np.int64), ids, scores))
                        continue
                    windows = asked["windows"][number].as_py()
                    for which, ids, scores in block.negatives(label, *about, [(w["low"], w["high"]) for w in windows], k):
                        out.append((np.full(len(ids), own), np.full(len(ids), windows[which]["positive"]), ids, scores))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)],
                                                 names=["anchor_id", "positive", "vec_id", "score"])

    joined = met.join(packed.hint("shuffle_hash"), ["cell", "block"]).select("rows", "questions")
    return joined.mapInArrow(run, "anchor_id long, positive long, vec_id long, score long")
