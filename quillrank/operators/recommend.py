"""Rating models and the best unseen items of every user."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.tiles import Shape, best_of_tile
from quillrank.operators.joins import join_lookup, top_k, union_all
from quillrank.operators.ordered import number_rows
from quillrank.session import pin, shared_dir

# Ranks per block when walking a ranked item list.
RANK_BLOCK = 1_024

# Largest score tile: users, items and rated pairs of one task.
USER_TILE = 16_384
ITEM_TILE = 65_536
TILE_RATINGS = 4_000_000

# Items of a round as a multiple of those of the round before it.
ROUND_GROWTH = 4

# Tiles per task slot, but no tile below this many users for the sake of more tasks.
TILES_PER_SLOT = 4
LEAST_USERS = 256
MOST_TASKS = 20_000

# Iterations of a fit before its lineage is cut.
LINEAGE = 10

# Item factors are broadcast up to this size.
BROADCAST_BYTES = 256 << 20

# Ratings of a factor block, at most on average; a block is solved in one task, with 8 bytes a rating.
BLOCK_RATINGS = 20_000_000

# Ratings of a slot above which the blocks of a fit are kept on disk: with 28 bytes a rating they would take
# memory that the tasks making and solving blocks need.
KEPT_RATINGS = 8_000_000

# Ratings of a slot above which sending the factors costs more than a third of the slots.
SLOT_RATINGS = 1_000_000


def pair_space(ratings: DataFrame, items: DataFrame, user: str = "user_id", item: str = "item_id"
               ) -> DataFrame:
    """Per user the size of its candidate set: all items, rated ones, unrated ones.

    The pairs themselves are counted, never formed.
    """
    n_items = items.select(item).distinct().count()
    rated = ratings.select(user, item).distinct().groupBy(user).agg(F.count(F.lit(1)).alias("rated"))
    return rated.select(
        user, F.lit(n_items).cast("bigint").alias("items"), "rated",
        (F.lit(n_items) - F.col("rated")).cast("bigint").alias("unrated"),
    )


def item_means(ratings: DataFrame, digits: int = 6) -> DataFrame:
    """(item_id, score, position): items by falling mean rating, then falling id."""
    means = ratings.groupBy("item_id").agg(F.round(F.avg("rating"), digits).alias("score"))
    return number_rows(means, [F.desc("score"), F.desc("item_id")], name="position")


def unseen_by_rank(ratings: DataFrame, ranked_items: DataFrame, k: int = 10,
                   block_size: int = RANK_BLOCK) -> DataFrame:
    """Top ``k`` unrated items per user when all users share one item ranking.

    The first block of the ranking is enough for every user who left ``k`` gaps
    in it. Only its ratings are looked at, and per user no more than one block is
    collected. Users with fewer gaps there go through all their blocks.
    ``ranked_items``: (item_id, score, position).
    """
    block_size = max(block_size, k)
    n_items = ranked_items.count()
    head_size = min(block_size, n_items)
    head = ranked_items.filter(F.col("position") <= block_size)
    marked = join_lookup(ratings.select("user_id", "item_id"), head.select("item_id", "position"), "item_id", "left")
    # A left join leaves the position empty outside the first block, and sets skip empty values.
    per_user = pin(marked.groupBy("user_id").agg(F.collect_set("position").alias("taken")), "head")
    enough = (F.size("taken") + k <= head_size) if n_items > block_size else F.lit(True)
    free = F.array_except(F.sequence(F.lit(1).cast("bigint"), F.lit(head_size).cast("bigint")), F.col("taken"))
    light = per_user.filter(enough).select("user_id", F.posexplode(F.slice(free, 1, k)).alias("pos", "position"))
    recs = join_lookup(light, head, "position").select(
        "user_id", "item_id", "score", (F.col("pos") + 1).cast("bigint").alias("rank")
    )
    heavy = per_user.filter(~enough).select("user_id")
    if heavy.isEmpty():
        return recs
    theirs = join_lookup(ratings.select("user_id", "item_id"), heavy, "user_id")
    return recs.unionByName(_unseen_by_block(theirs, ranked_items, n_items, k, block_size))


def _unseen_by_block(ratings: DataFrame, ranked_items: DataFrame, n_items: int, k: int, block_size: int
                     ) -> DataFrame:
    """Gaps of users over all blocks of the ranking.

    Rated positions are collected per user and block. A full block gives
    nothing, and after a block without ratings the list is full, so only the
    gaps of few blocks are written out: ``k`` rows per user.
    """
    last = (n_items - 1) // block_size
    rated = join_lookup(ratings, ranked_items.select("item_id", "position"), "item_id")
    block = F.floor((F.col("position") - 1) / block_size).cast("bigint")
    used = rated.groupBy("user_id", block.alias("block")).agg(F.collect_set("position").alias("taken"))

    # The first block of each user and the one after each used block may hold gaps too.
    none = F.array().cast("array<bigint>")

    def entry(number, taken):
        return F.struct(number.cast("bigint").alias("block"), taken.alias("taken"))

    entries = F.explode(
        F.array(entry(F.col("block"), F.col("taken")), entry(F.col("block") + 1, none),
                entry(F.lit(0), none))
    )
    blocks = (
        used.select("user_id", entries.alias("e")).select("user_id", "e.block", "e.taken")
        .filter(F.col("block") <= last)
        .groupBy("user_id", "block")
        .agg(F.flatten(F.collect_list("taken")).alias("taken"))
    )
    start = F.col("block") * block_size
    earlier = (
        Window.partitionBy("user_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    gaps_before = start - F.coalesce(F.sum(F.size("taken")).over(earlier), F.lit(0))
    stop = F.least(start + block_size, F.lit(n_items))
    free = F.array_except(F.sequence(start + 1, stop), F.col("taken"))
    picked = (
        blocks.withColumn("gaps_before", gaps_before)
        .filter((F.col("gaps_before") < k) & (F.size("taken") < stop - start))
        .select("user_id", "gaps_before",
                F.posexplode(F.slice(free, F.lit(1), (F.lit(k) - F.col("gaps_before")).cast("int"))))
        .select("user_id", F.col("col").alias("position"),
                (F.col("gaps_before") + F.col("pos") + 1).cast("bigint").alias("rank"))
    )
    return join_lookup(picked, ranked_items, "position").select("user_id", "item_id", "score", "rank")


def factor_blocks(ratings: int, slots: int) -> int:
    """Blocks of users and of items for a fit.

    Each step sends a user's or item's factors to nearly every block of the other side, so what is
    shuffled grows with the blocks too. A small fit has a block a slot, a large one two for three slots, more only
    where a block would have over ``BLOCK_RATINGS`` ratings.
    """
    few = slots if ratings <= slots * SLOT_RATINGS else -(-2 * slots // 3)
    return max(few, -(-ratings // BLOCK_RATINGS))


def blocks_kept(ratings: int, slots: int) -> str:
    """Where a fit keeps its blocks between steps."""
    return "DISK_ONLY" if ratings > slots * KEPT_RATINGS else "MEMORY_AND_DISK"


def fit_ratings(
    ratings: DataFrame, rank: int = 10, iterations: int = 10, reg: float = 0.1, seed: int = 7,
    blocks: int | None = None,
) -> ALSModel:
    """Low-rank rating model by alternating least squares.

    Give a pinned table: blocks are built from it again after a lost executor.
    In longer fits the factor lineage is cut in the shared folder every ten iterations.
    """
    spark = ratings.sparkSession
    shared_dir(spark)
    count, slots = ratings.count(), spark.sparkContext.defaultParallelism
    blocks = blocks or factor_blocks(count, slots)
    als = ALS(
        rank=rank, maxIter=iterations, regParam=reg, seed=seed, numUserBlocks=blocks,
        numItemBlocks=blocks, checkpointInterval=LINEAGE if iterations > LINEAGE else -1, coldStartStrategy="drop",
        intermediateStorageLevel=blocks_kept(count, slots), userCol="user_id", itemCol="item_id", ratingCol="rating",
    )
    return als.fit(ratings.select("user_id", "item_id", F.col("rating").cast("float").alias("rating")))


def predict_pairs(model: ALSModel, pairs: DataFrame, unknown: str = "drop") -> DataFrame:
    """Add ``prediction`` to given pairs.

    Pairs with an unknown user or item are left out, or get NaN with ``unknown="nan"``.
    """
    return model.copy().setColdStartStrategy(unknown).transform(pairs)


def tiling(users: int, items: int, ratings: int, slots: int, user_tile: int = USER_TILE,
           item_tile: int = ITEM_TILE) -> tuple[int, int]:
    """(user parts, item parts): enough tiles for the slots, none too large in users, items or ratings."""
    item_parts = max(math.ceil(items / item_tile), 1)
    busy = min(math.ceil(TILES_PER_SLOT * slots / item_parts), math.ceil(users / LEAST_USERS))
    room = math.ceil(ratings / TILE_RATINGS / item_parts)
    return max(math.ceil(users / user_tile), busy, room, 1), item_parts


def recommend(
    model: ALSModel, ratings: DataFrame, k: int = 10, users: DataFrame | None = None,
    score_range: tuple[float, float] | None = None,
    user_tile: int = USER_TILE, item_tile: int = ITEM_TILE, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Top ``k`` unrated items of every user, or of the given ``users``: exact, ties by item id.

    Items are taken by falling length of their vectors, as :class:`Shape` turns them, in rounds of growing size. A user
    is done when no later item can reach its ``k``-th best score; those left go on to the next
    round, up to all items. Users and items of a round are cut into tiles. One task scores one tile with matrix
    products, hides the rated pairs of that tile, and hands on ``k`` rows per
    user; the partial lists then meet per user. Pairs are never rows, and work
    per task is bound by the tile, also for a user or an item with very many
    ratings. Item tiles of a checked total size are broadcast; larger ones are
    sent to the user tiles in two steps, so that no task copies a tile to all.
    """
    return recommend_by_vectors(model.userFactors, model.itemFactors, model.rank, ratings, k, users, score_range,
                                user_tile, item_tile, broadcast_bytes)


def recommend_by_vectors(
    user_vectors: DataFrame, item_vectors: DataFrame, rank: int, ratings: DataFrame, k: int = 10,
    users: DataFrame | None = None, score_range: tuple[float, float] | None = None,
    user_tile: int = USER_TILE, item_tile: int = ITEM_TILE, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """:func:`recommend` for any model whose scores are inner products of (id, features) vectors of ``rank`` numbers."""
    rated = ratings.select(
        F.col("user_id").cast("int").alias("user_id"), F.col("item_id").cast("int").alias("item_id")
    )
    chosen = user_vectors
    if users is not None:
        wanted = pin(users.select(F.col("user_id").cast("int").alias("id")).distinct(), "users")
        chosen = join_lookup(chosen, wanted, "id")
        rated = join_lookup(rated, wanted.withColumnRenamed("id", "user_id"), "user_id")

    shape = shape_of(item_vectors, rank)
    n_items = item_vectors.count()
    placed = _by_length(item_vectors, shape) if n_items > item_tile else item_vectors.select("id", "features", F.lit(1).alias("place"))
    low, high = score_range or (-math.inf, math.inf)
    order = [F.desc("score"), F.desc("item_id")]
    people, kept, done = chosen, None, []
    start, size = 0, item_tile
    while True:
        stop = min(start + size, n_items)
        block = placed.filter((F.col("place") > start) & (F.col("place") <= stop)) if n_items > item_tile else placed
        block = block.withColumn("item_part", F.floor((F.col("place") - 1 - start) / item_tile).cast("int"))
        theirs = rated if start == 0 else join_lookup(rated, people.select(F.col("id").alias("user_id")), "user_id")
        theirs = pin(join_lookup(theirs, block.select(F.col("id").alias("item_id"), "item_part"), "item_id"), "rated")
        found = _by_tiles(people, block, stop - start, rank, theirs, k, low, high, shape, user_tile, item_tile, broadcast_bytes)
        ranked = top_k(found if kept is None else found.unionByName(kept), "user_id", order, k)
        if stop >= n_items:
            break
        ranked = pin(ranked, "best")
        # Only users for whom a later item could still be among the best go on.
        longest = placed.filter(F.col("place") == stop + 1).first()["length"]
        people = pin(_open_users(people, ranked, shape, longest, k, low), "open")
        if people.isEmpty():
            break
        ids = people.select(F.col("id").alias("user_id"))
        done.append(ranked.join(ids, "user_id", "left_anti"))
        kept = ranked.join(ids, "user_id", "left_semi").drop("rank")
        start, size = stop, size * ROUND_GROWTH
    return union_all([ranked, *done]).select(
        F.col("user_id").cast("bigint"), F.col("item_id").cast("bigint"),
        F.col("score").cast("double"), "rank",
    )


def _matrix(batch: pa.RecordBatch, rank: int) -> np.ndarray:
    return np.asarray(batch["features"].flatten(), "f4").reshape(-1, rank)


def shape_of(vectors: DataFrame, rank: int) -> Shape:
    """Centre and spread of (id, features) vectors; their sums are added up by Spark, ``rank`` squared numbers at a time."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, farthest = np.zeros((rank + 1, rank + 1)), 0.0
        for batch in batches:
            given = _matrix(batch, rank).astype("f8")
            size = np.linalg.norm(given, axis=1)
            farthest = max(farthest, np.where(np.isfinite(size), size, np.inf).max(initial=0.0))
            given = np.column_stack([np.ones(len(given)), given])[np.isfinite(size)]
            total += given.T @ given
        cells = np.append(total.ravel(), farthest)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], names=["cell", "value"])

    cells = vectors.select("features").mapInArrow(sums, "cell int, value double").groupBy("cell").agg(
        F.sum("value").alias("total"), F.max("value").alias("most")).collect()
    # Without vectors there are no cells.
    total = np.zeros((rank + 1) ** 2 + 1)
    for row in cells:
        total[row["cell"]] = row["most"] if row["cell"] == len(total) - 1 else row["total"]
    square = total[:-1].reshape(rank + 1, rank + 1)
    return Shape.of(square[0, 0], square[0, 1:], square[1:, 1:], total[-1])


def _by_length(vectors: DataFrame, shape: Shape) -> DataFrame:
    """(id, features, length, place): vectors numbered by falling length."""
    rank = len(shape.centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], batch["features"], pa.array(shape.lengths(_matrix(batch, rank)))],
                                             names=["id", "features", "length"])

    given = vectors.select(F.col("id").cast("int").alias("id"), F.col("features").cast("array<float>").alias("features"))
    return pin(number_rows(given.mapInArrow(run, "id int, features array<float>, length double"), [F.desc("length"), "id"], name="place"), "items")


def _open_users(people: DataFrame, ranked: DataFrame, shape: Shape, longest: float, k: int, low: float) -> DataFrame:
    """(id, features, edge): users whose ``k``-th best score an item of at most the length ``longest`` could reach."""
    rank = len(shape.centre)
    edges = ranked.groupBy(F.col("user_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("edge"))
    given = people.select("id", F.col("features").cast("array<float>").alias("features")).join(edges, "id", "left")
    given = given.withColumn("edge", F.coalesce("edge", F.lit(-math.inf).cast("float")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, reach = shape.users(_matrix(batch, rank))
            with np.errstate(invalid="ignore"):
                stays = ~(base + reach * longest < np.maximum(np.asarray(batch["edge"]), low))
            yield batch.filter(pa.array(stays))

    return given.mapInArrow(run, "id int, features array<float>, edge float")


def _by_tiles(
    people: DataFrame, block: DataFrame, n_items: int, rank: int, rated: DataFrame, k: int, low: float, high: float, shape: Shape,
    user_tile: int, item_tile: int, broadcast_bytes: int,
) -> DataFrame:
    """Best ``k`` of each user among the items of each tile; ``block`` and ``rated`` name the items' tile."""
    slots = people.sparkSession.sparkContext.defaultParallelism
    user_parts, item_parts = tiling(people.count(), n_items, rated.count(), slots, user_tile, item_tile)
    tiles = ["user_part", "item_part"]
    width = min(user_parts * item_parts, MOST_TASKS)

    def part_of(column: str, parts: int):
        return F.pmod(F.xxhash64(F.col(column).cast("int")), F.lit(parts)).cast("int")

    def packed(factors: DataFrame, part: Column, side: str, more: Sequence[str] = ()) -> DataFrame:
        rows = F.collect_list(F.struct("id", "features", *more))
        return (
            factors.groupBy(part.alias(f"{side}_part")).agg(rows.alias("rows"))
            .select(f"{side}_part", F.col("rows.id").alias(f"{side}_ids"),
                    F.flatten("rows.features").alias(f"{side}_factors"), *[F.col(f"rows.{c}").alias(f"{side}_{c}s") for c in more])
        )

    def numbers(count: int):
        return F.sequence(F.lit(0), F.lit(count - 1))

    more = ["edge"] if "edge" in people.columns else []
    left = packed(people, part_of("id", user_parts), "user", more).withColumn("item_part", F.explode(numbers(item_parts)))
    left = left.repartition(width, *tiles)
    right = packed(block, F.col("item_part"), "item")
    if n_items * 4 * (rank + 1) <= broadcast_bytes:
        work = left.join(F.broadcast(right), "item_part")
    else:
        fan = math.isqrt(user_parts - 1) + 1
        copies = right.withColumn("fan", F.explode(numbers(fan))).repartition("item_part", "fan")
        mine = F.filter(numbers(user_parts), lambda n: F.pmod(n, F.lit(fan)) == F.col("fan"))
        copies = copies.withColumn("user_part", F.explode(mine)).drop("fan").repartition(width, *tiles)
        work = left.join(copies, tiles)
    rated = rated.distinct().withColumn("user_part", part_of("user_id", user_parts)).repartition(width, *tiles)

    def best(tile: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        return best_of_tile(tile, seen, k, low, high, shape)

    return work.groupBy(*tiles).cogroup(rated.groupBy(*tiles)).applyInPandas(best, "user_id int, item_id int, score float")


def recs_as_arrays(recs: DataFrame) -> DataFrame:
    """One row per user with its items in rank order."""
    by_rank = F.array_sort(F.collect_list(F.struct("rank", "item_id")))
    return recs.groupBy("user_id").agg(F.transform(by_rank, lambda r: r["item_id"]).alias("products"))
