"""Joins whose broadcast sides have a checked size and whose hot keys are split off."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.operators.ordered import first_rows, number_rows
from quillrank.session import pin

# A lookup of at most this many rows and bytes of text is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
BROADCAST_TEXT = 64 << 20

# Rows that one task is to get of one key; a key with more is dealt out to several tasks, at most MOST_COPIES.
HOT_ROWS = 1_000_000
MOST_COPIES = 4_096

# Spark's default spark.sql.optimizer.windowGroupLimitThreshold.
PARTIAL_LIMIT = 1_000


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, text_bytes: int = BROADCAST_TEXT) -> bool:
    """True when ``df`` is flat and small, in rows and in the bytes of its text.

    One aggregate over ``df``; give a scan or a pinned table rather than a long plan.
    """
    if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.UserDefinedType)) for f in df.schema):
        return False
    text = [F.octet_length(f.name) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    size = F.sum(sum((F.coalesce(t, F.lit(0)) for t in text), F.lit(0)).cast("bigint"))
    found = df.agg(F.count(F.lit(1)), size).first()
    return found[0] <= rows and (found[1] or 0) <= text_bytes


def join_lookup(
    fact: DataFrame, lookup: DataFrame, key: str, how: str = "inner", rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join a large frame to a lookup that is unique on ``key`` (inner or left).

    A small lookup is broadcast. With a large one the keys of ``fact`` that hold
    more than ``hot_rows`` rows are found by a pre-aggregated count. Their rows are dealt out by a
    hash of the whole row, and the lookup's row is copied for each share, so that the join
    stays one shuffle in which no task gets a whole hot key. Null keys match nothing and are dealt out too.
    Where ``fact`` is a join itself, give the table it comes from as ``counted``, so that the
    join isn't worked out a second time for that count; it has to hold no fewer rows of any key.
    """
    if fits_broadcast(lookup, rows):
        return fact.join(F.broadcast(lookup), key, how)
    hot = pin(hot_keys(fact if counted is None else counted, key, hot_rows), "hot")
    if hot.isEmpty():
        return fact.filter(F.col(key).isNotNull()).join(lookup, key, how) if how == "inner" else fact.join(lookup, key, how)
    # The hot keys are few: each stands for ``hot_rows`` rows.
    side = F.broadcast(hot) if fits_broadcast(hot, rows) else hot
    share = F.pmod(F.xxhash64(*[c for c in fact.columns if not isinstance(fact.schema[c].dataType, T.MapType)]), F.coalesce("__copies", F.lit(1)))
    many = F.when(F.col(key).isNull(), F.lit(MOST_COPIES)).otherwise(F.col("__copies"))
    dealt = fact.join(side, key, "left").withColumn("__copies", many).withColumn("__share", share.cast("int"))
    copied = lookup.join(side, key, "left").withColumn("__share", F.explode(F.sequence(F.lit(0), F.coalesce("__copies", F.lit(1)) - 1)))
    return dealt.drop("__copies").join(copied.drop("__copies"), [key, "__share"], how).drop("__share")


def hot_keys(df: DataFrame, key: str, rows: int = HOT_ROWS) -> DataFrame:
    """(key, __copies): keys with more than ``rows`` rows and how many tasks are to share them; one pass over ``df``."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > rows)
    return counts.select(key, F.least(F.ceil(F.col("__n") / rows), F.lit(MOST_COPIES)).cast("int").alias("__copies"))


def drop_known(candidates: DataFrame, known: DataFrame, keys: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Candidates whose key is not in ``known`` (left anti join on the whole key).

    With ``tasks`` both sides are dealt out to so many tasks by the key (see :func:`~quillrank.session.tasks_for`).
    """
    known = known.select(*keys)
    if tasks:
        candidates, known = candidates.repartition(tasks, *keys), known.repartition(tasks, *keys)
    return candidates.join(known.distinct(), list(keys), "left_anti")


def known_only(test: DataFrame, train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Test rows for which every key value also occurs in ``train`` (one semi join per key).

    Distinct key values go through :func:`join_lookup`, so one value that holds
    a large share of the test rows does not decide how long the join takes.
    """
    for key in keys:
        test = join_lookup(test, pin(train.select(key).distinct(), "known"), key)
    return test


def except_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct ids of ``left`` that do not occur in ``right``."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


# Numbers of one bitmap of Spark's bitmap functions, and of one long.
BITMAP, WORD = 32_768, 64


def bitmaps(df: DataFrame, group: Sequence[str], number: str) -> DataFrame:
    """(group, block, bits): the numbers (from 1) of each group as bitmaps of ``BITMAP`` numbers."""
    return df.groupBy(*group, F.bitmap_bucket_number(number).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))


def bitmap_words(bits: str, size: int = BITMAP) -> Column:
    """The first ``size`` numbers of a bitmap as longs; number ``n`` from 0 is bit ``(7 - n / 8 % 8) * 8 + n % 8`` of long ``n / 64``."""
    eight = lambda k: F.substring(bits, k * 8 + 1, F.lit(8))
    return F.transform(F.sequence(F.lit(0), F.lit(-(-size // WORD) - 1)), lambda k: F.conv(F.hex(eight(k)), 16, -10).cast("bigint"))


def unseen_items(users: DataFrame, items: DataFrame, seen: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """(user, block, n_unseen, unseen): the items that each user has not seen, by blocks of the items in their order.

    Each of ``users`` has a row a block, also where nothing is left (an empty
    array) and where nothing was seen; ``unseen`` is in item order. Seen items that are
    not among ``items`` and users that are not among ``users`` don't count; null ids are left out.

    Items are numbered, a user's seen items of a block are one bitmap, and the
    difference is taken on its longs, so no array is longer than ``BITMAP``.
    """
    known = items.select(item).where(F.col(item).isNotNull()).distinct()
    numbered = pin(number_rows(known, [item], name="__number"), "items")
    names = numbered.withColumn("block", F.bitmap_bucket_number("__number")).groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("__number", item))).alias("__names"))
    names = pin(names.withColumn("__names", F.transform("__names", lambda n: n[item])), "blocks")
    blocks = names.count()
    wanted = users.select(user).where(F.col(user).isNotNull()).distinct()
    every = wanted.withColumn("block", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(blocks).cast("bigint")))) if blocks else (
        wanted.withColumn("block", F.lit(1).cast("bigint")).limit(0))
    rated = bitmaps(join_lookup(seen.select(user, item), numbered, item), [user], "__number")
    # A block's names are small enough to be sent to all users of it where all blocks are.
    few = numbered.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(item).cast("string")))).first()
    size = max(1, min(BITMAP, few[0]))
    words = every.join(rated, [user, "block"], "left").withColumn(
        "__words", F.when(F.col("bits").isNull(), F.array_repeat(F.lit(0).cast("bigint"), -(-size // WORD))).otherwise(bitmap_words("bits", size)))
    side = F.broadcast(names) if few[0] <= BROADCAST_ROWS and (few[1] or 0) <= BROADCAST_TEXT else names
    joined = words.join(side, "block")
    left = F.filter("__names", lambda name, n: F.bit_get(
        F.bitwise_not(F.get("__words", F.shiftright(n, 6))), (7 - F.shiftright(n, 3) % 8) * 8 + n % 8) == 1)
    return joined.select(user, "block", left.alias("unseen")).select(user, "block", F.size("unseen").cast("bigint").alias("n_unseen"), "unseen")


def attach_by_key(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Put two outputs side by side by a carried key instead of by position."""
    return left.join(right, key if isinstance(key, str) else list(key))


def attach_by_position(
    left: DataFrame, right: DataFrame, left_order: Sequence, right_order: Sequence, name: str = "rn"
) -> DataFrame:
    """Zip two frames that only share their row order: number both, then join on the number."""
    return number_rows(left, left_order, name=name).join(
        number_rows(right, right_order, name=name), name
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per key the values of the last row in ``order`` (last write wins)."""
    newest = F.max_by(F.struct(*values), F.struct(*order)).alias("__last")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"__last.{v}").alias(v) for v in values])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames, matched by column name."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def in_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Keyed rows whose value lies in [low, high]."""
    return df.filter(F.col(column).between(low, high))


def bucket_of(key: str | Column, buckets: int) -> Column:
    """Worker bucket of a key: its modulo, never negative."""
    return F.pmod(F.col(key) if isinstance(key, str) else key, F.lit(buckets))


def drop_nulls(df: DataFrame, used: Sequence[str]) -> DataFrame:
    """Drop rows with a null in a column that is used later."""
    return df.na.drop(subset=list(used))


def valid_errors(df: DataFrame, column: str) -> DataFrame:
    """Rows whose squared error exists and is positive."""
    return df.filter(F.col(column).isNotNull() & ~F.isnan(column) & (F.col(column) > 0))


def top_k(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], k: int, name: str = "rank"
          ) -> DataFrame:
    """The first ``k`` rows of every group.

    Spark keeps at most ``k`` rows per group and input partition before the
    shuffle, so a hot group arrives already reduced. It does so up to
    ``PARTIAL_LIMIT``; a longer list is cut by row number, which splits hot groups.
    """
    group = [group] if isinstance(group, str) else list(group)
    if k > PARTIAL_LIMIT:
        return number_rows(df, order, group, name).filter(F.col(name) <= k)
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(name) <= k).withColumn(name, F.col(name).cast("bigint"))


def top_k_merge(parts: Sequence[DataFrame], group: str, order: Sequence[Column], k: int) -> DataFrame:
    """Top ``k`` of each part, then of the union: the same rows as one top ``k`` over all parts."""
    partial = [top_k(part, group, order, k).drop("rank") for part in parts]
    return top_k(union_all(partial), group, order, k)


def top_k_tiled(df: DataFrame, tile: Column, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """Top ``k`` of each tile and group, then of each group: one pass, and no task sees a whole hot group."""
    partial = top_k(df.withColumn("__tile", tile), ["__tile", group], order, k).drop("rank", "__tile")
    return top_k(partial, group, order, k)


def top_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows overall."""
    return first_rows(df, n, order)
