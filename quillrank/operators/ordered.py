"""Row numbers and running totals over one global order, without a one-task window.

The frame is range-sorted once, every row gets (run, position) from the sorted
partitions, and that table is pinned. A run is one sorted partition. What is
carried from earlier runs is a table of at most one row per run, because a range
sort lets at most one group reach over each run border; that table is broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.session import pin

RUN, POS = "__run", "__pos"
_SEQ, _CARRY = "__seq", "__carry_"

# monotonically_increasing_id keeps the partition number above bit 33.
_SHIFT = 33

# Above this many rows in one group a plain window would load one task too much.
GROUP_LIMIT = 1_000_000

Order = Sequence[Column | str]


def sorted_runs(df: DataFrame, order: Order) -> DataFrame:
    """``df`` range-sorted by ``order`` with the run number and position in the run, pinned."""
    # Rows that tie in ``order`` are sorted by their content, so that numbers repeat and ties are not one partition.
    content = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    ordered = df.orderBy(*order, F.xxhash64(*content)).withColumn(_SEQ, F.monotonically_increasing_id())
    seq = F.col(_SEQ)
    return pin(
        ordered.withColumns(
            {
                RUN: F.shiftright(seq, _SHIFT).cast("int"),
                POS: seq.bitwiseAND(F.lit((1 << _SHIFT) - 1)),
            }
        ).drop(_SEQ),
        "runs",
    )


def _carried(runs: DataFrame, within: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Per run, what its first group already holds in earlier runs (at most one row per run)."""
    per_run = runs.groupBy(RUN, *within).agg(
        *[F.sum(c).alias(_CARRY + n) for n, c in sums.items()], F.count(F.lit(1)).alias(_CARRY)
    )
    earlier = Window.partitionBy(*within).orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
    columns = [F.sum(_CARRY + n).over(earlier).alias(_CARRY + n) for n in sums]
    seen = F.sum(_CARRY).over(earlier).alias(_CARRY)
    return per_run.select(RUN, *within, *columns, seen).filter(F.col(_CARRY) > 0).drop(_CARRY)


def _join_carried(runs: DataFrame, carried: DataFrame, within: Sequence[str]) -> DataFrame:
    keys = [RUN, *within]
    carried = F.broadcast(carried.select(*[F.col(k).alias(f"c_{k}") for k in keys],
                                         *[c for c in carried.columns if c not in keys]))
    same = [F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in within]
    condition = F.col(RUN) == F.col(f"c_{RUN}")
    for part in same:
        condition = condition & part
    return runs.join(carried, condition, "left").drop(*[f"c_{k}" for k in keys])


def number_rows(
    df: DataFrame, order: Order, within: Sequence[str] = (), name: str = "rn", start: int = 1,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Consecutive numbers from ``start`` in ``order``, over the frame or inside each group.

    A group of checked size uses a plain window (one shuffle). Otherwise, and
    always without groups, the numbers come from sorted runs.
    """
    if within and _largest_group(df, within) <= group_limit:
        window = Window.partitionBy(*within).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window).cast("bigint") + F.lit(start - 1))
    runs = sorted_runs(df, [*within, *order])
    if within:
        local = F.row_number().over(Window.partitionBy(RUN, *within).orderBy(POS)).cast("bigint")
    else:
        local = F.col(POS) + 1
    carried = _carried(runs, within, {"rows": F.lit(1).cast("bigint")})
    numbered = _join_carried(runs.withColumn(name, local), carried, within)
    total = F.col(name) + F.coalesce(F.col(_CARRY + "rows"), F.lit(0)) + F.lit(start - 1)
    return numbered.withColumn(name, total.cast("bigint")).drop(RUN, POS, _CARRY + "rows")


def _largest_group(df: DataFrame, within: Sequence[str]) -> int:
    return df.groupBy(*within).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def running_before(
    df: DataFrame, order: Order, sums: Mapping[str, Column], within: Sequence[str] = ()
) -> DataFrame:
    """For every row the sums over the rows strictly before it in ``order`` (0 for the first)."""
    values = {f"__v_{n}": c for n, c in sums.items()}
    runs = sorted_runs(df.withColumns(values), [*within, *order])
    before = Window.partitionBy(RUN, *within).orderBy(POS).rowsBetween(Window.unboundedPreceding, -1)
    carried = _carried(runs, within, {n: F.col(f"__v_{n}") for n in sums})
    local = runs.withColumns({n: F.sum(f"__v_{n}").over(before) for n in sums})
    joined = _join_carried(local, carried, within)
    zero = F.lit(0)
    total = {n: F.coalesce(F.col(n), zero) + F.coalesce(F.col(_CARRY + n), zero) for n in sums}
    return joined.withColumns(total).drop(RUN, POS, *values, *[_CARRY + n for n in sums])


def first_rows(df: DataFrame, n: int, order: Order, in_memory: int = 1_000) -> DataFrame:
    """The first ``n`` rows in ``order``.

    A small ``n`` is a per-partition top-n merged once. A large one (a sample of
    a million lines) would bring ``n`` rows of every partition into one task, so
    it is cut by row number.
    """
    if n <= in_memory:
        return df.orderBy(*order).limit(n)
    return number_rows(df, order, name="__rn").filter(F.col("__rn") <= n).drop("__rn")


def shuffle_rows(df: DataFrame, key: str | Column, seed: int = 0, name: str = "rn") -> DataFrame:
    """A repeatable random order: rows numbered by the md5 of key and seed."""
    key = F.col(key) if isinstance(key, str) else key
    keyed = df.withColumn("__shuffle", seeded_hash(key, seed)).withColumn("__key", key)
    return number_rows(keyed, ["__shuffle", "__key"], name=name).drop("__shuffle", "__key")


def seeded_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def drop_adjacent_repeats(df: DataFrame, key: str, order: Order, block: int = 100_000) -> DataFrame:
    """Keep a row when ``key`` differs from the row just before it in ``order``.

    Rows are numbered once and cut into blocks of ``block`` rows; the last row
    of each block is also sent to the next block, so a lag inside the block is
    enough and no task sees more than ``block`` + 1 rows.
    """
    numbered = number_rows(df, order, name="__n", start=0)
    home = F.floor(F.col("__n") / block).cast("bigint")
    blocks = F.when(F.col("__n") % block == block - 1, F.array(home, home + 1)).otherwise(F.array(home))
    spread = numbered.withColumn("__home", home).withColumn("__block", F.explode(blocks))
    window = Window.partitionBy("__block").orderBy("__n")
    changed = (F.col("__n") == 0) | ~F.col(key).eqNullSafe(F.lag(key).over(window))
    return (
        spread.withColumn("__changed", changed)
        .filter(F.col("__changed") & (F.col("__block") == F.col("__home")))
        .drop("__n", "__home", "__block", "__changed")
    )
