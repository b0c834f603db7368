import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillrank.operators import evaluate, impute, joins, ordered, splits

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(4)


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds a third of the rows."""
    rng = random.Random(3)
    rows = [(0 if n % 3 == 0 else rng.randrange(1, 40), rng.randrange(50), n) for n in range(3000)]
    return rows, frame(spark, rows, "g int, v int, id int").cache()


def test_numbers_are_consecutive_in_order(skewed):
    rows, df = skewed
    got = {r.id: r.rn for r in ordered.number_rows(df, ["v", "id"], start=5).collect()}
    want = {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])), 5)}
    assert got == want


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_numbers_per_group_do_not_depend_on_the_way(skewed, limit):
    rows, df = skewed
    out = ordered.number_rows(df, [F.desc("v"), F.desc("id")], ["g"], "rank", group_limit=limit)
    seen, want = {}, {}
    for g, v, n in sorted(rows, key=lambda r: (-r[1], -r[2])):
        seen[g] = seen.get(g, 0) + 1
        want[n] = seen[g]
    assert {r.id: r["rank"] for r in out.collect()} == want


def test_running_sums_before_each_row(skewed):
    rows, df = skewed
    out = ordered.running_before(df, ["v", "id"], {"before": F.col("v").cast("bigint")}, ["g"])
    sums, want = {}, {}
    for g, v, n in sorted(rows, key=lambda r: (r[1], r[2])):
        want[n] = sums.get(g, 0)
        sums[g] = want[n] + v
    assert {r.id: r.before for r in out.collect()} == want


def test_null_groups_are_numbered_too(spark):
    df = frame(spark, [(None, n) for n in range(20)] + [(1, n) for n in range(5)], "g int, v int")
    out = ordered.number_rows(df, ["v"], ["g"], group_limit=3).collect()
    assert sorted(r.rn for r in out if r.g is None) == list(range(1, 21))


@pytest.mark.parametrize("block", [7, 100_000])
def test_adjacent_repeats(spark, block):
    rng = random.Random(1)
    rows = [(n, rng.choice([None, 1, 1, 1, 2])) for n in range(200)]
    out = ordered.drop_adjacent_repeats(frame(spark, rows, "n int, k int"), "k", ["n"], block)
    want = [n for n, k in rows if n == 0 or rows[n - 1][1] != k]
    assert sorted(r.n for r in out.collect()) == want


def test_first_rows_large_and_small_agree(skewed):
    _, df = skewed
    small = ordered.first_rows(df, 500, ["v", "id"]).collect()
    large = ordered.first_rows(df, 500, ["v", "id"], in_memory=10).collect()
    assert sorted(small) == sorted(large) and len(small) == 500


def test_shuffle_is_a_repeatable_permutation(spark):
    df = spark.range(200)
    one = {r.id: r.rn for r in ordered.shuffle_rows(df, "id", 1).collect()}
    again = {r.id: r.rn for r in ordered.shuffle_rows(df.repartition(3), "id", 1).collect()}
    other = {r.id: r.rn for r in ordered.shuffle_rows(df, "id", 2).collect()}
    assert one == again != other
    assert sorted(one.values()) == list(range(1, 201))


@given(st.lists(st.one_of(st.none(), st.integers(-20, 20)), min_size=1, max_size=30))
@FEW
def test_median_and_mode(spark, values):
    df = spark.createDataFrame([(v, None if v is None else str(v)) for v in values], "a int, b string")
    known = sorted(v for v in values if v is not None)
    median = impute.exact_median(df, ["a"]).first()[0]
    mode = impute.exact_mode(df, ["b"]).first()[0]
    if not known:
        assert median is None and mode is None
        return
    assert median == (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2
    assert mode == min((str(v) for v in known), key=lambda t: (-[str(x) for x in known].count(t), t))


def test_impute_fills_only_gaps(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "a"), (2, None, "b"), (3, float("nan"), None), (4, 4.0, "b")], "id int, x double, t string")
    assert {tuple(r) for r in impute.impute(df).collect()} == {
        (1, 1.0, "a"), (2, 2.5, "b"), (3, 2.5, "b"), (4, 4.0, "b")}


@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=40))
@FEW
def test_auc_counts_pairs(spark, rows):
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    if not pos or not neg:
        return
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame([(y, float(s)) for y, s in rows], "y int, s double")
    auc = evaluate.auc(df, "y", "s").first()[0]
    assert auc == pytest.approx(want)
    flipped = evaluate.auc(df.withColumn("y", 1 - F.col("y")), "y", "s").first()[0]
    assert flipped == pytest.approx(1 - auc)


def test_exact_split_sorts_few_rows(spark, monkeypatch):
    rows = [(k, n) for n, k in enumerate([*map(str, range(300)), *["hot"] * 40, None, None])]
    df = spark.createDataFrame(rows, "k string, n long")
    numbered = ordered.shuffle_rows(df, "k", 5, name="rn").collect()
    sizes, plain = [], ordered.shuffle_rows
    monkeypatch.setattr(splits, "shuffle_rows", lambda d, *a, **k: (sizes.append(d.count()), plain(d, *a, **k))[1])
    hot = min(r.rn for r in numbered if r.k == "hot")
    for take in (0, 1, hot + 7, 342):
        got = {r.n: r.split for r in splits.exact_split(df, "k", take / 342, 5).collect()}
        assert got == {r.n: "train" if r.rn <= take else "test" for r in numbered}
    assert max(sizes) <= 42
    assert splits.exact_split(df.limit(0), "k", 0.5).collect() == []


def test_splits_are_disjoint_complete_and_exact(spark):
    df = spark.range(1000)
    train, test = splits.random_split(df, "id", 0.8)
    assert train.count() + test.count() == 1000
    assert train.join(test, "id").count() == 0
    exact = {r.split: r["rows"] for r in splits.part_sizes(splits.exact_split(df, "id", 0.333)).collect()}
    assert exact == {"train": 333, "test": 667}
    three = {r.split for r in splits.three_way(df, "id").collect()}
    assert three == {"train", "validation", "test"}
    chunks = splits.chunk_rows(df, ["id"], 7).groupBy("chunk").count().collect()
    assert sorted(r["count"] for r in chunks) == sorted([143] * 6 + [142])


def test_broadcast_needs_few_rows_and_little_text(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 50).alias("t"))
    assert joins.fits_broadcast(df) and joins.fits_broadcast(df.filter("id < 0"))
    assert not joins.fits_broadcast(df, rows=99)
    assert not joins.fits_broadcast(df, text_bytes=4_999)
    assert not joins.fits_broadcast(df.withColumn("a", F.array("id")))


@pytest.mark.parametrize("rows", [0, 1_000_000])
def test_lookup_join_is_the_same_with_hot_keys_split_off(spark, rows):
    fact = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 31 == 0, None).otherwise(F.col("id") % 50)
        .alias("k"), "id")
    lookup = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        for hot_rows in (100, joins.HOT_ROWS):
            found = joins.join_lookup(fact, lookup, "k", how, rows, hot_rows)
            assert set(found.columns) == {"id", "k", "v"}
            got = found.select("id", "k", "v").collect()
            assert sorted(map(str, got)) == sorted(map(str, fact.join(lookup, "k", how).select("id", "k", "v").collect()))
    assert {tuple(r) for r in joins.hot_keys(fact, "k", 100).collect()} == {(7, 11)}


def test_numbers_of_tied_rows_repeat(spark):
    df = spark.range(4000).select((F.col("id") % 3).alias("g"), "id")
    first, second = (ordered.number_rows(df.repartition(n), ["g"]) for n in (3, 11))
    assert sorted(first.collect()) == sorted(second.collect())
    assert [r.rn for r in first.orderBy("rn").collect()] == list(range(1, 4001))


def test_two_phase_top_k_equals_one_phase(skewed):
    _, df = skewed
    order = [F.desc("v"), F.desc("id")]
    tiles = [df.filter(F.pmod("id", F.lit(3)) == n) for n in range(3)]
    once = joins.top_k(df, "g", order, 4).collect()
    assert sorted(joins.top_k_merge(tiles, "g", order, 4).collect()) == sorted(once)
    assert sorted(joins.top_k_tiled(df, F.pmod("id", F.lit(3)), "g", order, 4).collect()) == sorted(once)


def test_top_k_beyond_the_partial_limit(skewed):
    _, df = skewed
    out = joins.top_k(df, "g", [F.desc("v"), F.desc("id")], joins.PARTIAL_LIMIT + 1).filter("g = 0")
    assert out.count() == 1000


def test_anti_join_and_rated_make_up_all_pairs(spark):
    users, items = spark.range(20).toDF("user_id"), spark.range(15).toDF("item_id")
    pairs = users.crossJoin(items)
    rated = pairs.filter((F.col("user_id") * 7 + F.col("item_id")) % 4 == 0)
    unseen = joins.drop_known(pairs, rated, ["user_id", "item_id"])
    assert sorted(unseen.unionByName(rated).collect()) == sorted(pairs.collect())
    assert unseen.join(rated, ["user_id", "item_id"]).count() == 0


def test_last_write_wins(spark):
    df = spark.createDataFrame([(1, 1, 1, 5), (1, 1, 2, 3), (1, 2, 1, 4)], "u int, i int, at int, r int")
    got = joins.latest(df, ["u", "i"], ["at"], ["r"]).collect()
    assert {tuple(r) for r in got} == {(1, 1, 3), (1, 2, 4)}
