"""Whole jobs from input files to output files, on small hand-made inputs."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillrank.operators import learn
from quillrank.plans import clicks, passengers, ratings, tournament, wide
from quillrank.sources import readers, writers

# Invented people. The header has the fixed column names of the files that the job reads.
PASSENGERS = "\r\n".join([
    'PassengerId,Survived,Pclass,Name,Sex,Age,SibSp,Parch,Ticket,Fare,Cabin,Embarked',
    '1,0,3,"Oduya, Mr. Tomas ""Tom""",male,22.5,0,0,T-1001,5.25,,Q',
    '2,1,1,"Brandvold, the Countess. of Ness (Ida, Nee Q)",female,61,1,0,T-1002,88,Z9,S',
    '3,1,2,"Ferreol, Mme. Zoe",female,,0,2,X/9 40000,14.75,,',
]) + "\r\n"


def text_of(folder):
    return [line for f in sorted(Path(folder).glob("part-*")) for line in f.read_text().splitlines()]


def test_quoted_table_with_blanks_and_crlf(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text(PASSENGERS, newline="")
    rows = readers.read_table(spark, str(path), schema=passengers.SCHEMA).orderBy("passenger_id").collect()
    assert rows[0].name == 'Oduya, Mr. Tomas "Tom"' and rows[0].age == 22.5 and rows[0].cabin is None
    assert rows[2].age is None and rows[2].embarked is None
    assert rows[1].embarked == "S"
    lines = [r[0] for r in readers.read_table(spark, str(path), schema=passengers.SCHEMA)
             .orderBy("passenger_id").select(passengers.text_example()).collect()]
    assert lines[0] == ("-1 '1 |f passenger_class_3 last_name_oduya title_mr sex_male age:22.5 "
                        "siblings_onboard:0 family_members_onboard:0 embarked_Q")
    assert lines[1].startswith("1 '2 |f passenger_class_1 last_name_brandvold title_the sex_female age:61 ")
    assert "age" not in lines[2].split("sex_female")[1].split("siblings")[0]
    groups = passengers.examples(readers.read_table(spark, str(path), schema=passengers.SCHEMA))
    names = {r.passenger_id: {f.name for f in r.f} for r in groups.collect()}
    assert "age" not in names[1] and "age" in names[2] and "title_Mme" in names[3]


def test_sparse_text_round_trip(spark):
    lines = ["1 'a |f x:2.5 y |g z", "-1 |u 7 |i 9", "|u 4", "3.5 | p q:0"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(lines)], "n int, value string")
    parsed = readers.explode_features(readers.parse_sparse_text(df)).collect()
    got = {(r.n, r.label, r.tag, r.ns, r.name, r.value) for r in parsed}
    assert got == {
        (0, 1.0, "a", "f", "x", 2.5), (0, 1.0, "a", "f", "y", 1.0), (0, 1.0, "a", "g", "z", 1.0),
        (1, -1.0, None, "u", "7", 1.0), (1, -1.0, None, "i", "9", 1.0), (2, None, None, "u", "4", 1.0),
        (3, 3.5, None, "", "p", 1.0), (3, 3.5, None, "", "q", 0.0)}


def test_wide_lines_by_content(spark):
    df = spark.createDataFrame([('12,true,"a: B c",-3.5,1-2,,0',)], "line string")
    row = readers.parse_wide(df).first()
    assert (row.id, row.label, row.fields) == ("12", 0, ["1", "abc", "-3.5", "1-2", ""])
    made = wide.examples(df).first()
    assert {(f.name, f.value) for f in made.i} == {("i0", 1.0), ("i2", -3.5)}
    assert {f.name for f in made.c} == {"c_1_abc", "c_3_1-2", "c_4_"}


def make_clicks(path, n, labeled, rng):
    lines = []
    for k in range(n):
        cat = rng.choice(["red", "blue", ""])
        label = int(cat == "red") if rng.random() < 0.9 else rng.randrange(2)
        numbers = ["" if rng.random() < 0.2 else str(rng.randrange(9)) for _ in range(13)]
        lines.append("\t".join(([str(label)] if labeled else []) + numbers + [cat, f"k{k % 5}"]))
    path.write_text("\n".join(lines) + "\n")
    return lines


def test_click_job(spark, tmp_path):
    rng = random.Random(1)
    make_clicks(tmp_path / "train.txt", 600, True, rng)
    test = make_clicks(tmp_path / "test.txt", 50, False, rng)
    clicks.submit(spark, str(tmp_path / "train.txt"), str(tmp_path / "test.txt"), str(tmp_path / "out"), bits=12)
    lines = text_of(tmp_path / "out")
    assert lines[0] == "Id,Predicted"
    rows = dict(line.split(",") for line in lines if line != "Id,Predicted")
    assert sorted(map(int, rows)) == list(range(clicks.FIRST_ID, clicks.FIRST_ID + 50))
    red = [float(rows[str(clicks.FIRST_ID + n)]) for n, t in enumerate(test) if "red" in t.split("\t")]
    rest = [float(rows[str(clicks.FIRST_ID + n)]) for n, t in enumerate(test) if "red" not in t.split("\t")]
    assert min(red) > max(rest)
    made = clicks.examples(readers.read_clicks(spark, str(tmp_path / "train.txt"))).first()
    assert set(made.asDict()) == {"i", "c", "label"}


def test_tournament_job(spark, tmp_path):
    rng = random.Random(2)
    names = ",".join(f"feature{n}" for n in range(1, 22))
    rows = [[round(rng.random(), 3) for _ in range(21)] for _ in range(300)]
    body = [",".join(map(str, r)) + f",{int(r[0] > 0.5)}" for r in rows]
    (tmp_path / "train.csv").write_text(f"{names},target\n" + "\n".join(body) + "\n")
    tests = [f"t{n}," + ",".join(map(str, r)) for n, r in enumerate(rows[:20])]
    (tmp_path / "test.csv").write_text(f"t_id,{names}\n" + "\n".join(tests) + "\n")
    tournament.submit(spark, str(tmp_path / "train.csv"), str(tmp_path / "test.csv"), str(tmp_path / "out"), 30)
    lines = text_of(tmp_path / "out")
    assert lines[0] == '"t_id","probability"'
    got = {k: float(v) for k, v in (line.split(",") for line in lines if "probability" not in line)}
    assert len(got) == 20
    hits = [(got[f"t{n}"] > 0.5) == (rows[n][0] > 0.5) for n in range(20)]
    assert sum(hits) >= 18


def test_wide_job(spark, tmp_path):
    rng = random.Random(3)
    made = [(n, rng.choice(["true", "false"]), rng.choice(['"x y"', "NA"]), rng.randrange(100)) for n in range(300)]
    line = lambda r: f"{r[0]},{r[1]},{r[2]},-{r[3]}.5"
    (tmp_path / "train.csv").write_text('"ID","V1","V2","V3","target"\n' + "\n".join(
        f"{line(r)},{int(r[1] == 'true')}" for r in made) + "\n")
    (tmp_path / "test.csv").write_text('"ID","V1","V2","V3"\n' + "\n".join(map(line, made[:30])) + "\n")
    wide.submit(spark, str(tmp_path / "train.csv"), str(tmp_path / "test.csv"), str(tmp_path / "out"), bits=10)
    lines = text_of(tmp_path / "out")
    assert lines[0] == '"ID","target"'
    got = {int(k): float(v) for k, v in (t.split(",") for t in lines if "target" not in t)}
    assert len(got) == 30 and all((got[r[0]] > 0.5) == (r[1] == "true") for r in made[:30])


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(4)
    rows = []
    for n in range(500):
        sex = rng.choice(["male", "female"])
        lived = int(sex == "female") if rng.random() < 0.85 else rng.randrange(2)
        age = None if rng.random() < 0.2 else float(rng.randrange(1, 70))
        title = "Mr" if sex == "male" else rng.choice(["Mrs", "Lady"])
        rows.append((n, lived, rng.randrange(1, 4), f"Last{n % 30}, {title}. First", sex, age, rng.randrange(3),
                     rng.randrange(3), "t", rng.random() * 50, None, rng.choice(["S", "C", "Q", None])))
    return spark.createDataFrame(rows, passengers.SCHEMA).repartition(3).cache()


def test_passenger_models(people):
    assert passengers.fit_indexed(people).auc > 0.8
    assert passengers.fit_dummies(people, iterations=10).auc > 0.8
    assert passengers.fit_trees(people, rounds=5).auc > 0.8
    table = passengers.dummied(people)
    assert {"embarked_S", "title_Sir", "title_Mrs", "sex"} <= set(table.columns) and "name" not in table.columns
    assert table.filter(F.col("age").isNull()).count() == 0


def test_passenger_decisions(people):
    train, test = people.filter("passenger_id < 400"), people.filter("passenger_id >= 400")
    rows = passengers.survivors(train, test.drop("survived"))
    assert rows.columns == ["PassengerId", "Survived"]
    got = {r.PassengerId: r.Survived for r in rows.collect()}
    sexes = {r.passenger_id: r.sex for r in test.collect()}
    assert len(got) == 100
    assert sum(got[k] == int(sexes[k] == "female") for k in got) > 75


@pytest.fixture(scope="module")
def rating_rows():
    rng = random.Random(6)
    return [(u, i, 1 + (u * i + u) % 5, 0) for u in range(40) for i in range(30) if rng.random() < 0.5]


def test_rating_job(spark, tmp_path, rating_rows):
    path = tmp_path / "ratings.dat"
    path.write_text("".join("::".join(map(str, r)) + "\n" for r in rating_rows))
    whole = ratings.rate(spark, str(path), str(tmp_path / "results"))
    assert whole.rmse > 0 and 0 < whole.scored + whole.dropped < len(rating_rows)
    spec = learn.als(passes=5, rank=[2, 3])
    ratings.rate(spark, str(path), str(tmp_path / "results"), spec, num_ratings=400, title="searched")
    log = {r.run: r for r in spark.read.parquet(str(tmp_path / "results")).collect()}
    assert log["ratings"]["rows"] == len(rating_rows) and log["searched"]["rows"] == 400
    assert log["ratings"].us_per_row == pytest.approx(log["ratings"].secs * 1e6 / len(rating_rows))


def test_recommendation_job(spark, tmp_path, rating_rows):
    path = tmp_path / "ratings.csv"
    path.write_text("userId,movieId,rating,timestamp\n" + "".join(f"{u},{i},{r}.0,0\n" for u, i, r, _ in rating_rows))
    for mode in ("random", "in_order"):
        result = ratings.recommend_all(spark, str(path), str(tmp_path / "recs"), k=10, rank=4, iterations=5,
                                       mode=mode, score_range=None)
        assert result.rmse > 0
    alone = ratings.recommend_all(spark, str(path), str(tmp_path / "none"), rank=4, iterations=5, mode="in_order", evaluate_only=True)
    assert alone.rmse == pytest.approx(result.rmse, rel=1e-3) and not (tmp_path / "none").exists()
    with pytest.raises(ValueError):
        ratings.recommend_all(spark, str(path), str(tmp_path / "none"), evaluate_only=True)
    records = [json.loads(t) for t in text_of(tmp_path / "recs")]
    seen = {(u, i) for u, i, _, _ in rating_rows}
    assert len(records) == 40
    for record in records:
        assert set(record) == {"user", "products"} and 0 < len(record["products"]) <= 10
        assert not any((record["user"], i) in seen for i in record["products"])


def test_files_keep_their_order(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, start in (("b.csv", 500), ("a.csv", 0)):
        (tmp_path / "a" / name).write_text("".join(f"{n}::1::1::0\n" for n in range(start, start + 500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = readers.with_file_order(readers.read_ratings(spark, str(tmp_path / "a")))
        got = [r.user_id for r in rows.orderBy(*readers.FILE_ORDER).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(range(1000))


def test_command_line(spark, tmp_path, people):
    from quillrank.__main__ import main, parser

    people.write.csv(str(tmp_path / "people"), header=True)
    main(["passengers", "--train", str(tmp_path / "people"), "--results", str(tmp_path / "log"), "--model", "indexed"])
    assert spark.read.parquet(str(tmp_path / "log")).first().run == "passengers indexed"
    assert parser().parse_args(["recommend", "--input", "a", "--output", "b"]).k == 10


def test_run_records_append(spark, tmp_path):
    for n in range(2):
        writers.append_metrics(writers.run_record(spark, f"r{n}", "auc", 0.5, 2.0, 4), str(tmp_path / "m"))
    rows = spark.read.parquet(str(tmp_path / "m")).collect()
    assert {r.run for r in rows} == {"r0", "r1"} and rows[0].us_per_row == 500_000
