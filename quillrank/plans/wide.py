"""Wide anonymous table: every value is a number or a category by its own content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions import metrics, text
from quillrank.operators import learn
from quillrank.operators.learn import RunResult
from quillrank.sources import readers, writers


def examples(lines: DataFrame, labeled: bool = True, line: str = "line") -> DataFrame:
    """Lines as examples: group ``i`` of numbers and ``c`` of indicators, named by their column."""
    parsed = readers.parse_wide(lines, line, labeled)
    fields = F.col("fields")

    def number(value, position):
        as_number = text.number_or_null(value)
        made = F.struct(F.concat(F.lit("i"), position.cast("string")).alias("name"), as_number.alias("value"))
        return F.when(as_number.isNotNull(), made)

    def category(value, position):
        name = F.concat(F.lit("c_"), position.cast("string"), F.lit("_"), value)
        made = F.struct(name.alias("name"), F.lit(1.0).alias("value"))
        return F.when(text.category_or_null(value).isNotNull(), made)

    groups = {
        "i": F.array_compact(F.transform(fields, number)),
        "c": F.array_compact(F.transform(fields, category)),
    }
    return learn.featurize(parsed, groups, F.col("label") if labeled else None, keep=["id"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Data lines of a headed file; the header is the line that starts with the name of the id column."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return lines.filter(~F.upper(F.translate("line", '"', "")).startswith("ID,"))


def playground(lines: DataFrame, passes: int = 10, bits: int = 18) -> RunResult:
    """Hold out a fifth of the labelled lines and score it."""
    spec = learn.logistic_regression("wide", passes=passes, bits=bits)
    return learn.run(spec, examples(lines), key="id",
                     metric=metrics.log_loss(F.col("label"), F.col("score")))


def submit(spark: SparkSession, train_path: str, test_path: str, out_path: str, passes: int = 10,
           bits: int = 18) -> DataFrame:
    """Train on one file, score another, write ``"ID","target"``."""
    spec = learn.logistic_regression("wide", passes=passes, bits=bits)
    train = examples(read_lines(spark, train_path))
    test = examples(read_lines(spark, test_path), labeled=False)
    result = learn.run(spec, train, test, key="id")
    rows = writers.submission(result.scored, "id", "score", ("ID", "target"))
    writers.write_submission(rows, out_path, quoted_header=True)
    return rows
