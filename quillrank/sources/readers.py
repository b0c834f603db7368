"""Delimited, quoted and sparse-text inputs as typed DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.functions.encode import FEATURE
from quillrank.functions.text import booleans_to_digits, plain_value

INTEGER_FIELDS = 13

# Columns that put rows read from files back into file order.
FILE_ORDER = ["file_path", "file_block", "file_place"]


def read_ratings(spark: SparkSession, path: str, sep: str = "::", header: bool = False) -> DataFrame:
    """(user_id, item_id, rating) of a delimited ratings file; the fourth field is never parsed."""
    schema = "user_id bigint, item_id bigint, rating double, rated_at string"
    return spark.read.csv(path, sep=sep, header=header, schema=schema).select(
        "user_id", "item_id", "rating"
    )


def read_table(spark: SparkSession, path: str, header: bool = True, schema: str | T.StructType | None = None,
               sep: str = ",") -> DataFrame:
    """A CSV table with quoted fields; types are given or, failing that, inferred. Blank is null."""
    return spark.read.csv(path, header=header, schema=schema, inferSchema=schema is None, sep=sep,
                          quote='"', escape='"', ignoreTrailingWhiteSpace=False)


def read_clicks(spark: SparkSession, path: str, labeled: bool = True, categories: int | None = None
                ) -> DataFrame:
    """Tab-separated click log: label if ``labeled``, 13 integers ``i0..i12``, then text ``c13..``.

    Unless given, the number of text columns is that of the widest line, found in a
    pass over the file; shorter lines have nulls at their end.
    """
    lead = ["label int"] if labeled else []
    if categories is None:
        tabs = F.length("value") - F.length(F.translate("value", "\t", ""))
        widest = spark.read.text(path).agg(F.max(tabs)).first()[0] or 0
        categories = max(0, widest + 1 - INTEGER_FIELDS - len(lead))
    integers = [f"i{n} int" for n in range(INTEGER_FIELDS)]
    texts = [f"c{n} string" for n in range(INTEGER_FIELDS, INTEGER_FIELDS + categories)]
    return spark.read.csv(path, sep="\t", schema=", ".join([*lead, *integers, *texts]))


def with_file_order(df: DataFrame) -> DataFrame:
    """Add the columns of ``FILE_ORDER`` to a frame just read from text files.

    A file is cut into blocks that are read in any order, but each from its
    start, so (path, block start, running number inside the task) is the order.
    """
    return df.select(
        "*", F.col("_metadata.file_path").alias(FILE_ORDER[0]),
        F.col("_metadata.file_block_start").alias(FILE_ORDER[1]),
    ).withColumn(FILE_ORDER[2], F.monotonically_increasing_id())


def file_key() -> Column:
    """One key per row from the columns of ``FILE_ORDER``."""
    return F.concat_ws("-", *FILE_ORDER)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated ``label prediction`` lines."""
    return spark.read.csv(path, sep=" ", schema="label double, prediction double")


def read_items(spark: SparkSession, path: str, sep: str = "::", header: bool = False) -> DataFrame:
    """Distinct item ids: the first field of an item file."""
    table = spark.read.csv(path, sep=sep, header=header)
    return table.select(F.col(table.columns[0]).cast("bigint").alias("item_id")).distinct()


def items(ratings: DataFrame, column: str = "item_id") -> DataFrame:
    """Distinct item ids of any table."""
    return ratings.select(column).distinct()


def parse_wide(df: DataFrame, line: str | Column = "line", labeled: bool = True) -> DataFrame:
    """One text line to (id, label, fields), the fields cleaned and still text.

    Booleans become digits; quotes, blanks and colons go; letters become small.
    The first field is the id and, in a labelled table, the last one the label.
    """
    line = F.col(line) if isinstance(line, str) else line
    parts = F.split(booleans_to_digits(line), ",")
    cleaned = F.transform(parts, plain_value)
    width = F.size(cleaned) - F.lit(2 if labeled else 1)
    columns = [F.get(cleaned, F.lit(0)).alias("id")]
    if labeled:
        columns.append(F.element_at(cleaned, -1).try_cast("int").alias("label"))
    return df.select(*columns, F.slice(cleaned, F.lit(2), F.greatest(width, F.lit(0))).alias("fields"))


def parse_sparse_text(df: DataFrame, column: str = "value") -> DataFrame:
    """Text examples ``label 'tag |ns name:value name`` to (label, tag, groups).

    ``groups`` is an array of (ns, features); a feature without a value has 1.
    A line without a label or tag has null there.
    """
    text = F.col(column)
    sections = F.split(text, r"\|")
    head = F.trim(F.get(sections, F.lit(0)))
    first = F.get(F.split(head, " "), F.lit(0))

    def feature(word: Column) -> Column:
        pair = F.split(word, ":")
        value = F.coalesce(F.get(pair, F.lit(1)).try_cast("double"), F.lit(1.0))
        return F.struct(F.get(pair, F.lit(0)).alias("name"), value.alias("value"))

    def group(section: Column) -> Column:
        words = F.filter(F.split(section, " "), lambda w: w != "")
        # A section that starts with a blank has no name.
        named = ~section.startswith(" ")
        ns = F.when(named, F.get(words, F.lit(0))).otherwise(F.lit(""))
        rest = F.when(named, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
        return F.struct(ns.alias("ns"), F.transform(rest, feature).cast(f"array<{FEATURE}>").alias("features"))

    body = F.slice(sections, F.lit(2), F.size(sections) - 1)
    return df.withColumns(
        {
            "label": F.when(~first.startswith("'"), first).try_cast("double"),
            "tag": F.nullif(F.regexp_extract(head, "'(\\S*)", 1), F.lit("")),
            "groups": F.transform(body, group),
        }
    ).drop(column)


def explode_features(parsed: DataFrame) -> DataFrame:
    """One row per feature of parsed text examples."""
    others = [c for c in parsed.columns if c != "groups"]
    grouped = parsed.select(*others, F.explode("groups").alias("g"))
    return grouped.select(*others, F.col("g.ns").alias("ns"), F.explode("g.features").alias("f")).select(
        *others, "ns", F.col("f.name").alias("name"), F.col("f.value").alias("value")
    )


def explode_lines(df: DataFrame, column: str, separator: str = "\n", output: str = "line") -> DataFrame:
    """A text of many lines as one row per line."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode(F.split(F.col(column), separator)).alias(output))
