"""Feature groups to vectors: hashing into 2^bits slots, assembling, dense interactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import FeatureHasher, HashingTF, PolynomialExpansion, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.session import scratch_path


def hash_columns(df: DataFrame, columns: Sequence[str], bits: int, output: str = "features",
                 categorical: Sequence[str] = ()) -> DataFrame:
    """Flat columns into 2^bits slots: numbers keep their value, text becomes an indicator.

    Gaps are left out, and no level table is built, so the model size does not
    follow the number of levels.
    """
    hasher = FeatureHasher(inputCols=list(columns), outputCol=output, numFeatures=1 << bits,
                           categoricalCols=list(categorical))
    return hasher.transform(df)


def hash_tokens(df: DataFrame, tokens: str, bits: int, output: str = "features") -> DataFrame:
    """An array of tokens into 2^bits slots, with counts."""
    return HashingTF(inputCol=tokens, outputCol=output, numFeatures=1 << bits).transform(df)


def slot(name: Column, bits: int) -> Column:
    """Slot of a feature name: the same on every run."""
    return F.pmod(F.xxhash64(name), F.lit(1 << bits)).cast("int")


def pin_vectors(df: DataFrame, columns: Sequence[str], label: str = "vectors") -> DataFrame:
    """Write ``df`` to the shared folder and read it back with the struct columns ``columns`` as vectors.

    A vector is stored as a struct of its kind, size, indices and values, so a table
    written with such structs is a table of vectors. No row passes through Python.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    fields = [T.StructField(f.name, VectorUDT() if f.name in columns else f.dataType) for f in df.schema]
    return df.sparkSession.read.schema(T.StructType(fields)).parquet(path)


def sparse(pairs: Column, size: int) -> Column:
    """Sorted (place, value) pairs with distinct places as the struct behind a sparse vector."""
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
        F.transform(pairs, lambda p: p["place"]).alias("indices"), F.transform(pairs, lambda p: p["value"]).alias("values"),
    )


def added_up(df: DataFrame, pairs: str) -> DataFrame:
    """Sort the (place, value) pairs of a column by place and add up those with one place."""
    # A single pair needs none of this, and it is by far the most costly step of hashing it.
    one = F.size(pairs) == 1
    rows = df.withColumn("__sorted", F.when(one, F.col(pairs)).otherwise(F.array_sort(pairs)))
    size, place = F.size("__sorted"), lambda i: F.get("__sorted", i)["place"]
    last = F.filter(F.sequence(F.lit(1), size), lambda i: (i == size) | (place(i) != place(i - 1)))
    rows = rows.withColumn("__last", F.when(size > 1, last).when(size == 1, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))

    def total(end: Column, number: Column) -> Column:
        before = F.coalesce(F.get("__last", number - 1), F.lit(0))
        same = F.slice("__sorted", before + 1, end - before)
        return F.struct(place(end - 1).alias("place"), F.aggregate(same, F.lit(0.0), lambda s, p: s + p["value"]).alias("value"))

    first = F.get("__sorted", F.lit(0))
    alone = F.array(F.struct(first["place"].alias("place"), (F.lit(0.0) + first["value"]).alias("value")))
    return rows.withColumn(pairs, F.when(size == 1, alone).otherwise(F.transform("__last", total))).drop("__sorted", "__last")


def hash_group(df: DataFrame, group: str | Column, bits: int, output: str = "features") -> DataFrame:
    """A group of weighted features into 2^bits slots, equal slots added up; the result is a pinned table.

    Slots come from a built-in hash, and the vector is built as the struct that
    stands for one in a written table.
    """
    terms = F.col(group) if isinstance(group, str) else group
    slots = F.transform(terms, lambda t: F.struct(slot(t["name"], bits).alias("place"), t["value"].alias("value")))
    rows = added_up(df.withColumn("__slots", slots), "__slots")
    return pin_vectors(rows.withColumn(output, sparse(F.col("__slots"), 1 << bits)).drop("__slots"), [output])


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    """One vector from number and vector columns, in the given order."""
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="keep").transform(df)


def dense_quadratic(df: DataFrame, vector: str, output: str = "expanded") -> DataFrame:
    """All products of two entries of a dense vector, with the entries themselves."""
    return PolynomialExpansion(degree=2, inputCol=vector, outputCol=output).transform(df)
