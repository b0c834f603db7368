"""The corpus pipeline: toxicity, near copies, repeated passages, mixing, pieces. Each stage is a table of its own."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm import mixing, toxicity
from quillrank.llm.common import table
from quillrank.llm.jaccard_join import jaccard_components
from quillrank.llm.sentence_pieces import encode_pieces
from quillrank.llm.suffix_dedup import keyed, without_repeats
from quillrank.session import pin

#: Units of text whose pieces a worker keeps; other stages run in the same workers.
REMEMBERED = 50_000
#: How much of each domain's words (high, low quality, toxic) is to be kept. Toxic documents have gone in the first stage;
#: what memberships in that domain are left is doubt about clean ones.
MIX = (1.0, 0.5, 1.0)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5, by labelled examples among ``docs``."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of alike ones.

    Rows that share an id are documents of their own, in the order of their texts, and
    those without an id come before all others; so a row goes only if its own text is
    alike to one that stays. Null and empty texts are alike to nothing. An empty table gives none.
    """
    rows = keyed(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")), F.col("text"))
    found = jaccard_components(rows.select(F.col("key").alias("doc_id"), "text"))
    chosen = found.where("doc_id = component_id").select(F.col("doc_id").alias("key"))
    return rows.join(chosen, "key", "left_semi").select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes and more that stand earlier; ``n_chars`` counts what is left."""
    left = without_repeats(docs)
    return left.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents kept by rates that leave ``MIX`` of each domain's words."""
    return mixing.sampled(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), MIX)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's pieces, and digest of what they decode to."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), remembered=REMEMBERED)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", one_of_alike),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_domains),
    ("sentence_pieces", to_pieces),
]

#: No stage can be said in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), name)
    return docs
