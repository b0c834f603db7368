"""Registered queries of the operators, each over its whole table, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillrank.llm import mixing, quality, toxicity
from quillrank.llm.collocations import collocations
from quillrank.llm.common import table
from quillrank.llm.forest import nearest
from quillrank.llm.hard_negatives import hard_negatives
from quillrank.llm.jaccard_join import jaccard_components
from quillrank.llm.licenses import license_scan
from quillrank.llm.sentence_pieces import encode_pieces
from quillrank.llm.suffix_dedup import removed_spans
from quillrank.llm.token_counts import count_tokens
from quillrank.llm.token_files import token_rows
from quillrank.llm.top_products import top_products

Query = Callable[[SparkSession, str], DataFrame]

#: Shares of all words that the domains of quillrank.llm.mixing are to have.
MIX_SHARES = (0.80, 0.18, 0.02)

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


@query
def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


CHECKS["op3_top_products"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM p)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5"""

CHECKS["op5_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
k AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, k.b FROM r JOIN k ON r.c = k.a),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c AS component_id FROM s JOIN m ON id = doc_id"""


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")


@query
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rated(_documents(spark, sf_dir), table(spark, sf_dir, "labels", "doc_id", "toxic"))


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir))


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(_documents(spark, sf_dir))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mixing_rates(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), MIX_SHARES)


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_documents(spark, sf_dir))


CHECKS["op11_collocations"] = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
e AS (SELECT lang, unnest(string_split(regexp_replace(t, '[.,;:!?\x0A-\x0D]', chr(10), 'g'), chr(10))) AS piece FROM d),
p AS (SELECT lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM e),
g AS (
  SELECT lang, unnest(w) AS ph FROM p
  UNION ALL SELECT lang, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || ' ' || z[2])) FROM p WHERE len(w) >= 2
  UNION ALL SELECT lang, unnest(list_transform(list_zip(w[:-3], w[2:-2], w[3:]), lambda z: z[1] || ' ' || z[2] || ' ' || z[3])) FROM p WHERE len(w) >= 3
  UNION ALL SELECT lang, unnest(list_transform(list_zip(w[:-4], w[2:-3], w[3:-2], w[4:]), lambda z: z[1] || ' ' || z[2] || ' ' || z[3] || ' ' || z[4]))
  FROM p WHERE len(w) >= 4),
f AS MATERIALIZED (SELECT lang, ph, count(*) AS a FROM g GROUP BY lang, ph),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE NOT contains(ph, ' ') GROUP BY lang),
c AS MATERIALIZED (SELECT lang, ph, a, string_split(ph, ' ') AS w FROM f WHERE a >= 30 AND contains(ph, ' ')),
i AS (
  SELECT lang, array_to_string(w[k:k + z - 1], ' ') AS ph, max(a) AS longer
  FROM c, (VALUES (2), (3)) AS v(z), (VALUES (1), (2), (3)) AS u(k) WHERE z < len(w) AND k + z - 1 <= len(w) GROUP BY 1, 2),
o AS (SELECT c.* FROM c LEFT JOIN i ON c.lang = i.lang AND c.ph = i.ph WHERE NOT coalesce(100 * CAST(longer AS HUGEINT) >= 80 * CAST(a AS HUGEINT), FALSE)),
x AS (
  SELECT lang, ph, a, k, array_to_string(w[1:k], ' ') AS front, array_to_string(w[k + 1:], ' ') AS back
  FROM o, (VALUES (1), (2), (3)) AS v(k) WHERE k < len(w)),
k AS (
  SELECT x.lang, x.ph, x.a, k, l.a AS l, r.a AS r, (CAST(2000000 AS HUGEINT) * x.a) // (CAST(l.a AS HUGEINT) + r.a) AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.ph = front JOIN f r ON r.lang = x.lang AND r.ph = back),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) AS cut FROM k),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, ph) AS place FROM m WHERE cut = 1)
SELECT b.lang, place AS rank, ph AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM b JOIN n ON b.lang = n.lang WHERE place <= 2000"""


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents", "text", "lang"))


CHECKS["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS place
  FROM p JOIN s ON p.place <= 5 AND s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 10"""


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), "vec_id", "embedding", "label")


@query
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
