"""Views that give the test tables the shapes of the supported inputs.

Each view is one SQL text that means the same in Spark and in DuckDB. Table
names stand in braces: Spark fills in DataFrames, the check SQL the table names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quillrank.session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS = {
    "ratings": """
SELECT o_custkey AS user_id, l_partkey AS item_id,
       CAST(1 + CAST(l_quantity AS INT) % 5 AS INT) AS rating,
       o_orderdate AS rated_at, l_orderkey AS order_key, l_linenumber AS line_no, l_suppkey AS supp_key
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey""",
    "rating_lines": """
SELECT l_orderkey AS order_key, l_linenumber AS line_no,
       concat_ws('::', CAST(o_custkey AS VARCHAR(20)), CAST(l_partkey AS VARCHAR(20)),
                 CAST(1 + CAST(l_quantity AS INT) % 5 AS VARCHAR(20)), '0') AS line
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey""",
    "clicks": """
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR(20)), CAST(l_linenumber AS VARCHAR(20)),
                 CAST(l_partkey AS VARCHAR(20)), CAST(l_suppkey AS VARCHAR(20))) AS id,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
       CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS i0,
       CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE CAST(l_suppkey AS INT) END AS i1,
       CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE CAST(l_linenumber AS INT) END AS i2,
       CAST(l_partkey % 3 AS INT) AS i3, CAST(l_partkey % 5 AS INT) AS i4,
       CAST(l_partkey % 7 AS INT) AS i5, CAST(l_partkey % 11 AS INT) AS i6,
       CAST(l_partkey % 13 AS INT) AS i7, CAST(l_partkey % 17 AS INT) AS i8,
       CAST(l_partkey % 19 AS INT) AS i9, CAST(l_partkey % 23 AS INT) AS i10,
       CAST(l_orderkey % 29 AS INT) AS i11, CAST(l_orderkey % 31 AS INT) AS i12,
       l_linestatus AS c13,
       CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE concat('p', CAST(l_partkey % 100 AS VARCHAR(20))) END AS c14,
       concat('s', CAST(l_suppkey % 50 AS VARCHAR(20))) AS c15
FROM {lineitem}""",
    "passengers": """
SELECT c_custkey AS passenger_id,
       CASE WHEN c_acctbal > 4500 THEN 1 ELSE 0 END AS survived,
       CAST(c_nationkey % 3 + 1 AS INT) AS pclass,
       concat('Last', CAST(c_custkey % 97 AS VARCHAR(20)), ', ',
              CASE c_custkey % 12 WHEN 0 THEN 'Mr' WHEN 1 THEN 'Mrs' WHEN 2 THEN 'Miss' WHEN 3 THEN 'Master'
                   WHEN 4 THEN 'Mme' WHEN 5 THEN 'Capt' WHEN 6 THEN 'Don' WHEN 7 THEN 'Lady'
                   WHEN 8 THEN 'the Countess' WHEN 9 THEN 'Dr' WHEN 10 THEN 'Mlle' ELSE 'Rev' END,
              '. First ', c_name) AS name,
       CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex,
       CASE WHEN c_custkey % 5 = 0 THEN NULL
            WHEN c_custkey % 5 = 1 THEN CAST(c_custkey % 80 AS DOUBLE) + CAST(0.5 AS DOUBLE)
            ELSE CAST(c_custkey % 80 AS DOUBLE) END AS age,
       CAST(c_custkey % 4 AS INT) AS sibsp, CAST(c_custkey % 3 AS INT) AS parch,
       c_acctbal AS fare,
       CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE substr('SCQ', CAST(c_custkey % 3 + 1 AS INT), 1) END AS embarked
FROM {customer}""",
    "wide_lines": """
SELECT p_partkey AS id,
       concat_ws(',', CAST(p_partkey AS VARCHAR(20)), CAST(p_size AS VARCHAR(20)),
                 CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END,
                 concat('"', p_name, '"'), concat('-', CAST(p_size AS VARCHAR(20)), '.5'),
                 CASE WHEN p_partkey % 3 = 0 THEN 'NA' ELSE concat('"a:', p_type, '"') END,
                 CAST(p_partkey % 2 AS VARCHAR(20))) AS line
FROM {part}""",
    "predictions": """
SELECT o_custkey AS user_id, l_partkey AS item_id,
       CAST(1 + CAST(l_quantity AS INT) % 5 AS DOUBLE) AS rating,
       CAST((o_custkey * 7 + l_partkey * 13) % 60 AS DOUBLE) / CAST(10 AS DOUBLE) AS prediction,
       l_orderkey AS order_key, l_linenumber AS line_no, l_suppkey AS supp_key
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey""",
    "scored": """
SELECT doc_id AS id, toxic AS label,
       CAST((doc_id * 37) % 101 AS DOUBLE) / CAST(101 AS DOUBLE) AS score
FROM {labels}""",
    "text_examples": """
SELECT d.doc_id AS doc_id, d.text AS text, d.lang AS lang, d.source AS source, d.n_chars AS n_chars, l.quality AS label
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
}


# Tables whose rows take real work; their scans are spread over all task slots.
SPREAD = {"lineitem": ("l_orderkey", "l_partkey"), "documents": ("doc_id",), "customer": ("c_custkey",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan, *SPREAD[name]) if name in SPREAD else scan


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or derived view as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in _names(text)}
    return spark.sql(text, **used)


def check_sql(query: str) -> str:
    """A check query with the derived views that it names in braces written in as CTEs."""
    names = _names(query)
    ctes = [f"{n} AS ({_plain(VIEWS[n])}\n)" for n in names if n in VIEWS]
    body = _plain(query).strip()
    if not ctes:
        return body
    # A query that brings CTEs of its own continues the list.
    rest = ",\n" + body[len("WITH "):] if body.upper().startswith("WITH ") else "\n" + body
    return "WITH " + ",\n".join(ctes) + rest


def _names(text: str) -> list[str]:
    known = set(TABLES) | set(VIEWS)
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", text)) if n in known]


def _plain(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)
