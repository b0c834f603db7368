"""Run queries in Spark and their check SQL in DuckDB and compare rows exactly.

``python tests/compare.py [sf folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quillrank.plans.fixtures import TABLES  # noqa: E402


def check_rows(sql: str, sf_dir: str) -> tuple[list[str], list[str], Counter]:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    types = [str(cursor.description[i][1]) for i in order]
    rows = Counter(tuple(_plain(row[i]) for i in order) for row in cursor.fetchall())
    return sorted(names), types, rows


def spark_rows(df) -> tuple[list[str], list[str], Counter]:
    names = sorted(df.columns)
    types = [df.schema[n].dataType.simpleString() for n in names]
    return names, types, Counter(tuple(_plain(v) for v in row) for row in df.select(*names).collect())


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return tuple(value) if isinstance(value, list) else value


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty when both sides have the same columns and rows."""
    names, types, got = spark_rows(df)
    want_names, want_types, want = check_rows(sql, sf_dir)
    if names != want_names:
        return f"columns {names} != {want_names}"
    if got != want:
        return (f"{sum(got.values())} rows vs {sum(want.values())}; only spark "
                f"{list((got - want).items())[:3]}; only sql {list((want - got).items())[:3]}")
    odd = [(n, a, b) for n, a, b in zip(names, types, want_types) if (a, b.lower()) not in SAME]
    return f"types {odd}" if odd else ""


SAME = {("bigint", "bigint"), ("int", "integer"), ("double", "double"), ("string", "varchar"),
        ("timestamp_ntz", "timestamp"), ("timestamp", "timestamp"), ("boolean", "boolean"),
        ("bigint", "number"), ("int", "number"), ("double", "number"), ("string", "string"),
        ("timestamp_ntz", "datetime"), ("float", "float")}


def main() -> None:
    import __spark_entry__ as entry
    from quillrank.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    checks = entry.oracle_sql()
    bad = []
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in checks:
                note = difference(df, checks[name], sf_dir) or f"same, {df.count()} rows"
            else:
                note = f"no sql, {df.count()} rows"
        except Exception as error:  # noqa: BLE001
            note = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        if not note.startswith(("same", "no sql")):
            bad.append(name)
        print(f"{name:28s} {time.time() - start:6.1f}s  {note}", flush=True)
    print("BAD:", bad)


if __name__ == "__main__":
    main()
