"""Queries that must do their whole job, over tables made here."""

from quillrank.queries import load

QUERIES = load()[0]


def test_except_ids_takes_unrated_items(spark, tmp_path):
    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    table("part", [(k,) for k in range(1, 7)], "p_partkey long")
    table("customer", [(1, 0), (2, 3), (3, 0)], "c_custkey long, c_nationkey int")
    table("orders", [(10, 1, "1995-01-01"), (11, 2, "1995-01-02"), (12, 3, "1995-01-03")],
          "o_orderkey long, o_custkey long, o_orderdate string")
    table("lineitem", [(10, 1, 1, 2, 3.0), (10, 2, 1, 2, 3.0), (11, 3, 1, 2, 3.0), (12, 4, 1, 2, 3.0), (12, 1, 2, 2, 3.0)],
          "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_quantity double")
    # Items 1, 2 and 4 were rated in nation 0; 3 only in another.
    assert sorted(r.item_id for r in QUERIES["except_ids"](spark, str(tmp_path)).collect()) == [3, 5, 6]
