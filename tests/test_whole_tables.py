"""Queries over whole tables against their SQL: no row of either side is left out."""

from collections import Counter

import pytest

from ordwise.plans import catalogue

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.range(1, 401).selectExpr("id AS o_orderkey", "1 + id * 7 % 130 AS o_custkey").write.parquet(f"{d}/orders.parquet")
    spark.range(1, 1201).selectExpr("id AS c_custkey", "concat('c', id) AS c_name", "CAST(id % 25 AS INT) AS c_nationkey").write.parquet(f"{d}/customer.parquet")
    spark.range(1, 301).selectExpr("id AS p_partkey", "CAST(1 + id % 50 AS INT) AS p_size").write.parquet(f"{d}/part.parquet")
    spark.range(200).selectExpr("id AS vec_id", "array(CAST(id % 7 AS FLOAT) / 8, CAST(id % 5 AS FLOAT) / 4, 1F) AS embedding").write.parquet(f"{d}/embeddings.parquet")
    return d


WHOLE = sorted(x for x in catalogue.QUERIES if x.startswith(("join_", "set_", "merge_", "matmul")))


@pytest.mark.parametrize("name", WHOLE)
def test_agrees_with_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("orders", "customer", "part", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    got = catalogue.QUERIES[name](spark, tables)
    want = con.execute(catalogue.ORACLES[name]).fetchall()
    columns = [x[0] for x in con.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want)


def test_every_order_and_customer_enters(spark, tables):
    rows = catalogue.QUERIES["join_full"](spark, tables).collect()
    assert {r.a_pos for r in rows} == {-1, *range(1, 401)} and {r.b_pos for r in rows} == {-1, *range(1, 1201)}
    assert catalogue.QUERIES["merge_pairs"](spark, tables).count() == 400 + 1200


def test_every_customer_and_vector_enters(spark, tables):
    assert catalogue.QUERIES["set_union_max_pairs"](spark, tables).count() >= 1200
    got = {(r.i, r.j): r.v for r in catalogue.QUERIES["matmul"](spark, tables).collect()}
    assert got[2, 2] == 200 * 1000 * 1000
