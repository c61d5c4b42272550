"""The derived tables round alike in Spark and DuckDB, whose own rounds differ where a double lies just off a tie."""

import datetime

import duckdb
import pytest

from tidemark.plans.catalog import ORACLE_SQL, QUERIES
from tidemark.plans.fixtures import frame


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Two applications; 0.9 times the risk of the first is 0.285 less a bit."""
    folder = tmp_path_factory.mktemp("tied")
    at = datetime.datetime(1997, 3, 6)
    orders = [(147609, 6888, "O", 333807.23, at, "2-HIGH"), (8, 6888, "O", 1000.0, at, "2-HIGH")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(6888, "AUTOMOBILE")], "c_custkey long, c_mktsegment string").coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_scores_next_to_a_tie(spark, tied):
    got = frame(spark, tied, "predictions").filter("application_id = 'A000147609'").first()
    assert str(got["calibrated_pd"]) == "0.2800000000"


@pytest.mark.parametrize("name", ["a05_risk_deciles", "w02_select_capacity", "w03_review_queue", "w04_ntile"])
def test_ranked_queries(spark, tied, name):
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tied}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, tied)
    cols = ", ".join(got.columns)
    expected = con.execute(f"SELECT {cols} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
