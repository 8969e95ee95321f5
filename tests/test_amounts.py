"""Amounts that binary numbers don't hold exactly, and odd ones."""

from datetime import datetime
from itertools import permutations

from quaylight.plans import catalogue
from quaylight.plans.facts import ITEMS


def test_whole_mean_is_not_cut(spark, tmp_path):
    totals, item = [530248.59, 107902.64, 90814.26, 1485630.51], next(iter(ITEMS))
    rows = [(10 * e + i, e, "F", v, datetime(1995 + i, 3, 1), item) for e, p in enumerate(permutations(totals)) for i, v in enumerate(p)]
    # of one year, so that the annual sum is rounded as well
    rows += [(1000 + i, 100, "F", v, datetime(1995, 3, 1), m) for i, (v, m) in enumerate(zip([0.1, 0.2, 0.7], ITEMS, strict=False))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["entity"]: (r["n"], r["low"], r["high"], r["mean"]) for r in catalogue.QUERIES["entity_summary"](spark, str(tmp_path)).collect()}
    assert got == {e: (4, 90814.26, 1485630.51, 553649) for e in range(24)} | {100: (1, 1.0, 1.0, 1)}


def test_money_of_odd_balances(spark, tmp_path):
    rows = [(1, -0.0), (2, 0.0), (3, -0.5), (4, None), (5, float("nan")), (6, float("inf")), (7, float("-inf")), (8, 1e15), (9, 12.99)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = [r["money"] for r in catalogue.QUERIES["money_text"](spark, str(tmp_path)).orderBy("c_custkey").collect()]
    assert got == ["EUR -0.0m", "EUR 0.0m", "EUR -1.0m", "N/A", "EUR nanm", "EUR infm", "EUR -infm", "EUR 1000000000000000.0m", "EUR 12.0m"]
