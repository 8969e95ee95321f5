"""Every part is asked for, whatever its key."""

import duckdb

from quaylight.plans import catalogue


def test_all_parts_are_queries(spark, tmp_path):
    names = ["red box", "red box", "red bax", "Red Box", "blue jar", "blue jars", "green", None, "lone"]
    rows = [(i + 1, n, 1 + (i > 3)) for i, n in enumerate(names)] + [(20, "red bx", 1), (40, "single", 9)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = {r["query"]: (r["found"], r["exact"], r["ambiguous"]) for r in catalogue.QUERIES["unique_names"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert found == {q: (f, e, a) for q, f, e, a in c.execute(catalogue.ORACLES["unique_names"]).fetchall()}
    assert set(found) == {*range(1, 10), 20}
    assert found[3] == (1, 0, False) and found[1] == (2, 2, True) and found[5] == (6, 0, False) and found[9] == (None, 0, False)
