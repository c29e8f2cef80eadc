"""The driver's contract."""

import __spark_entry__


def test_names_agree():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    assert all(map(callable, queries.values())) and all(isinstance(x, str) for x in oracles.values())


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert {"signal_id", "total", "position"} <= set(rows.columns)
    top = rows.filter("position = 1").collect()
    assert len(top) == 1 and top[0]["status"] == "open"
