"""Queries against their SQL on small tables that hold what the given ones don't."""

import duckdb
import pytest

from cueflow import queries as core

LINE = "0.0 AS l_extendedprice, 1.0 AS l_quantity, 'N' AS l_returnflag"
#: Of each case: a table, its rows, and the queries that read it.
CASES = [
    ("documents", "SELECT * FROM (VALUES (1, 'ßa'), (2, 'ŉ'), (3, 'ﬁx'), (4, 'İb'), (5, 'éa'), (6, ' 1a'), (7, ''), (8, NULL), (9, E'\\tǆ')) v(doc_id, text)", ["f13_capitalize_first"]),
    ("lineitem", f"SELECT 1::BIGINT AS l_orderkey, n::INT AS l_linenumber, p::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, {LINE} FROM (VALUES (1, 97283), (2, 97284), (3, 97297), (4, 97310), (5, 1000000), (6, 27)) v(n, p)", ["p17_summary_row", "c5_run_summary"]),
    (
        "events",
        # Within a millisecond of the gap, by rounding or by cutting; a null key; no time.
        """SELECT n::BIGINT AS event_id, (TIMESTAMP '2024-01-01' + to_microseconds(us)) AS ts, u::BIGINT AS user_id, 'x' AS event_type FROM (VALUES
        (1, 600, 1), (2, 7200000100, 1), (3, 400, 2), (4, 7199999900, 2), (5, 0, 3), (6, 7199999600, 3), (7, 600000000, 3), (8, 600, 3), (9, 600000100, 3),
        (10, 0, NULL), (11, 7200000000, NULL), (12, NULL, 5), (13, 5, 5)) v(n, us, u)""",
        ["x4_throttle_batch", "x4_throttle_hot_key", "x4_throttle_daily", "x5_cooldown_batch"],
    ),
]


@pytest.mark.parametrize(("table", "rows", "names"), CASES, ids=[c[0] for c in CASES])
def test_odd_rows(spark, tmp_path, table, rows, names):
    duck = duckdb.connect()
    duck.execute(f"COPY ({rows}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet')")
    for name in names:
        df = core.QUERIES[name](spark, str(tmp_path))
        wanted = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({core.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(wanted, key=repr), name
