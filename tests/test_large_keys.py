"""Queries against their SQL on a few rows whose keys are as large as those of tables many times the given size."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from __spark_entry__ import oracle_sql, queries


@pytest.fixture()
def agree(spark, tmp_path, rows):
    """Whether a query and its SQL give the same rows over the given tables."""

    def check(name, **tables):
        connection = duckdb.connect()
        for table, columns in tables.items():
            path = f"{tmp_path}/{table}.parquet"
            pq.write_table(pa.table(columns), path)
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
        got = queries()[name](spark, str(tmp_path))
        wanted = connection.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle_sql()[name]})").fetchall()
        assert rows(got) == sorted((tuple(r) for r in wanted), key=repr)

    return check


def lines(partkeys):
    n = len(partkeys)
    return {"l_orderkey": list(range(n)), "l_linenumber": pa.array([i % 4 + 1 for i in range(n)], pa.int32()), "l_partkey": partkeys, "l_suppkey": [0] * n}


def test_address_ranges_past_net_10(agree):
    agree("address_ranges", lineitem=lines([k for k in (5, 1_048_568, 1_048_575, 1_048_576, 3_000_001) for _ in range(4)]))


def test_subnets_past_net_10(agree):
    agree("subnets", lineitem=lines([k for k in (5, 453_438, 453_439, 1_199_999, 7_000_003) for _ in range(4)]))


def orders(custkeys, keys=None, days=None):
    n = len(custkeys)
    day = lambda i: datetime.datetime(2000, 1, 1) + datetime.timedelta(days=days[i] if days else i)
    return {
        "o_orderkey": keys or list(range(n)), "o_custkey": custkeys, "o_orderstatus": ["FPO"[i % 3] for i in range(n)],
        "o_orderdate": pa.array([day(i) for i in range(n)], pa.timestamp("us")),
    }


def test_syslog_serials_of_more_than_five_digits(agree):
    agree("syslog_messages", orders=orders([k for k in (7, 99_999, 100_000, 899_999, 5_399_999) for _ in range(6)]))
