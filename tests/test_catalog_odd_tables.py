"""Queries against their SQL on tables that the small test folder does not have."""

import os

import duckdb
import pytest
from test_catalog import sorted_rows

from sitegauge import catalog

QUERIES, SQL = catalog.load()


@pytest.fixture
def agrees(spark, folder, tmp_path):
    """Checks a query on the test tables, some of them replaced by what a SELECT over them gives."""
    def check(name, **replaced):
        con = duckdb.connect()
        for place in sorted(p for p in os.listdir(folder) if p.endswith(".parquet")):
            con.execute(f"CREATE VIEW {place[:-8]} AS SELECT * FROM '{folder}/{place}'")
        for table, select in replaced.items():
            con.execute(f"COPY ({select}) TO '{tmp_path}/{table}.parquet'")
        for table in replaced:
            con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        cursor = con.execute(SQL[name])
        names = [d[0] for d in cursor.description]
        mine = QUERIES[name](spark, str(tmp_path)).select(*names).collect()
        assert mine and sorted_rows(mine) == sorted_rows(cursor.fetchall())

    return check


def test_codes_of_six_digits_through_csv(agrees):
    agrees("codes_and_lists_through_csv", customer="SELECT * REPLACE (c_custkey * 1000 AS c_custkey) FROM customer")


def test_a_price_of_zero_sent_as_text(agrees):
    agrees("prices_from_answers", events="SELECT * REPLACE (CASE WHEN event_id % 3 > 0 THEN value ELSE 0 END AS value) FROM events")


def test_totals_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    """The second customer's orders lie in the file the other way round; added up so, they would give another last digit."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM (VALUES (1, 5.0), (2, 7.0)) t(c_custkey, c_acctbal)) TO '{tmp_path}/customer.parquet'")
    con.execute(f"""COPY (SELECT * FROM (VALUES (1, 1, 0.1::DOUBLE), (2, 1, 0.2), (3, 1, 0.3), (6, 2, 0.3), (5, 2, 0.2), (4, 2, 0.1))
                    t(o_orderkey, o_custkey, o_totalprice)) TO '{tmp_path}/orders.parquet'""")
    got = {r.c_custkey: (r.raw_rank, r.corrected_rank, r.rank_change) for r in QUERIES["rank_changes"](spark, str(tmp_path)).collect()}
    assert got == {1: (2.0, 1.5, 0.5), 2: (1.0, 1.5, -0.5)}
