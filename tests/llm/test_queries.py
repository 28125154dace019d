import os

import duckdb
import pytest

from phraseweave.llm.queries import ORACLES, QUERIES

SF_DIR = f"/root/testdata/{os.environ.get('PHRASEWEAVE_TEST_SF', 'sf0.001')}"


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", ORACLES)
def test_rows_of_the_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    found = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF_DIR)
    assert sorted(got.columns) == sorted(found.columns)
    rows = [tuple(r) for r in got.select(*found.columns).collect()]
    assert rows and ordered(rows) == ordered(found.fetchall())


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 11)) and ORACLES.keys() <= QUERIES.keys()
