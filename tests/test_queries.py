"""Every named query against its SQL twin on the smallest tables."""

import __spark_entry__ as entry
import pytest
from compare import difference, duck

from pressroom.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert entry.queries()[name] is QUERIES[name] and entry.oracle_sql()[name] == ORACLES[name]
    assert difference(spark, con, QUERIES[name], ORACLES[name], FOLDER) is None


def test_no_check_is_empty(con):
    assert [name for name, sql in ORACLES.items() if not con.execute(sql).fetchone()] == []


def test_entry_has_rows_and_article_columns(spark):
    frame = entry.entry(spark)
    assert frame.columns[0] == "article_id"
    assert frame.count() > 0
