import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle import same_rows

import __spark_entry__ as entry
from gaugeworks.plans import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_match_sql(spark, sf, name):
    same_rows(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", ["hdmr_orders"])
def test_rows_only(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
