"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from conftest import SF001
from stockbook.plans import registry

import importlib.util
import os

_spec = importlib.util.spec_from_file_location(
    "oracle_check", os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools", "oracle_check.py"))
oc = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(oc)

NAMES = sorted(registry.ORACLE)


@pytest.fixture(scope="module")
def duck():
    return oc.duck(SF001)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    sp = E.queries()[name](spark, SF001).toPandas()
    od = duck.execute(E.oracle_sql()[name]).fetchdf()
    assert sorted(sp.columns) == sorted(od.columns)
    assert len(sp) == len(od)
    assert oc.table_hash(sp)[0] == oc.table_hash(od)[0]


def test_every_query_has_oracle_or_is_known():
    no_sql = set(registry.QUERIES) - set(registry.ORACLE)
    assert no_sql == {"schema_report"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert 0 < df.count() <= 100 and {"id", "sale_number", "item_count", "formatted_date"} <= set(df.columns)
    assert "item_count" in df.columns
