"""All registered queries with check SQL against DuckDB on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

SQL = entry.oracle_sql()


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v + 0.0 if isinstance(v, float) else v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", SQL)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, df.collect()) == _rows(names, result.fetchall())


def test_every_query_has_sql_or_fits_a_model():
    without = set(entry.QUERIES) - set(SQL)
    assert all(entry.QUERIES[n].job.__module__.endswith("q_models") for n in without)


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["foto_mes", "clase_ternaria", "n"]


@pytest.mark.parametrize("name", ["two_stage_scores", "importance_by_type", "adversarial_auc", "canary_pruning"])
def test_model_queries_run(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0
