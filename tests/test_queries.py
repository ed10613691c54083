"""Registered queries against DuckDB on the smallest tables."""

import pytest
from compare import difference, oracle_connection

import __spark_entry__ as entry
from clickloom.plans import oracle

SF_DIR = "/root/testdata/sf0.001"
#: Every statement of the engine itself; those of the optional subpackage have tests of their own.
CHECKED = sorted(oracle.statements())


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, connection, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    assert difference(got, connection.execute(entry.oracle_sql()[name]).df()) is None


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_is_wide_and_complete(spark):
    df = entry.entry(spark)
    assert len(df.columns) > 100 and df.count() > 0


def test_model_beats_nothing_but_is_a_probability(spark):
    scores = entry.queries()["train_score_gbt"](spark, SF_DIR)
    low, high = scores.selectExpr("min(predicted_score)", "max(predicted_score)").first()
    assert 0 <= low <= high <= 1
