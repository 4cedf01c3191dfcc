"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from verification.compare import connect, difference

SQL = oracle_sql()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


def test_every_statement_has_a_query():
    assert set(SQL) <= set(queries())
    own = {name for name in queries() if not name.startswith("op") and name != "pipeline"}
    assert own - set(SQL) == {
        "logreg_train_score", "gbt_train_score", "platt_calibrate",
    }


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, connection, name):
    assert difference(queries()[name](spark, sf_dir), connection, SQL[name]) is None


def test_entry(spark):
    assert entry(spark).count() == 83


@pytest.mark.parametrize("name", ["logreg_train_score", "gbt_train_score"])
def test_models_score_every_row(spark, sf_dir, name):
    rows = queries()[name](spark, sf_dir)
    assert rows.where("model_predictions between 0 and 1").count() == rows.count() > 0


def test_calibration_rises_with_the_score(spark, sf_dir):
    rows = queries()["platt_calibrate"](spark, sf_dir).orderBy("model_predictions").collect()
    curve = [r["calibrated"] for r in rows]
    assert curve in (sorted(curve), sorted(curve, reverse=True))
