"""Every named query against its SQL, on the smallest scale folder."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from riskloom.plans import catalog
from tests.conftest import SMALL
from tests.oracle import compare, connect

SQL = catalog.ORACLE_SQL
# fitted on the middle folder in test_models; the smallest has too few defaults
MODELS = {"train_pd", "train_scorecard", "train_lgd", "train_ead", "feature_importance", "model_scoring", "run_log", "refit_comparison"}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    assert compare(contract.queries()[name](spark, SMALL), duck, SQL[name]) == []


def test_entry_has_one_row_per_grade(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "grade"
    assert 1 <= df.count() <= 7


def test_every_query_has_sql_or_is_known_not_to():
    assert set(catalog.QUERIES) - set(SQL) == MODELS


def test_stream_gives_the_batch_predictions(spark):
    from riskloom.plans.book import loans
    from riskloom.operators.scoring import applications, score_pd

    streamed = contract.queries()["stream_scoring"](spark, SMALL)
    batch = score_pd(applications(loans(spark, SMALL)))
    both = streamed.join(batch.withColumnRenamed("score", "batch_score"), streamed.loan_ref == batch.loan_id.cast("string"))
    assert both.count() == batch.count() == streamed.count()
    # the stored rate has four decimals, as has the file
    assert both.filter("abs(prediction - pd) > 1e-6 OR score <> batch_score").count() == 0
