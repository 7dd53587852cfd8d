"""All named queries and the SQL they are checked against."""

from __future__ import annotations

from riskloom.plans import (
    load_queries,
    model_queries,
    monitoring_queries,
    portfolio_queries,
    scoring_queries,
    validation_queries,
)
from riskloom.session import tune

_GROUPS = (
    portfolio_queries.QUERIES,
    load_queries.QUERIES,
    scoring_queries.QUERIES,
    validation_queries.QUERIES,
    monitoring_queries.QUERIES,
    model_queries.QUERIES,
)



def _tuned(run):
    return lambda spark, sf_dir: run(tune(spark), sf_dir)


QUERIES = {name: _tuned(run) for group in _GROUPS for name, (run, _) in group.items()}
ORACLE_SQL = {name: sql for group in _GROUPS for name, (_, sql) in group.items() if sql is not None}
