"""All registered queries of the analytics library and the SQL that gives the same rows."""

from __future__ import annotations

from functools import partial

from tidemark.plans import aggregates, daily_run, dialect, extra, flows, ingest, learned, models, relational, rules, series, serving, smoothing, studies, studies_sql, timeseries

SQL = {**timeseries.QUERIES, **aggregates.QUERIES, **relational.QUERIES}
QUERIES: dict = {name: partial(dialect.run, text) for name, text in SQL.items()} | extra.QUERIES | studies.QUERIES | series.QUERIES | models.QUERIES | ingest.QUERIES | flows.QUERIES | daily_run.QUERIES | learned.QUERIES | rules.QUERIES | smoothing.QUERIES | serving.QUERIES
ORACLES: dict = {name: dialect.oracle(text) for name, text in SQL.items()} | extra.ORACLES | studies_sql.ORACLES | series.ORACLES | models.ORACLES | ingest.ORACLES | flows.ORACLES | daily_run.ORACLES | learned.ORACLES | rules.ORACLES | smoothing.ORACLES | serving.ORACLES
ORACLES["ts_features"] = series.features_sql(ORACLES)
