"""Registered queries: each binds an operator to the test tables, with SQL that must give the same rows."""

from . import aggregates, datasets, evaluation, joins, mining, model_calls, sampling, scalars, sources, streams, vectors, windows  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
