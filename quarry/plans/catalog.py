"""All registered queries of the retrieval engine."""

from __future__ import annotations

from quarry.plans import evaluation, metadata, retrieval, scalars

MODULES = (scalars, metadata, retrieval, evaluation)


def queries():
    return {name: run for m in MODULES for name, run in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
