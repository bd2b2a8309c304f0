"""All registered queries, by operator."""

from __future__ import annotations

from hearthlog.plans import arrivals, chain, days, evaluate, features, grid, live, local, log, models, serve, stream

MODULES = (log, grid, features, evaluate, days, serve, models, stream, chain, local, live, arrivals)


def queries():
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql():
    return {name: text for module in MODULES for name, text in module.ORACLE.items()}
