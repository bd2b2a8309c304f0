"""All training-data queries, by operator."""

from __future__ import annotations

from hearthlog.llm import codes, exact, lines, mixing, packing, phrases, pii, quality, sharding, simhash, suffixes, winnowing, wordpiece

MODULES = (pii, sharding, suffixes, wordpiece, exact, quality, lines, simhash, packing, mixing, codes, phrases, winnowing)


def queries():
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql():
    return {name: text for module in MODULES for name, text in module.ORACLE.items()}
