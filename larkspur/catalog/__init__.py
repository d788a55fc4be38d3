"""The registered queries, each with the SQL it is checked against where SQL can express it."""

from __future__ import annotations

from larkspur.catalog import expressions, indexes, objects, relations, search, sources, stores, texts

_MODULES = (search, expressions, relations, texts, stores, indexes, objects, sources)


def all_queries() -> dict:
    return {name: q for module in _MODULES for name, q in module.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
