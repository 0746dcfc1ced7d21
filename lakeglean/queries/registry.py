"""All query modules of the core."""

from __future__ import annotations

from lakeglean.queries import functions, lake, recipes, search, training

MODULES = [training, search, lake, recipes, functions]
FLAGSHIP = "fts_top10_bm25"


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def sql() -> dict:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
