"""Convenience forms: index a table's columns by one call, and score rows by their key."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeglean.operators import index
from lakeglean.operators.search import Index


def create_index(df: DataFrame, path: str, input_id: str, input_values: list[str], stemmer: str = "porter", stopwords: str = "english", strip_accents: bool = True, lower: bool = True) -> int:
    """Index ``input_values`` of ``df`` under the key ``input_id`` (stored as text in ``_key``); the documents indexed."""
    filters: list = [{"type": "remove_long", "max": 40}]
    filters += ["lowercase"] * lower + ["ascii_folding"] * strip_accents
    filters += [{"type": "stop_words", "language": stopwords}] * (stopwords != "none") + [{"type": "stemmer", "language": stemmer}] * (stemmer != "none")
    schema = [{"name": "_key", "type": "text", "options": {"stored": True, "coerce": True, "fast": True, "indexing": {"tokenizer": "raw"}}}]
    schema += [{"name": c, "type": "text", "options": {"coerce": True, "indexing": {"tokenizer": "fts"}}} for c in input_values]
    own = df.select(F.col(f"`{input_id}`").cast("string").alias("_key"), *(F.col(f"`{c}`").cast("string").alias(c) for c in input_values))
    made = index.build(own, path, schema, {"fts": {"tokenizer": "simple", "filters": filters}}, order=None)
    return made.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]


def match_bm25(df: DataFrame, path: str, input_id: str, query_string: str, fields: str | None = None, conjunctive: bool = False) -> DataFrame:
    """``df`` with ``score``: that of the row's key, or null. A join, never a call for each row."""
    names = re.split(r"\s*,\s*", fields.strip()) if fields else None
    options: dict = {"conjunctive": conjunctive, "fast": ["_key"]}
    if names:
        options["fields"] = names
    else:
        options["fields"] = [f for f in Index(df.sparkSession, path).splits[0].schema.text_fields() if f != "_key"]
    h = Index(df.sparkSession, path).search(query_string, options)
    best = h.groupBy(F.get_json_object("doc", "$._key").alias("__key")).agg(F.max("score").alias("score"))
    return df.join(best, F.col(f"`{input_id}`").cast("string") == F.col("__key"), "left").drop("__key")
