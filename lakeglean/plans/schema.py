"""Index schemas: a list of field entries, validated strictly."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import types as T

from lakeglean.functions.analyzers import BUILT_IN, Analyzer
from lakeglean.plans.errors import QueryError

TYPES = {"text": T.StringType(), "i64": T.LongType(), "u64": T.DecimalType(20, 0), "f64": T.DoubleType(), "bool": T.BooleanType(), "date": T.TimestampType(),
         "facet": T.StringType(), "bytes": T.BinaryType(), "ip_addr": T.StringType(), "json_object": T.StringType()}
#: Types whose values are matched on columns of the documents instead of on terms.
COLUMN_TYPES = ("i64", "u64", "f64", "bool", "date", "ip_addr", "bytes", "facet")


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    stored: bool = False
    indexed: bool = True
    fast: bool = False
    coerce: bool = False
    tokenizer: str = "default"
    positions: bool = True

    @property
    def column(self) -> bool:
        return self.type in COLUMN_TYPES


class Schema:
    """``[{"name": ..., "type": ..., "options": {...}}]`` with analyzers by name."""

    def __init__(self, entries, analyzers: dict | None = None):
        if isinstance(entries, str):
            try:
                entries = json.loads(entries)
            except ValueError as e:
                raise QueryError(f"invalid schema: {e}") from None
        if not isinstance(entries, list) or not entries:
            raise QueryError("invalid schema: a nonempty list of fields is needed")
        self.entries, self.specs = entries, dict(analyzers or {})
        self.analyzers = {n: Analyzer(s) for n, s in (BUILT_IN | self.specs).items()}
        self.fields: dict[str, Field] = {}
        for e in entries:
            if not isinstance(e, dict) or "name" not in e or e.get("type") not in TYPES:
                raise QueryError(f"invalid schema: field {e!r}")
            if unknown := set(e) - {"name", "type", "options"}:
                raise QueryError(f"invalid schema: unknown field {sorted(unknown)[0]!r}")
            o = dict(e.get("options") or {})
            ix = o.pop("indexing", None)
            flags = {k: bool(o.pop(k, k == "indexed")) for k in ("stored", "indexed", "fast", "coerce")}
            if o:
                raise QueryError(f"invalid schema: unknown field {sorted(o)[0]!r}")
            ix = ix if isinstance(ix, dict) else {}
            if unknown := set(ix) - {"record", "fieldnorms", "tokenizer"}:
                raise QueryError(f"invalid schema: unknown field {sorted(unknown)[0]!r}")
            tokenizer = ix.get("tokenizer", "default")
            if tokenizer not in self.analyzers:
                raise QueryError(f"invalid schema: unknown tokenizer {tokenizer!r}")
            if e["name"] in self.fields or not e["name"] or e["name"].startswith("_doc"):
                raise QueryError(f"invalid schema: field name {e['name']!r}")
            self.fields[e["name"]] = Field(e["name"], e["type"], **flags, tokenizer=tokenizer, positions=ix.get("record", "position") == "position")

    def analyzer(self, name: str) -> Analyzer:
        return self.analyzers[self.fields[name].tokenizer]

    def text_fields(self) -> list[str]:
        return [f.name for f in self.fields.values() if f.indexed and f.type in ("text", "json_object")]

    def resolve(self, name: str) -> tuple[Field, str] | None:
        """The field and, below a JSON field, the path that a dotted name means."""
        if name in self.fields:
            return self.fields[name], ""
        head, _, rest = name.partition(".")
        if rest and head in self.fields and self.fields[head].type == "json_object":
            return self.fields[head], rest
        return None

    def to_json(self) -> dict:
        return {"entries": self.entries, "analyzers": self.specs}
