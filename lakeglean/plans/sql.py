"""SQL surface: search functions inside ordinary Spark SQL.

A Spark function cannot start a job, so calls are resolved on the driver
before the statement runs: arguments are evaluated by Spark itself, a table
function becomes a temporary view over the plan it stands for, and a scalar
function becomes its value. What is left is plain Spark SQL.

    sql(spark, "select h.score, d.* from fts_search('/ix', 'red fox', '{\"top_k\": 10}') h join docs d on d.id = h.doc:id")

Table functions: fts_search(index, query [, options [, exclude]]),
lake_table(path [, version]), lake_changes(path, first, last),
lake_files(path), lake_snapshots(path), volume_files(root, volume).
Scalars: fts_count(index, query [, options [, exclude]]),
fts_aggregate(index, query, aggs [, options [, exclude]]), fts_merge(splits,
target [, options [, exclude]]), fts_drop(index), lake_version(path),
volume_drop(root, volume), volume_reap(root, volume, grace seconds). Null
arguments give null, or no rows. ``index`` is a path or an array of paths;
``exclude`` an array of ids or a roaring bitmap. fts_create_index(table, path,
id column, array of columns [, stemmer [, stop words [, strip accents [,
lower]]]]) indexes columns of a table, and fts_match(table, path, id column,
query [, fields [, conjunctive]]) is the table with ``score``.

A table function may be lateral, its arguments those of the relation before it:

    from splits s cross join lateral fts_search(s.path, s.query) h

It is then called once for each distinct list of arguments, at most
``LATERAL_CALLS`` of them, and joined back by them; ``h`` has the arguments as
__arg0, __arg1, ... as well.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeglean.operators import index
from lakeglean.operators.search import Index
from lakeglean.plans import macros
from lakeglean.plans.errors import QueryError
from lakeglean.sources.lake import LakeTable
from lakeglean.sources.volume import VolumeStore


def _search(spark, ix, query, options=None, exclude=None):
    return Index(spark, ix or [] if query is not None else []).search(query, options, exclude)


def _count(spark, ix, query, options=None, exclude=None):
    return None if ix is None or query is None else Index(spark, ix).count(query, options, exclude)


def _aggregate(spark, ix, query, aggs, options=None, exclude=None):
    return None if ix is None or query is None or aggs is None else Index(spark, ix).aggregate(query, aggs, options, exclude)


def _merge(spark, splits, target, options=None, exclude=None):
    o = json.loads(options or "{}")
    if unknown := set(o) - {"exclude_field"}:
        raise QueryError(f"unknown field {sorted(unknown)[0]!r} in options")
    return None if splits is None or target is None else index.merge(spark, splits, target, o.get("exclude_field"), exclude)


def _match(spark, name, path, key, query, fields=None, conjunctive=False):
    return macros.match_bm25(spark.table(name), path, key, query, fields, conjunctive)


#: Distinct argument lists of a lateral call; more are an error.
LATERAL_CALLS = 1000

TABLES = {
    "fts_match": _match,
    "fts_search": _search,
    "lake_table": lambda spark, path, version=None: LakeTable(spark, path).at(version, system=True),
    "lake_changes": lambda spark, path, first, last=None: LakeTable(spark, path).changes(first, last),
    "lake_files": lambda spark, path: LakeTable(spark, path).files(),
    "lake_snapshots": lambda spark, path: LakeTable(spark, path).snapshots(),
    "volume_files": lambda spark, root, volume: VolumeStore(spark, root, read_only=True).frame(volume),
}
SCALARS = {
    "fts_create_index": lambda spark, name, *rest: macros.create_index(spark.table(name), *rest),
    "fts_count": _count,
    "fts_aggregate": _aggregate,
    "fts_merge": _merge,
    "fts_drop": lambda spark, path: index.drop(spark, path),
    "lake_version": lambda spark, path: LakeTable(spark, path).version(),
    "volume_drop": lambda spark, root, volume: VolumeStore(spark, root).drop_volume(volume),
    "volume_reap": lambda spark, root, volume, grace=600: VolumeStore(spark, root).vacuum(volume, float(grace)),
}
_CALL = re.compile(r"\b(%s)\s*\(" % "|".join([*TABLES, *SCALARS]), re.I)
_QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)


def _close(text: str, at: int) -> int:
    """Index of the parenthesis that closes the one before ``at``; quoted text and comments are skipped."""
    depth = 1
    while at < len(text):
        if m := _QUOTED.match(text, at):
            at = m.end()
            continue
        depth += {"(": 1, ")": -1}.get(text[at], 0)
        if not depth:
            return at
        at += 1
    raise QueryError("a parenthesis is not closed")


def _split(text: str) -> list[str]:
    """Arguments: the parts between commas that no bracket or quote encloses."""
    out, depth, at, start = [], 0, 0, 0
    while at < len(text):
        if m := _QUOTED.match(text, at):
            at = m.end()
            continue
        depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(text[at], 0)
        if text[at] == "," and not depth:
            out.append(text[start:at])
            start = at + 1
        at += 1
    return [*out, text[start:]]


_LATERAL = re.compile(r"(?:,|\b(?:cross\s+|inner\s+)?join)\s+lateral\s*$", re.I)
_FROM = re.compile(r"\bfrom\b", re.I)
_ALIAS = re.compile(r"\s+(?:as\s+)?([A-Za-z_]\w*)")


def _lateral(spark: SparkSession, name: str, before: str, inner: str, args: dict | None) -> tuple[str, str]:
    """(view of all calls with their arguments, condition that joins it; its alias is %s)."""
    rel = before[list(_FROM.finditer(before))[-1].end():]
    parts = _split(inner)
    used = {k: v for k, v in (args or {}).items() if re.search(rf":{k}\b", inner + rel)}
    calls = spark.sql(f"select distinct {', '.join(f'{p} as __arg{i}' for i, p in enumerate(parts))} from {rel}", args=used or None)
    rows = calls.limit(LATERAL_CALLS + 1).collect()
    if len(rows) > LATERAL_CALLS:
        raise QueryError(f"a lateral call has more than {LATERAL_CALLS} lists of arguments")
    out = None
    for row in rows or [[None] * len(parts)]:
        one = TABLES[name](spark, *(bytes(v) if isinstance(v, (bytes, bytearray)) else v for v in row))
        for f, v in zip(calls.schema.fields, row):
            one = one.withColumn(f.name, F.lit(v).cast(f.dataType))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    view = f"__{name}_{uuid.uuid4().hex}"
    out.createOrReplaceTempView(view)
    return view, " and ".join(f"%s.__arg{i} <=> {p.strip().replace('%', '%%')}" for i, p in enumerate(parts))


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return f"{v}L" if isinstance(v, int) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql(spark: SparkSession, text: str, args: dict | None = None) -> DataFrame:
    """Run a statement that may call the functions above; ``args`` binds :named parameters, also in their arguments."""
    out, at = [], 0
    while at < len(text):
        if q := _QUOTED.match(text, at):
            out.append(q[0])
            at = q.end()
            continue
        m = _CALL.match(text, at) if not (at and (text[at - 1].isalnum() or text[at - 1] in "_.")) else None
        if not m:
            out.append(text[at])
            at += 1
            continue
        end, name = _close(text, m.end()), m[1].lower()
        inner = text[m.end():end]
        before = "".join(out)
        if name in TABLES and (lateral := _LATERAL.search(before)):
            alias = _ALIAS.match(text, end + 1)
            if not alias:
                raise QueryError("a lateral call needs an alias")
            view, on = _lateral(spark, name, before[:lateral.start()], inner, args)
            out = [before[:lateral.start()], f" join {view} {alias[1]} on {on % ((alias[1],) * on.count('%s'))}"]
            at = alias.end()
            continue
        row = sql(spark, f"select {inner}", args).first() if inner.strip() else ()
        values = [bytes(v) if isinstance(v, (bytes, bytearray)) else v for v in row]
        if name in TABLES:
            view = f"__{name}_{uuid.uuid4().hex}"
            TABLES[name](spark, *values).createOrReplaceTempView(view)
            out.append(view)
        else:
            out.append(_literal(SCALARS[name](spark, *values)))
        at = end + 1
    used = {k: v for k, v in (args or {}).items() if re.search(rf":{k}\b", "".join(out))}
    return spark.sql("".join(out), args=used or None)
