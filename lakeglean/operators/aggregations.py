"""Bucket and metric aggregations from a nested JSON request, as grouped DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeglean.plans.errors import QueryError

METRICS = {"min": F.min, "max": F.max, "avg": F.avg, "sum": F.sum, "value_count": F.count, "cardinality": lambda c: F.approx_count_distinct(c, 0.01)}
BUCKETS = {"terms": {"field", "size"}, "range": {"field", "ranges"}, "histogram": {"field", "interval", "offset", "min_doc_count"}, "date_histogram": {"field", "fixed_interval", "min_doc_count"}}
#: A request to aggregate() may make at most this many buckets on one level.
MAX_BUCKETS = 65_000
_UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400}


def _field(df: DataFrame, p: dict) -> tuple[Column, T.DataType]:
    name = p.get("field")
    if name not in df.columns:
        raise QueryError(f"aggregations: field {name!r} is unknown or not fast")
    return F.col(f"`{name}`"), df.schema[name].dataType


def _seconds(text: str) -> float:
    for unit in sorted(_UNITS, key=len, reverse=True):
        if text.endswith(unit):
            try:
                return float(text[: -len(unit)]) * _UNITS[unit]
            except ValueError:
                break
    raise QueryError(f"aggregations: invalid interval {text!r}")


def parse(aggs) -> dict:
    """{name: (kind, parameters, sub-aggregations)} after validation."""
    if isinstance(aggs, str):
        try:
            aggs = json.loads(aggs)
        except ValueError as e:
            raise QueryError(f"invalid aggregations: {e}") from None
    if not isinstance(aggs, dict):
        raise QueryError("invalid aggregations: an object is needed")
    out = {}
    for name, a in aggs.items():
        if not isinstance(a, dict):
            raise QueryError(f"invalid aggregations: {name}")
        sub = a.get("aggs", a.get("aggregations", {}))
        kinds = [k for k in a if k not in ("aggs", "aggregations")]
        if len(kinds) != 1 or kinds[0] not in (*METRICS, *BUCKETS, "stats"):
            raise QueryError(f"invalid aggregations: {name} has kind {kinds}")
        kind, p = kinds[0], a[kinds[0]]
        if not isinstance(p, dict) or set(p) - (BUCKETS.get(kind) or {"field"}):
            raise QueryError(f"invalid aggregations: unknown parameter in {name}")
        if sub and kind not in BUCKETS:
            raise QueryError(f"invalid aggregations: {name} can't have parts")
        out[name] = (kind, p, parse(sub))
    return out


def bucket_key(df: DataFrame, kind: str, p: dict) -> tuple[DataFrame, Column]:
    """The frame (exploded for fields of several values) and the key of its buckets."""
    c, t = _field(df, p)
    if isinstance(t, T.ArrayType):
        name = p["field"]
        df = df.withColumn(name, F.explode(F.array_distinct(c)))
        c, t = F.col(f"`{name}`"), t.elementType
    if kind == "histogram":
        step, off = float(p["interval"]), float(p.get("offset", 0))
        if step <= 0:
            raise QueryError("aggregations: interval must be positive")
        return df, F.floor((c - off) / step) * step + off
    if kind == "date_histogram":
        step = _seconds(str(p["fixed_interval"]))
        us = F.unix_micros(c.cast("timestamp"))
        return df, F.floor(us / (step * 1e6)) * F.lit(step * 1000)
    return df, c


def metric_columns(df: DataFrame, aggs: dict) -> dict[str, Column]:
    cols = {}
    for name, (kind, p, _) in aggs.items():
        if kind in BUCKETS:
            continue
        c, t = _field(df, p)
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_millis(c.cast("timestamp"))
        if isinstance(t, T.ArrayType) and kind != "cardinality":
            raise QueryError(f"aggregations: {kind} of a field of several values")
        if kind == "stats":
            for k in ("count", "min", "max", "avg", "sum"):
                cols[f"{name}.{k}"] = METRICS["value_count" if k == "count" else k](c)
        else:
            cols[name] = METRICS[kind](c)
    return cols


def _metrics_of(row: dict, aggs: dict, prefix: str = "") -> dict:
    out = {}
    for name, (kind, _, _) in aggs.items():
        if kind in BUCKETS:
            continue
        if kind == "stats":
            out[name] = {k: row[f"{name}.{k}"] for k in ("count", "min", "max", "avg", "sum")}
        else:
            out[name] = {"value": row[name]}
    return out


def range_bounds(p: dict) -> list[tuple[str, float | None, float | None]]:
    """Named ranges, the ends made whole, so that the buckets cover the line."""
    rs = sorted(((r.get("from"), r.get("to"), r.get("key")) for r in p["ranges"]), key=lambda r: (r[0] is not None, r[0] or 0))
    full, at = [], None
    for a, b, key in rs:
        if a is not None and (at is None and not full or at is not None and at < a):
            full.append((at, a, None))
        full.append((a, b, key))
        at = b
    if at is not None:
        full.append((at, None, None))
    show = lambda v: "*" if v is None else f"{v:g}" if isinstance(v, (int, float)) else str(v)
    return [(key or f"{show(a)}-{show(b)}", a, b) for a, b, key in full]


def _keyed(df: DataFrame, kind: str, p: dict, name: str = "_key") -> DataFrame:
    """Rows with the key of the bucket they fall into; rows without one are left out, rows of several come several times."""
    df, key = bucket_key(df, kind, p)
    if kind != "range":
        return df.withColumn(name, key).filter(F.col(name).isNotNull())
    labels = []
    for label, a, b in range_bounds(p):
        c = key.isNotNull()
        c = c & (key >= a) if a is not None else c
        c = c & (key < b) if b is not None else c
        labels.append(F.when(c, F.lit(label)))
    return df.withColumn(name, F.explode(F.filter(F.array(*labels), lambda x: x.isNotNull())))


def bucket_frame(df: DataFrame, kind: str, p: dict, sub: dict | None = None) -> DataFrame:
    """(_key, doc_count, metrics...) of one bucket aggregation, ordered as it is reported, however many buckets."""
    df = _keyed(df, kind, p)
    out = df.groupBy("_key").agg(F.count(F.lit(1)).alias("doc_count"), *(c.alias(n) for n, c in metric_columns(df, sub or {}).items()))
    if kind == "terms":
        return out.orderBy(F.desc("doc_count"), F.asc("_key")).limit(int(p.get("size", 10)))
    return out.orderBy("_key")


def aggregate(df: DataFrame, aggs, fields: dict | None = None) -> dict:
    """The result object. Each aggregation of each level is one grouped job over all outer buckets at once."""
    aggs = parse(aggs)
    return _level(df, aggs, []).get((), _empty(aggs))


def _empty(aggs: dict) -> dict:
    return {n: {"buckets": []} if k in BUCKETS else {"value": None} for n, (k, _, _) in aggs.items()}


def _level(df: DataFrame, aggs: dict, outer: list[str]) -> dict[tuple, dict]:
    """Results by the values of the ``outer`` key columns."""
    out: dict[tuple, dict] = {}
    metrics = metric_columns(df, aggs)
    if metrics and not outer:  # inner metrics come with the counts of their buckets
        out[()] = _metrics_of(df.agg(*(c.alias(n) for n, c in metrics.items())).first().asDict(), aggs)
    for name, (kind, p, sub) in aggs.items():
        if kind not in BUCKETS:
            continue
        key = f"_key{len(outer)}"
        rows = _keyed(df, kind, p, key)
        counts = rows.groupBy(*outer, key).agg(F.count(F.lit(1)).alias("doc_count"), *(c.alias(n) for n, c in metric_columns(rows, sub).items()))
        if kind == "terms":
            w = Window.partitionBy(*outer) if outer else Window.partitionBy(F.lit(0))
            ranked = w.orderBy(F.desc("doc_count"), F.asc(key))
            size = int(p.get("size", 10))
            if outer:
                counts = counts.withColumn("_all", F.sum("doc_count").over(w)).withColumn("_n", F.row_number().over(ranked)).filter(F.col("_n") <= size)
                counts = counts.orderBy(*outer, "_n")
            else:
                total = counts.agg(F.sum("doc_count")).first()[0] or 0
                counts = counts.orderBy(F.desc("doc_count"), F.asc(key)).limit(size).withColumn("_all", F.lit(total))
        else:
            counts = counts.orderBy(*outer, key)
        found = [r.asDict() for r in counts.limit(MAX_BUCKETS + 1).collect()]
        if len(found) > MAX_BUCKETS:
            raise QueryError(f"aggregations: {name} makes too many buckets")
        inner: dict[tuple, dict] = {}
        if any(k in BUCKETS for k, _, _ in sub.values()) and found:
            keep = [*outer, key]
            listed = counts.select(*keep)  # at most MAX_BUCKETS rows, checked above
            inner = _level(rows.join(F.broadcast(listed), keep, "left_semi") if kind == "terms" else rows, sub, keep)
        groups: dict[tuple, list] = {}
        for r in found:
            groups.setdefault(tuple(r[c] for c in outer), []).append(r)
        for at in groups or ({(): []} if not outer else {}):
            listed = {r[key]: r for r in groups.get(at, [])}
            if kind == "range":
                shown = [(k, {"doc_count": 0} | listed.get(k, {}), {x: v for x, v in (("from", a), ("to", b)) if v is not None}) for k, a, b in range_bounds(p)]
            else:
                shown = [(k, r, {}) for k, r in listed.items()]
            buckets = [{"key": str(k).lower() if isinstance(k, bool) else k, "doc_count": r["doc_count"]} | extra | (_metrics_of(r, sub) if r["doc_count"] else {}) | inner.get((*at, k), {}) for k, r, extra in shown]
            res: dict = {"buckets": buckets}
            if kind == "terms":
                every = groups[at][0]["_all"] if groups.get(at) else 0
                res |= {"sum_other_doc_count": every - sum(b["doc_count"] for b in buckets), "doc_count_error_upper_bound": 0}
            out.setdefault(at, {})[name] = res
    return out
