"""Full-text index splits: immutable folders of Parquet tables, published by one manifest.

A split holds ``docs`` (one row a document: ordinal, typed columns, stored
JSON, by rising ordinal with small row groups, so that a page reads a few of
them), ``postings`` (one row a term of a document, ranged and sorted by field,
path, term and ordinal, so that a term reads a few row groups and a term that
most documents hold still spreads over many files) and ``terms``
(the dictionary with document frequencies). ``meta.json`` appears last, by an
exclusive create: a split without it does not exist.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeglean.plans.errors import QueryError
from lakeglean.plans.schema import TYPES, Field, Schema
from lakeglean.plans.values import canonical_ip
from lakeglean.session import scratch, ship
from lakeglean.sources.fs import Fs

TERMS = "field string, path string, vtype string, term string, df long, cf long"
POSTINGS = "field string, path string, vtype string, term string, num double, _doc long, tf int, len int, positions array<int>"
#: Rows of a Parquet row group are kept few so that sorted terms prune well.
ROW_GROUP = 4 << 20
_VALUE_GAP = 1_000_000


def column_of(f: Field) -> str:
    return f"f_{f.name}"


def _rfc3339(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def json_object(parts: list[tuple[str, Column, T.DataType, bool]]) -> Column:
    """JSON object text: nulls left out, one value of many flattened, none of many left out."""
    def piece(name: str, c: Column) -> Column:
        return F.regexp_replace(F.to_json(F.struct(c.alias(name))), r"(?s)^\{(.*)\}$", "$1")

    out = []
    for name, c, kind, raw in parts:
        array = isinstance(kind, T.ArrayType)
        inner = kind.elementType if array else kind
        if isinstance(inner, (T.TimestampType, T.TimestampNTZType)):
            c = F.transform(c, _rfc3339) if array else _rfc3339(c)
        elif isinstance(inner, T.BinaryType):
            c = F.transform(c, F.base64) if array else F.base64(c)
        elif isinstance(inner, T.DecimalType):
            c = F.transform(c, lambda x: x.cast("decimal(38,0)")) if array else c
        if raw:
            key = F.lit(json.dumps(name) + ":")
            out.append(F.when(c.isNotNull(), F.concat(key, c)))
        elif array:
            out.append(F.when(F.size(c) == 1, piece(name, F.element_at(c, 1))).when(F.size(c) > 1, piece(name, c)))
        else:
            out.append(F.when(c.isNotNull(), piece(name, c)))
    if not out:
        return F.lit("{}")
    return F.concat(F.lit("{"), F.concat_ws(",", *out), F.lit("}"))


def _typed(f: Field, c: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
    """The input column cast to the field's type; a value that doesn't fit is an error."""
    array = isinstance(kind, T.ArrayType)
    inner = kind.elementType if array else kind
    want = TYPES[f.type]
    if f.type in ("text", "facet") and not isinstance(inner, T.StringType) and not f.coerce:
        raise QueryError(f"field {f.name!r} of type text cannot take {inner.simpleString()}")
    if f.type in ("i64", "u64", "f64") and isinstance(inner, (T.BooleanType, T.StructType, T.MapType)):
        raise QueryError(f"field {f.name!r} of type {f.type} cannot take {inner.simpleString()}")
    if f.type == "ip_addr":
        @F.pandas_udf("string")
        def ip(values: pd.Series) -> pd.Series:
            return values.map(lambda v: None if v is None else canonical_ip(v))

        cast = lambda x: ip(x)
    elif f.type == "json_object" and not isinstance(inner, T.StringType):
        cast = lambda x: F.to_json(x)
    else:
        cast = lambda x: x.cast(want)
    if array and f.type == "ip_addr":
        raise QueryError("ip_addr fields hold one value")
    return (F.transform(c, cast) if array else cast(c)), (T.ArrayType(want) if array else want)


def _leaves(value, path: str, out: list, analyzer, pos: dict) -> None:
    """(path, vtype, term, num, pos) of each leaf of a JSON value, text analysed."""
    if isinstance(value, dict):
        for k, v in value.items():
            _leaves(v, f"{path}.{k}" if path else k, out, analyzer, pos)
    elif isinstance(value, list):
        for v in value:
            _leaves(v, path, out, analyzer, pos)
    elif isinstance(value, bool):
        out.append((path, "b", str(value).lower(), float(value), pos.get(path, 0)))
    elif isinstance(value, (int, float)):
        out.append((path, "n", json.dumps(value), float(value), pos.get(path, 0)))
    elif isinstance(value, str):
        start, last = pos.get(path, 0), 0
        for i, t in analyzer.tokens(value):
            out.append((path, "s", t, None, start + i))
            last = i
        pos[path] = start + last + 2


class _Analyse:
    """mapInArrow function: rows of texts to postings, one for each term of a document.

    A document's terms are grouped where it is read, so tokens are never shuffled.
    ``_once`` is the document's length in its first row and 0 in the others.
    """

    def __init__(self, schema: dict, fields: list[str]):
        self.schema, self.fields = schema, fields

    def __call__(self, batches):
        import pyarrow as pa

        schema = Schema(self.schema["entries"], self.schema["analyzers"])
        fields = [(schema.fields[n], schema.analyzer(n)) for n in self.fields]
        for b in batches:
            sids, docs = b.column("_sid").to_pylist(), b.column("_doc").to_pylist()
            for f, analyzer in fields:
                rows = ([], [], [], [], [], [], [], [], [])
                values, ends = [], [0]
                for sid, doc, v in zip(sids, docs, b.column(column_of(f)).to_pylist()):
                    if v is None:
                        continue
                    groups: dict = {}
                    n = 0
                    if f.type == "json_object":
                        leaves: list = []
                        try:
                            _leaves(json.loads(v), "", leaves, analyzer, {})
                        except ValueError:
                            raise ValueError(f"not a JSON object: {v[:80]}") from None
                        for path, vtype, term, num, pos in leaves:
                            groups.setdefault((path, vtype, term, num), []).append(pos)
                        n = len(leaves)
                    else:
                        for k, text in enumerate(v if isinstance(v, list) else (v,)):
                            for pos, term in analyzer.tokens(text):
                                groups.setdefault(term, []).append(pos + k * _VALUE_GAP)
                                n += 1
                    for k, (key, at) in enumerate(groups.items()):
                        path, vtype, term, num = key if f.type == "json_object" else ("", "s", key, None)
                        for c, x in zip(rows, (path, vtype, term, num, doc, len(at), n, sid, 0 if k else n)):
                            c.append(x)
                        values += at
                        ends.append(len(values))
                paths, vtypes, terms, nums, own, tfs, lens, of, once = rows
                positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f.name] * len(own), pa.string()), pa.array(paths, pa.string()), pa.array(vtypes, pa.string()), pa.array(terms, pa.string()), pa.array(nums, pa.float64()),
                     pa.array(own, pa.int64()), pa.array(tfs, pa.int32()), pa.array(lens, pa.int32()), positions, pa.array(of, pa.string()), pa.array(once, pa.int32())],
                    ["field", "path", "vtype", "term", "num", "_doc", "tf", "len", "positions", "_sid", "_once"])


def build(df: DataFrame, path: str | None, schema, analyzers: dict | None = None, *, path_col: str | None = None, order: str | None = None) -> DataFrame:
    """Index ``df`` into one split at ``path``, or one for each value of ``path_col``.

    Returns (path, docs). Columns that the schema lacks and null values are
    left out; rows null in every field are documents of no value. ``order``
    names the column that gives the document order, otherwise rows keep the
    order they are read in. An existing target, a null path, an invalid schema
    or a value of the wrong type is an error and leaves nothing behind. No
    rows: no split, and no row in the result.
    """
    spark, schema = df.sparkSession, schema if isinstance(schema, Schema) else Schema(schema, analyzers)
    if (path is None) == (path_col is None):
        raise QueryError("name either a path or a column of paths")
    ship(spark)
    kinds: dict[str, T.DataType] = {}
    cols = [(F.lit(path) if path is not None else F.col(f"`{path_col}`").cast("string")).alias("_path")]
    for f in schema.fields.values():
        if f.name in df.columns:
            c, kinds[f.name] = _typed(f, F.col(f"`{f.name}`"), df.schema[f.name].dataType)
            cols.append(c.alias(column_of(f)))
    if order:
        df = df.orderBy(order)
    stage = scratch(spark, "index")
    df.select(*cols, F.monotonically_increasing_id().alias("_doc")).write.parquet(f"{stage}/raw")
    raw = spark.read.parquet(f"{stage}/raw")
    groups = raw.groupBy("_path").agg(F.count(F.lit(1)).alias("docs"), F.max("_doc").alias("last")).collect()
    if any(g["_path"] is None for g in groups):
        raise QueryError("the index path is null")
    fs = Fs(spark, stage)
    targets = {g["_path"]: uuid.uuid4().hex for g in groups}
    for p in targets:
        if Fs(spark, p).exists("meta.json"):
            raise FileExistsError(f"{p} exists")
    if not groups:
        return spark.createDataFrame([], "path string, docs long")
    sid = F.create_map(*(x for p, s in targets.items() for x in (F.lit(p), F.lit(s))))[F.col("_path")]
    raw = raw.withColumn("_sid", sid)
    fields = [f for f in schema.fields.values() if f.name in kinds]
    stored = json_object([(f.name, F.col(column_of(f)), kinds[f.name], f.type == "json_object") for f in fields if f.stored])
    kept = [f for f in fields if f.fast or f.column or f.stored and f.type == "text"]
    docs = raw.select("_sid", "_doc", *(column_of(f) for f in kept), stored.alias("_stored"))
    docs.write.option("parquet.block.size", ROW_GROUP).partitionBy("_sid").parquet(f"{stage}/docs")
    lengths: dict[str, dict] = {s: {} for s in targets.values()}
    texts = [f for f in fields if f.indexed and f.type in ("text", "json_object")]
    if texts:
        spread, cores = raw.select("_sid", "_doc", *(column_of(f) for f in texts)), spark.sparkContext.defaultParallelism
        if spread.rdd.getNumPartitions() < cores:  # small in bytes, but analysis is long in work
            spread = spread.repartition(cores, "_doc")
        # written once before it is ranged: sampling for the ranges would analyse every text again
        spread.mapInArrow(_Analyse(schema.to_json(), [f.name for f in texts]), f"{POSTINGS}, _sid string, _once int").write.parquet(f"{stage}/unsorted")
        once = spark.read.schema("field string, _sid string, _once int").parquet(f"{stage}/unsorted").groupBy("_sid", "field").agg(F.sum("_once").alias("n"))
        for r in once.collect():  # one row a split and field
            lengths[r["_sid"]][r["field"]] = r["n"]
        rows = spark.read.schema(f"{POSTINGS}, _sid string").parquet(f"{stage}/unsorted")
        (rows.repartitionByRange("_sid", "field", "path", "term", "_doc").sortWithinPartitions("_sid", "field", "path", "term", "_doc")
         .write.option("parquet.block.size", ROW_GROUP).partitionBy("_sid").parquet(f"{stage}/postings"))
    _finish(spark, fs, schema, {s: p for p, s in targets.items()}, {targets[g["_path"]]: (g["docs"], g["last"]) for g in groups}, {f.name: kinds[f.name].json() for f in kept}, docs.drop("_sid").schema, lengths)
    return spark.createDataFrame([(g["_path"], g["docs"]) for g in groups], "path string, docs long")


def from_json(df: DataFrame, doc_col: str, schema, analyzers: dict | None = None) -> DataFrame:
    """Typed columns, one for each field, from a column of JSON documents.

    One value or a list of them is taken for any field; a field with at most
    one value in every row is a plain column. Unknown fields and nulls are left
    out, rows with a null document too. A value that doesn't fit its field's
    type is an error when the result is read.
    """
    schema = schema if isinstance(schema, Schema) else Schema(schema, analyzers)
    v = F.parse_json(F.col(f"`{doc_col}`"))
    base = df.filter(F.col(f"`{doc_col}`").isNotNull())
    keep = [c for c in df.columns if c != doc_col and c not in schema.fields]
    cols = []
    for f in schema.fields.values():
        path, kind = "$['%s']" % f.name.replace("'", "\\'"), "string" if f.type in ("json_object", "bytes", "ip_addr", "facet") else TYPES[f.type].simpleString()
        raw = F.try_variant_get(v, path, "variant")
        if f.type == "date":
            one = F.coalesce(F.try_to_timestamp(F.try_variant_get(v, path, "string")), F.timestamp_millis(F.try_variant_get(v, path, "bigint")))
            many = F.transform(F.try_variant_get(v, path, "array<string>"), lambda x: F.try_to_timestamp(x))
        elif f.type == "json_object":
            one, many = F.to_json(raw), F.lit(None).cast("array<string>")
        else:
            typed = F.schema_of_variant(raw)
            fits = typed.isin("STRING") if f.type == "text" and not f.coerce else typed.isNotNull() if f.type in ("text", "bool") else typed != "BOOLEAN"
            one, many = F.when(fits & ~typed.startswith("ARRAY") & ~typed.startswith("OBJECT"), F.try_variant_get(v, path, kind)), F.try_variant_get(v, path, f"array<{kind}>")
            if f.type == "bytes":
                one, many = F.unbase64(one), F.transform(many, F.unbase64)
        got = F.when(one.isNotNull(), F.array(one)).otherwise(many)
        bad = raw.isNotNull() & ~F.is_variant_null(raw) & got.isNull()
        cols.append(F.when(bad, F.raise_error(F.lit(f"a value of field {f.name!r} is not {f.type}")).cast(got_type(f))).otherwise(F.filter(got, lambda x: x.isNotNull())).alias(f.name))
    wide = base.select(*(F.col(f"`{c}`") for c in keep), *cols)
    most = wide.agg(*(F.max(F.size(F.col(f"`{n}`"))).alias(n) for n in schema.fields)).first()
    return wide.select(*(F.col(f"`{c}`") for c in keep), *((F.col(f"`{n}`") if (most[n] or 0) > 1 else F.get(F.col(f"`{n}`"), F.lit(0))).alias(n) for n in schema.fields))


def got_type(f: Field) -> str:
    return f"array<{'string' if f.type == 'json_object' else TYPES[f.type].simpleString()}>"


def _finish(spark: SparkSession, fs: Fs, schema: Schema, path_of: dict[str, str], counts: dict, kinds: dict[str, str], docs_schema: T.StructType, lengths: dict[str, dict] | None = None) -> None:
    """Dictionary, lengths and manifest of staged splits, moved to their targets; the manifest last."""
    known = lengths is not None
    lengths = lengths or {s: {} for s in path_of}
    if fs.exists("postings"):
        postings = spark.read.schema(f"{POSTINGS}, _sid string").option("basePath", f"{fs.root}/postings").parquet(f"{fs.root}/postings")
        (postings.groupBy("_sid", "field", "path", "vtype", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
         .repartitionByRange("_sid", "field", "path", "term").sortWithinPartitions("_sid", "field", "path", "term")
         .write.partitionBy("_sid").parquet(f"{fs.root}/terms"))
        per_doc = postings.groupBy("_sid", "field", "_doc").agg(F.max("len").alias("len"))
        for r in [] if known else per_doc.groupBy("_sid", "field").agg(F.sum("len").alias("tokens")).collect():
            lengths[r["_sid"]][r["field"]] = r["tokens"]
    for sid, path in path_of.items():
        out = Fs(spark, path)
        out.mkdirs()
        for part in ("docs", "postings", "terms"):
            if fs.exists(f"{part}/_sid={sid}"):
                fs._fs.rename(fs.path(f"{part}/_sid={sid}"), out.path(f"{sid}-{part}"))
        meta = {"sid": sid, "docs": counts[sid][0], "last": counts[sid][1], "tokens": lengths[sid], "schema": schema.to_json(), "kinds": kinds,
                "docs_schema": docs_schema.jsonValue(), "parts": [p for p in ("docs", "postings", "terms") if out.exists(f"{sid}-{p}")]}
        if not out.put_if_absent("meta.json", json.dumps(meta)):
            for part in ("docs", "postings", "terms"):
                out.delete(f"{sid}-{part}")
            raise FileExistsError(f"{path} was published by another writer")
    fs.delete("")


class Split:
    """One published split."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.fs = spark, path.rstrip("/"), Fs(spark, path)
        if not self.fs.exists("meta.json"):
            raise FileNotFoundError(f"no index at {path}")
        self.meta = json.loads(self.fs.read_many(["meta.json"])[0])
        self.sid, self.docs = self.meta["sid"], self.meta["docs"]
        self.schema = Schema(self.meta["schema"]["entries"], self.meta["schema"]["analyzers"])
        self.kinds = {n: T._parse_datatype_json_string(k) for n, k in self.meta["kinds"].items()}

    def folder(self, part: str) -> str:
        return f"{self.path}/{self.sid}-{part}"

    def has(self, part: str) -> bool:
        return part in self.meta["parts"]

    def read(self, part: str, folders: list[str] | None = None) -> DataFrame:
        """One table of the split, or of several alike; the schema is known, so no footer is read to plan."""
        schema = {"docs": None, "postings": POSTINGS, "terms": TERMS}[part] or T.StructType.fromJson(self.meta["docs_schema"])
        return self.spark.read.schema(schema).parquet(*(folders or [self.folder(part)]))


def drop(spark: SparkSession, path: str | None) -> bool | None:
    """Unpublish a split; whether it was there. None for a null path."""
    if path is None:
        return None
    fs = Fs(spark, path)
    there = fs.exists("meta.json")
    if there:
        fs.delete("meta.json")
        for n in fs.names():
            fs.delete(n)
    return there


def merge(spark: SparkSession, paths: list[str], target: str, exclude_field: str | None = None, exclude=None) -> int:
    """Merge splits into one at ``target`` without analysing again; the documents kept.

    ``exclude`` (ids or a DataFrame of one id column) drops documents by
    ``exclude_field``, for good. Splits must be distinct and of one schema.
    """
    from lakeglean.operators.search import excluded_ids

    if not paths:
        raise QueryError("a nonempty list of splits is needed")
    splits = [Split(spark, p) for p in paths]
    if len({s.sid for s in splits}) < len(splits):
        raise QueryError("a split is listed twice")
    if any(s.meta["schema"] != splits[0].meta["schema"] for s in splits):
        raise QueryError("the splits have different schemas")
    if exclude is not None and exclude_field is None:
        raise QueryError("exclude needs exclude_field")
    if Fs(spark, target).exists("meta.json"):
        raise FileExistsError(f"{target} exists")
    sid, stage = uuid.uuid4().hex, scratch(spark, "merge")
    kinds: dict = {}
    for s in splits:
        kinds |= s.meta["kinds"]
    docs = postings = None
    base = 0
    for s in splits:
        d = s.read("docs").withColumn("_doc", F.col("_doc") + base)
        if exclude is not None:
            d = d.join(excluded_ids(spark, exclude, F.col(column_of(s.schema.fields[exclude_field])), d), column_of(s.schema.fields[exclude_field]), "left_anti")
        docs = d if docs is None else docs.unionByName(d, allowMissingColumns=True)
        if s.has("postings"):
            p = s.read("postings").withColumn("_doc", F.col("_doc") + base)
            postings = p if postings is None else postings.unionByName(p)
        base += s.meta["last"] + 1
    docs.withColumn("_sid", F.lit(sid)).sortWithinPartitions("_doc").write.option("parquet.block.size", ROW_GROUP).partitionBy("_sid").parquet(f"{stage}/docs")
    if postings is not None:
        if exclude is not None:  # the ordinals that were kept, read back instead of excluded anew
            postings = postings.join(spark.read.schema("_doc long").parquet(f"{stage}/docs/_sid={sid}"), "_doc", "left_semi")
        (postings.withColumn("_sid", F.lit(sid)).repartitionByRange("field", "path", "term", "_doc").sortWithinPartitions("field", "path", "term", "_doc")
         .write.option("parquet.block.size", ROW_GROUP).partitionBy("_sid").parquet(f"{stage}/postings"))
    kept = spark.read.parquet(f"{stage}/docs").count()
    if not kept:
        Fs(spark, stage).delete("")
        return 0
    _finish(spark, Fs(spark, stage), splits[0].schema, {sid: target}, {sid: (kept, base - 1)}, kinds, docs.schema,
            None if exclude is not None else {sid: {f: sum(s.meta["tokens"].get(f, 0) for s in splits) for s in splits for f in s.meta["tokens"]}})
    return kept
