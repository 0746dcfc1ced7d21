"""Searching splits: one shuffle scores a whole boolean tree.

Leaves are conditions on postings rows or on document columns. Each source row
is mapped to the flags and scores of the leaves it satisfies, rows are grouped
by document, and the tree is one Column over those aggregates. Pages are
ranked on (score, split, ordinal) alone; a page's ordinals are then literals of
the scan that fetches its documents.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeglean.operators.index import Split, column_of, json_object
from lakeglean.plans import ast
from lakeglean.plans.dsl import MoreLikeThis, compile_query
from lakeglean.plans.errors import QueryError
from lakeglean.plans.schema import Field
from lakeglean.session import ship

K1, B = 1.2, 0.75
#: A page of at most this many hits is ranked first and its documents are fetched by ordinal.
BROADCAST_PAGE = 10_000
#: Ranges of ordinals that the fetching scan is given; hits close to each other share one.
PAGE_RANGES = 64
#: A pattern that this many terms of the dictionary satisfy, or fewer, becomes the set of them.
EXPANSIONS = 1024
#: More splits than this are read by one scan instead of a union of scans.
UNION_SPLITS = 8

OPTIONS = {"top_k", "offset", "sort", "collapse", "highlight", "fields", "conjunctive", "strict", "fast", "exclude_field", "global_stats", "ignore_unmapped", "limit", "distinct"}
_REFUSED = {"search": {"limit", "distinct"}, "count": {"offset", "collapse", "sort", "highlight"}, "aggregate": {"offset", "collapse", "sort", "highlight", "limit", "distinct"}}


def options_of(options, function: str) -> dict:
    o = json.loads(options) if isinstance(options, str) else dict(options or {})
    if unknown := set(o) - OPTIONS:
        raise QueryError(f"unknown field {sorted(unknown)[0]!r} in options")
    if bad := sorted(k for k in o if k in _REFUSED[function] and o[k] is not None):
        raise QueryError(f"{bad[0]} does not work with {function}")
    for k in ("top_k", "offset", "limit"):
        if k in o and o[k] is not None and (isinstance(o[k], bool) or not isinstance(o[k], int) or o[k] < 0):
            raise QueryError(f"invalid {k}: {o[k]!r}")
    return o


# -- exclusion ---------------------------------------------------------------
def roaring_containers(blob: bytes) -> list[tuple[int, int, bytes]]:
    """(first id, kind, content) of each container of a portable roaring bitmap, of 32 bits or (a map of them) of 64.

    Kind 0 is runs, 1 a bitmap, 2 sorted numbers. Only heads are read here;
    contents have 8 KB at most and are decoded where they are needed.
    """
    def read32(at: int, high: int, out: list) -> int:
        cookie, = struct.unpack_from("<I", blob, at)
        at, runs = at + 4, b""
        if cookie & 0xFFFF == 12347:
            n = (cookie >> 16) + 1
            runs = blob[at:at + (n + 7) // 8]
            at += len(runs)
        elif cookie == 12346:
            n, = struct.unpack_from("<I", blob, at)
            at += 4
        else:
            raise ValueError
        heads = [struct.unpack_from("<HH", blob, at + 4 * i) for i in range(n)]
        at += 4 * n
        if not runs or n >= 4:
            at += 4 * n
        for i, (key, less) in enumerate(heads):
            if runs and runs[i // 8] >> i % 8 & 1:
                m, = struct.unpack_from("<H", blob, at)
                kind, start, size = 0, at + 2, 4 * m
            else:
                kind, start, size = (1, at, 8192) if less + 1 > 4096 else (2, at, 2 * (less + 1))
            at = start + size
            if at > len(blob):
                raise ValueError
            out.append((high << 32 | key << 16, kind, blob[start:at]))
        return at

    try:
        try:
            out: list = []
            if read32(0, 0, out) == len(blob):
                return out
        except (ValueError, struct.error):
            pass
        n, = struct.unpack_from("<Q", blob, 0)
        at, out = 8, []
        for _ in range(n):
            high, = struct.unpack_from("<I", blob, at)
            at = read32(at + 4, high, out)
        if at != len(blob):
            raise ValueError
        return out
    except (ValueError, struct.error):
        raise QueryError("exclude is not a roaring bitmap") from None


def container_ids(first: int, kind: int, content: bytes):
    """The ids of one container, as unsigned numbers."""
    import numpy as np

    if kind == 1:
        low = np.flatnonzero(np.unpackbits(np.frombuffer(content, np.uint8), bitorder="little"))
    else:
        low = np.frombuffer(content, "<u2").astype(np.int64)
        if kind == 0:
            start, length = low[::2], low[1::2] + 1
            low = np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())
    return low.astype(np.uint64) + np.uint64(first)


def roaring_ids(blob: bytes) -> list[int]:
    """All ids of a bitmap."""
    return [int(i) for c in roaring_containers(blob) for i in container_ids(*c)]


def _decoded(batches):
    """mapInArrow function: containers to their ids, by bit pattern."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        for first, kind, content in zip(*(b.column(i).to_pylist() for i in range(3))):
            yield pa.RecordBatch.from_arrays([pa.array(container_ids(int(first) % 2**64, kind, content).view(np.int64))], ["id"])


def excluded_ids(spark: SparkSession, exclude, key: Column, docs: DataFrame) -> DataFrame:
    """The ids to drop, as one column named and typed like the key; unsigned ids by their bit pattern.

    ``exclude`` is a DataFrame of one column, a bitmap, whose containers the
    executors decode, or an iterable of ids.
    """
    name = docs.select(key).columns[0]
    kind = docs.schema[name].dataType
    if isinstance(exclude, DataFrame):
        ids = exclude.select(F.col(exclude.columns[0]).cast(kind).alias(name))
        return ids.filter(F.col(name).isNotNull()).distinct()
    if isinstance(exclude, (bytes, bytearray)):
        rows = [((first + 2**63) % 2**64 - 2**63, k, c) for first, k, c in roaring_containers(bytes(exclude))]
        ids = spark.createDataFrame(rows, "first long, kind int, content binary").mapInArrow(_decoded, "id long")
    else:
        ids = spark.createDataFrame([((i + 2**63) % 2**64 - 2**63,) for i in exclude], "id long")
    if isinstance(kind, T.DecimalType):
        ids = ids.selectExpr("cast(id as decimal(20, 0)) + if(id < 0, 18446744073709551616, 0) as id")
    return ids.select(F.col("id").cast(kind).alias(name)).filter(F.col(name).isNotNull()).distinct()


# -- evaluation --------------------------------------------------------------
def _regex(p: ast.Pattern) -> str:
    return f"{'(?i)' if p.ignore_case else ''}^(?s:{p.text})$"


def osa_distance(a: str, b: str, limit: int) -> int:
    """Edit distance with adjacent transpositions (optimal string alignment), up to limit + 1."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, prev = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            cur.append(d)
        if min(cur) > limit:
            return limit + 1
        before, prev = prev, cur
    return prev[-1]


def _within(text: str, distance: int):
    @F.pandas_udf("boolean")
    def near(terms: pd.Series) -> pd.Series:
        return terms.map(lambda t: osa_distance(text, t, distance) <= distance)

    return near


def _ordinals(wanted: list[int]) -> Column:
    """Ordinals in at most ``PAGE_RANGES`` ranges that hold all of these: cut where the gaps are widest."""
    own = sorted(set(wanted))
    cuts = sorted(sorted(range(1, len(own)), key=lambda k: own[k - 1] - own[k])[: PAGE_RANGES - 1])
    out = None
    for a, b in zip([0, *cuts], [*cuts, len(own)]):
        lo, hi = own[a], own[b - 1]
        c = F.col("_doc") == lo if lo == hi else F.col("_doc").between(lo, hi)
        out = c if out is None else out | c
    return out


class Index:
    """A list of splits searched as one."""

    def __init__(self, spark: SparkSession, paths):
        self.spark = spark
        ship(spark)
        self.paths = [paths] if isinstance(paths, str) else list(paths)
        with ThreadPoolExecutor(min(16, max(len(self.paths), 1))) as pool:  # each reads one small file
            self.splits = list(pool.map(lambda p: Split(spark, p), self.paths))

    # -- sources -----------------------------------------------------------
    def _read(self, part: str, splits=None) -> DataFrame | None:
        """All splits' rows of one table with ``_split``, their place in the list."""
        out = None
        own = [(i, s) for i, s in enumerate(self.splits) if (splits is None or i in splits) and s.has(part)]
        if len(own) > UNION_SPLITS and len({json.dumps(s.meta["docs_schema"]) for _, s in own}) == 1:
            # one scan of all folders; the place in the list comes by the split's id in the file's path
            df = own[0][1].read(part, [s.folder(part) for _, s in own])
            places = self.spark.createDataFrame([(s.sid, i) for i, s in own], "_sid string, _split int")
            sid = F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", -2), "-", 1)
            return df.withColumn("_sid", sid).join(F.broadcast(places), "_sid").drop("_sid")
        for i, s in own:
            df = s.read(part).withColumn("_split", F.lit(i))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    def docs(self) -> DataFrame:
        return self._read("docs")

    # -- planning ----------------------------------------------------------
    def _trees(self, query, o: dict) -> list[ast.Node]:
        """One tree for each split, since schemas may differ."""
        kw = dict(fields=o.get("fields"), conjunctive=bool(o.get("conjunctive")), strict=bool(o.get("strict")), ignore_unmapped=bool(o.get("ignore_unmapped")))
        return [compile_query(query, s.schema, **kw) for s in self.splits]

    def _frequencies(self, keys: set[tuple[str, str, str]], splits: list[int]) -> dict[tuple[int, str, str, str], int]:
        """Document frequency of the query's terms; at most one row a term and split comes back."""
        terms = self._read("terms", splits)
        if terms is None or not keys:
            return {}
        keep = F.col("field").isin(sorted({k[0] for k in keys})) & F.col("term").isin(sorted({k[2] for k in keys})) & (F.col("vtype") == "s")
        out: dict = {}
        for r in terms.filter(keep).select("_split", "field", "path", "term", "df").collect():
            for path in (r["path"], "*"):
                k = (r["_split"], r["field"], path, r["term"])
                if (r["field"], path, r["term"]) in keys:
                    out[k] = max(out.get(k, 0), r["df"])
        return out

    def matches(self, query, o: dict, scored: bool = True, exclude=None) -> DataFrame:
        """(_split, _doc, score) of every match before ranking; exclusion applied, statistics untouched by it."""
        if exclude is not None and not o.get("exclude_field"):
            raise QueryError("exclude needs exclude_field")
        if not self.splits:
            return self.spark.createDataFrame([], "_split int, _doc long, score double")
        if o.get("global_stats") and len({json.dumps(s.meta["schema"]) for s in self.splits}) > 1:
            raise QueryError("global_stats needs splits of one schema")
        trees = self._trees(query, o)
        # splits that share a schema share a plan
        same: dict[str, list[int]] = {}
        for i, s in enumerate(self.splits):
            same.setdefault(json.dumps(s.meta["schema"]), []).append(i)
        out = None
        for members in same.values():
            part = _Evaluation(self, members, trees[members[0]], bool(o.get("global_stats")), scored).run()
            out = part if out is None else out.unionByName(part)
        if o.get("exclude_field"):
            f = self._fast(o["exclude_field"], ("i64", "u64"), "exclude_field")
            if exclude is not None:
                docs = self.docs().select("_split", "_doc", column_of(f))
                dead = docs.join(excluded_ids(self.spark, exclude, F.col(column_of(f)), docs), column_of(f), "left_semi").select("_split", "_doc")
                out = out.join(dead, ["_split", "_doc"], "left_anti")
        return out

    def _fast(self, name: str, types: tuple, what: str, single: bool = True) -> Field:
        for s in self.splits:
            f = s.schema.fields.get(name)
            if f is None:
                raise QueryError(f"unknown field {name!r}")
            if not f.fast:
                raise QueryError(f"field {name!r} is not fast")
            if f.type not in types:
                raise QueryError(f"{what}: field {name!r} has type {f.type}")
            if single and isinstance(s.kinds.get(name), T.ArrayType):
                raise QueryError(f"{what}: field {name!r} has several values")
        if len({s.schema.fields[name].type for s in self.splits}) > 1:
            raise QueryError(f"{what}: field {name!r} has different types")
        return self.splits[0].schema.fields[name]

    # -- search ------------------------------------------------------------
    def ranked(self, query, o: dict, exclude=None) -> DataFrame:
        """The page of hits as (_split, _doc, score, _sort): narrow rows, in rank order."""
        sort = o.get("sort")
        if sort is not None and o.get("collapse"):
            raise QueryError("sort does not work with collapse")
        hits = self.matches(query, o, sort is None, exclude)
        order = [F.desc("score"), F.asc("_split"), F.asc("_doc")]
        if sort is not None:
            spec = {"field": sort} if isinstance(sort, str) else dict(sort)
            if set(spec) - {"field", "order"} or spec.get("order", "asc") not in ("asc", "desc") or "field" not in spec:
                raise QueryError(f"invalid sort: {sort!r}")
            f = self._fast(spec["field"], ("i64", "u64", "f64", "date", "text"), "sort")
            keys = self.docs().select("_split", "_doc", F.col(column_of(f)).alias("_sort"))
            hits = hits.join(keys, ["_split", "_doc"]).withColumn("score", F.lit(None).cast("double"))
            order = [F.asc_nulls_last("_sort") if spec.get("order", "asc") == "asc" else F.desc_nulls_last("_sort"), F.asc("_split"), F.asc("_doc")]
        elif o.get("collapse"):
            from pyspark.sql import Window

            f = self._fast(o["collapse"], ("i64", "u64", "f64", "bool", "date", "text"), "collapse")
            keys = self.docs().select("_split", "_doc", F.col(column_of(f)).alias("_group"))
            w = Window.partitionBy("_group").orderBy(*order)
            hits = hits.join(keys, ["_split", "_doc"]).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_group")
        hits = hits.orderBy(*order)
        if o.get("offset"):
            hits = hits.offset(min(o["offset"], 2**31 - 1))
        if o.get("top_k") is not None:
            hits = hits.limit(min(o["top_k"], 2**31 - 1))
        return hits

    def search(self, query, options=None, exclude=None) -> DataFrame:
        """(score, doc, path, highlight) of each hit, in rank order; a null query has none."""
        o = options_of(options, "search")
        empty = "score double, doc string, path string, highlight string"
        if query is None or not self.splits:
            return self.spark.createDataFrame([], empty)
        shown, highlight = self._shown(o), self._highlight_fields(o)
        page = self.ranked(query, o, exclude)
        docs = self.docs()
        need = sorted({column_of(f) for f in highlight} & set(docs.columns))
        mark = self._marker(query, o, highlight) if o.get("highlight") else F.lit(None).cast("string")
        path = F.element_at(F.array(*(F.lit(p) for p in self.paths)), F.col("_split") + 1)
        out = [F.col("score"), F.col("doc"), path.alias("path"), mark.alias("highlight")]
        if o.get("top_k") is not None and o["top_k"] <= BROADCAST_PAGE:
            found = page.select("_split", "_doc", "score").collect()  # the page, at most BROADCAST_PAGE narrow rows
            if not found:
                return self.spark.createDataFrame([], empty)
            placed = self.spark.createDataFrame([(r[0], r[1], r[2], n) for n, r in enumerate(found)], "_split int, _doc long, score double, _rank int")
            # JSON is built behind the join, of the page alone
            hits = docs.filter(_ordinals([r[1] for r in found])).join(F.broadcast(placed), ["_split", "_doc"])
            return hits.select("_rank", "_split", "score", shown(docs).alias("doc"), *need).orderBy("_rank").limit(len(found)).select(*out)
        if "_sort" not in page.columns:
            page = page.withColumn("_sort", F.lit(None).cast("string"))
        hits = docs.join(page, ["_split", "_doc"]).select("_sort", "_split", "_doc", "score", shown(docs).alias("doc"), *need)
        order = [F.desc("score"), F.asc("_split"), F.asc("_doc")]
        if o.get("sort") is not None:
            down = isinstance(o["sort"], dict) and o["sort"].get("order") == "desc"
            order = [F.desc_nulls_last("_sort") if down else F.asc_nulls_last("_sort"), F.asc("_split"), F.asc("_doc")]
        return hits.orderBy(*order).select(*out)

    def _shown(self, o: dict):
        """Function from the docs table to the JSON column of a hit."""
        fast = o.get("fast")
        if fast is None:
            return lambda d: F.col("_stored")
        parts = []
        for name in fast:
            found = None
            for s in self.splits:
                t = s.schema.resolve(name)
                if t is None:
                    raise QueryError(f"unknown field {name!r}")
                if not t[0].fast:
                    raise QueryError(f"field {name!r} is not fast")
                found = t
            parts.append((name, *found))

        def make(d: DataFrame) -> Column:
            cols = []
            for name, f, path in parts:
                c = column_of(f)
                if c not in d.columns:
                    continue
                if path:
                    cols.append((name, F.get_json_object(c, "$." + path), T.StringType(), False))
                else:
                    cols.append((name, F.col(c), d.schema[c].dataType, f.type == "json_object"))
            return json_object(cols)

        return make

    def _highlight_fields(self, o: dict) -> list[Field]:
        h = o.get("highlight")
        if h is None:
            return []
        if not isinstance(h, dict) or set(h) - {"fields", "max_chars"} or not h.get("fields"):
            raise QueryError("unknown field in highlight, or no fields")
        out = []
        for n in h["fields"]:
            f = self.splits[0].schema.fields.get(n)
            if f is None or f.type != "text" or not f.stored:
                raise QueryError(f"highlight: field {n!r} is not stored text")
            out.append(f)
        return out

    def _marker(self, query, o: dict, fields: list[Field]) -> Column:
        from lakeglean.functions.highlight import highlighter

        s = self.splits[0]
        tree = self._trees(query, o)[0]
        wanted: dict[str, list] = {f.name: [] for f in fields}

        def walk(n: ast.Node) -> None:
            if isinstance(n, MoreLikeThis):
                for (field, _, t) in n.counts:
                    if field in wanted:
                        wanted[field].append(("term", t))
                return
            if isinstance(n, ast.Bool):
                for c in [*n.must, *n.should, *n.filter]:
                    walk(c)
                return
            if getattr(n, "field", None) in wanted:
                if isinstance(n, ast.Term):
                    wanted[n.field].append(("term", n.term))
                elif isinstance(n, ast.TermSet):
                    wanted[n.field] += [("term", t) for t in n.terms]
                elif isinstance(n, ast.Phrase):
                    wanted[n.field] += [("term", t) for _, t in n.terms]
                elif isinstance(n, ast.Pattern) and n.kind != "fuzzy":
                    wanted[n.field].append((n.kind, n.text if n.kind == "prefix" else _regex(n)))
                elif isinstance(n, ast.Pattern):
                    wanted[n.field].append(("fuzzy", (n.text, n.distance)))
            for c in ast.children(n):
                walk(c)

        walk(tree)
        mark = highlighter({f.name: s.schema.analyzer(f.name) for f in fields}, wanted, int(o["highlight"].get("max_chars", 150)))
        return mark(F.struct(*(F.col(column_of(f)).alias(f.name) for f in fields)))

    # -- count -------------------------------------------------------------
    def count(self, query, options=None, exclude=None) -> int | None:
        """Number of matches; with ``limit`` at most that, with ``distinct`` the values of a field."""
        o = options_of(options, "count")
        if query is None:
            return None
        if not self.splits:
            return 0
        if o.get("distinct") and o.get("limit") is not None:
            raise QueryError("distinct does not work with limit")
        return self.count_frame(query, o, exclude).first()[0]

    def count_frame(self, query, options=None, exclude=None) -> DataFrame:
        """The same as one row (n)."""
        o = options_of(options, "count")
        if exclude is None and not o.get("distinct") and not o.get("exclude_field") and (n := self._known_count(query, o)) is not None:
            return self.spark.createDataFrame([(n if o.get("limit") is None else min(n, o["limit"]),)], "n long")
        hits = self.matches(query, o, False, exclude)
        if o.get("distinct"):
            f = self._fast(o["distinct"], ("i64", "u64", "f64", "bool", "date", "text"), "distinct")
            keys = self.docs().select("_split", "_doc", F.col(column_of(f)).alias("v"))
            return hits.join(keys, ["_split", "_doc"]).agg(F.countDistinct("v").alias("n"))
        if o.get("limit") is not None:
            return hits.limit(o["limit"] + 1).agg(F.least(F.count(F.lit(1)), F.lit(o["limit"])).alias("n"))
        return hits.agg(F.count(F.lit(1)).alias("n"))

    def _known_count(self, query, o: dict) -> int | None:
        """The matches of a single term, from the dictionary alone; None for any other query."""
        trees = self._trees(query, o)
        if not all(isinstance(t, ast.Term) and t.path != "*" and not s.schema.fields[t.field].column for t, s in zip(trees, self.splits)):
            return None
        return sum(n for i, t in enumerate(trees) for n in self._frequencies({(t.field, t.path, t.term)}, [i]).values())

    # -- aggregate ---------------------------------------------------------
    def matched_docs(self, query, options=None, exclude=None) -> DataFrame:
        """Fast columns, by field name, of every match."""
        o = options_of(options, "aggregate")
        docs = self.docs()
        fast = {n: column_of(f) for s in self.splits for n, f in s.schema.fields.items() if f.fast and column_of(f) in docs.columns}
        return docs.join(self.matches(query, o, False, exclude).select("_split", "_doc"), ["_split", "_doc"]).select(*(F.col(c).alias(n) for n, c in fast.items()))

    def aggregate(self, query, aggs, options=None, exclude=None) -> str | None:
        """JSON text of the requested aggregations over all matches."""
        from lakeglean.operators.aggregations import aggregate

        if query is None:
            return None
        fields = {n: f for s in self.splits for n, f in s.schema.fields.items()}
        return json.dumps(aggregate(self.matched_docs(query, options, exclude), aggs, fields))


class _Evaluation:
    """Evaluates one tree over splits of one schema."""

    def __init__(self, index: Index, members: list[int], tree: ast.Node, global_stats: bool, scored: bool):
        self.ix, self.members, self.global_stats, self.scored = index, members, global_stats, scored
        self.splits = [index.splits[i] for i in members]
        self.schema = self.splits[0].schema
        self.tree = self._resolve(tree)
        self.leaves: list[ast.Node] = []
        self._number(self.tree)

    def _resolve(self, tree: ast.Node) -> ast.Node:
        if isinstance(tree, MoreLikeThis):
            found = self.ix._frequencies(set(tree.counts), self.members)
            total: dict = {}
            for (_, *k), n in found.items():
                total[tuple(k)] = total.get(tuple(k), 0) + n
            out = tree.resolve(total, sum(s.docs for s in self.splits))
            out.boost *= tree.boost
            return out
        if isinstance(tree, ast.Bool):
            for k in ("must", "should", "must_not", "filter"):
                setattr(tree, k, [self._resolve(c) for c in getattr(tree, k)])
        elif isinstance(tree, ast.DisMax):
            tree.queries = [self._resolve(c) for c in tree.queries]
        elif isinstance(tree, ast.Constant):
            tree.query = self._resolve(tree.query)
        return tree

    def _number(self, n: ast.Node) -> None:
        if isinstance(n, ast.LEAVES):
            n.id = len(self.leaves)
            self.leaves.append(n)
        for c in ast.children(n):
            self._number(c)

    # -- statistics --------------------------------------------------------
    def _statistics(self) -> None:
        keys = {(n.field, n.path, n.term) for n in self.leaves if isinstance(n, ast.Term)}
        for n in self.leaves:
            if isinstance(n, ast.Phrase):
                keys |= {(n.field, n.path, t) for _, t in n.terms}
        df = self.ix._frequencies(keys, self.members)
        if self.global_stats:
            total: dict = {}
            for (_, *k), n in df.items():
                total[tuple(k)] = total.get(tuple(k), 0) + n
            df = {(i, *k): n for k, n in total.items() for i in self.members}
        self.df = df
        docs = {i: s.docs for i, s in zip(self.members, self.splits)}
        tokens = {i: s.meta["tokens"] for i, s in zip(self.members, self.splits)}
        if self.global_stats:
            n = sum(docs.values())
            every = {f: sum(t.get(f, 0) for t in tokens.values()) for t in tokens.values() for f in t}
            docs, tokens = {i: n for i in docs}, {i: every for i in docs}
        self.docs, self.tokens = docs, tokens

    def _per_split(self, value) -> str:
        """A number that depends on the split; one literal where all agree."""
        own = {i: value(i) for i in self.members}
        if len(set(own.values())) == 1:
            return _number(next(iter(own.values())))
        return f"element_at(array({', '.join(_number(own.get(i, 0.0)) for i in range(len(self.ix.splits)))}), _split + 1)"

    def _idf(self, field: str, path: str, term: str) -> str:
        def idf(i: int) -> float:
            n, df = self.docs[i], self.df.get((i, field, path, term), 0)
            return math.log(1 + (n - df + 0.5) / (df + 0.5))

        return self._per_split(idf)

    def _norm(self, field: str, tf: str, length: str) -> str:
        avg = self._per_split(lambda i: max(self.tokens[i].get(field, 0), 1) / max(self.docs[i], 1))
        return f"({tf} * {_number(K1 + 1)} / ({tf} + {_number(K1)} * ({_number(1 - B)} + {_number(B)} * {length} / {avg})))"

    # -- leaves ------------------------------------------------------------
    def _at(self, n) -> str:
        c = f"field = {_text(n.field)}"
        return c if n.path == "*" else f"{c} and path = {_text(n.path)}"

    def _on_docs(self, n: ast.Node) -> bool:
        f = self.schema.fields[n.field]
        if isinstance(n, ast.Compare):
            return f.column
        if isinstance(n, ast.Exists):
            return f.column or f.fast and not n.path and f.type == "text"
        return f.column  # patterns and terms on facets

    def _condition(self, n: ast.Node) -> str:
        """The rows of ``postings`` that satisfy a leaf (a phrase: that may take part in it).

        Written as SQL, like all that is evaluated on postings: one call builds
        what would take a dozen for each leaf.
        """
        if isinstance(n, ast.Exists):
            c = f"field = {_text(n.field)}"
            return f"({c} and (path = {_text(n.path)} or startswith(path, {_text(n.path + '.')})))" if n.path else f"({c})"
        if isinstance(n, ast.Compare):
            on, cast = ("term", _text) if n.vtype == "s" else ("num", _number)
            tests = [f"{on} in ({', '.join(map(cast, v))})" if k == "in" else f"{on} {_OPS[k]} {cast(v)}" for k, v in n.ops.items()]
            return f"({' and '.join([self._at(n), f'vtype = {_text(n.vtype)}', *tests])})"
        at = f"{self._at(n)} and vtype = 's'"
        if isinstance(n, ast.Term):
            return f"({at} and term = {_text(n.term)})"
        if isinstance(n, ast.TermSet):
            return f"({at} and {_among(n.terms)})"
        if isinstance(n, ast.Pattern):
            text = _text(n.text)
            if n.kind == "prefix":
                return f"({at} and startswith(lower(term), {_text(n.text.lower())}))" if n.ignore_case else f"({at} and startswith(term, {text}))"
            if n.kind == "regex":
                return self._expanded(at, f"term rlike {_text(_regex(n))}")
            if not n.distance:
                return f"({at} and term = {text})"
            if not n.transpositions:
                return self._expanded(at, f"levenshtein(term, {text}, {n.distance}) >= 0")
            # a transposition is two edits of the JVM's distance, which narrows the dictionary
            near = f"lakeglean_near_{uuid.uuid4().hex}"
            self.ix.spark.udf.register(near, _within(n.text, n.distance))
            return self._expanded(at, f"levenshtein(term, {text}, {2 * n.distance}) >= 0 and {near}(term)")
        terms = [t for _, t in (n.terms[:-1] if n.prefix_last else n.terms)]
        return f"({at} and {_among([*terms, *(self._expansions(n) if n.prefix_last else [])])})"

    def _expansions(self, n: ast.Phrase) -> list[str]:
        """The first terms, in order, that start with a phrase's last word."""
        terms = self.ix._read("terms", self.members)
        keep = f"{self._at(n)} and vtype = 's' and startswith(term, {_text(n.terms[-1][1])})"
        return [r[0] for r in terms.filter(keep).select("term").distinct().orderBy("term").limit(n.max_expansions).collect()] if terms is not None else []

    def _expanded(self, at: str, test: str) -> str:
        """The postings of a pattern: tested on the dictionary, if few terms satisfy it, else on the postings themselves."""
        terms = self.ix._read("terms", self.members)
        if terms is None:
            return "false"
        found = [r[0] for r in terms.filter(f"{at} and {test}").select("term").distinct().limit(EXPANSIONS + 1).collect()]
        return f"({at} and {test})" if len(found) > EXPANSIONS else f"({at} and {_among(found)})"

    def _on_columns(self, n: ast.Node) -> Column:
        """The rows of ``docs`` that satisfy a leaf."""
        f = self.schema.fields[n.field]
        c, kind = F.col(column_of(f)), self.splits[0].kinds.get(f.name)
        if kind is None:
            return F.lit(False)
        if isinstance(n, ast.Exists):
            return (F.size(c) > 0) if isinstance(kind, T.ArrayType) else c.isNotNull()
        if isinstance(n, ast.Compare):
            test = lambda x: _compare(x, n.ops, lambda v: v)
        elif isinstance(n, ast.Pattern):
            test = (lambda x: x.startswith(n.text)) if n.kind == "prefix" else (lambda x: x.rlike(_regex(n)))
        else:
            test = lambda x: x.isin(list(n.terms) if isinstance(n, ast.TermSet) else [n.term])
        return F.coalesce(F.exists(c, test) if isinstance(kind, T.ArrayType) else test(c), F.lit(False))

    # -- running -----------------------------------------------------------
    def run(self) -> DataFrame:
        self._statistics()
        on_docs = [n for n in self.leaves if self._on_docs(n)]
        on_postings = [n for n in self.leaves if n not in on_docs]
        every = self._everywhere(self.tree)
        sources = []
        ids = [n.id for n in self.leaves]
        if on_postings and (postings := self.ix._read("postings", self.members)) is not None:
            conditions = {n.id: self._condition(n) for n in on_postings}
            cols = []
            for n in self.leaves:
                own = conditions.get(n.id, "false")
                cols += [f"{own} as f{n.id}", f"{self._contribution(n, own)} as s{n.id}"]
            for n in self.leaves:
                if isinstance(n, ast.Phrase):
                    for k, (_, t) in enumerate(n.terms):
                        test = f"startswith(term, {_text(t)})" if n.prefix_last and k == len(n.terms) - 1 else f"term = {_text(t)}"
                        cols.append(f"if({conditions[n.id]} and {test}, positions, null) as p{n.id}_{k}")
                    cols.append(f"if({conditions[n.id]}, len, null) as l{n.id}")
            sources.append(postings.filter(" or ".join(dict.fromkeys(conditions.values()))).selectExpr("_split", "_doc", *cols))
        if on_docs or every:
            docs = self.ix._read("docs", self.members)
            flags = {n.id: self._on_columns(n) for n in on_docs}
            if not every:
                keep = None
                for c in flags.values():
                    keep = c if keep is None else keep | c
                docs = docs.filter(keep)
            cols = []
            for n in self.leaves:
                cols.append(flags.get(n.id, F.lit(False)).alias(f"f{n.id}"))
                cols.append((F.when(flags[n.id], F.lit(1.0)).otherwise(0.0) if n.id in flags else F.lit(0.0)).alias(f"s{n.id}"))
            for n in self.leaves:
                if isinstance(n, ast.Phrase):
                    cols += [F.lit(None).cast("array<int>").alias(f"p{n.id}_{k}") for k in range(len(n.terms))] + [F.lit(None).cast("int").alias(f"l{n.id}")]
            sources.append(docs.select("_split", "_doc", *cols))
        if not sources:
            return self.ix.spark.createDataFrame([], "_split int, _doc long, score double")
        rows = sources[0] if len(sources) == 1 else sources[0].unionByName(sources[1])
        aggs = []
        for i in ids:
            n = self.leaves[i]
            aggs.append(f"max(f{i}) as f{i}")
            if self.scored and not isinstance(n, ast.Phrase):
                aggs.append(f"{'sum' if isinstance(n, ast.Term) else 'max'}(s{i}) as s{i}")
            if isinstance(n, ast.Phrase):
                aggs += [f"flatten(collect_list(p{i}_{k})) as p{i}_{k}" for k in range(len(n.terms))] + [f"max(l{i}) as l{i}"]
        grouped = rows.groupBy("_split", "_doc").agg(*map(F.expr, aggs or ["1 as one"]))
        phrases = [n for n in self.leaves if isinstance(n, ast.Phrase)]
        if phrases:
            grouped = grouped.selectExpr("*", *(f"cast({self._frequency(n)} as double) as s{n.id}" for n in phrases))
            grouped = grouped.drop(*(f"f{n.id}" for n in phrases)).selectExpr("*", *(f"s{n.id} > 0 as f{n.id}" for n in phrases))
        score = self._score(self.tree) if self.scored else "null"
        return grouped.filter(self._flag(self.tree)).selectExpr("_split", "_doc", f"cast({score} as double) as score")

    def _contribution(self, n: ast.Node, condition: str) -> str:
        if not self.scored or isinstance(n, ast.Phrase) or condition == "false":
            return "0D"
        if isinstance(n, ast.Term):
            return f"if({condition}, {self._idf(n.field, n.path, n.term)} * {self._norm(n.field, 'tf', 'len')}, 0D)"
        return f"if({condition}, 1D, 0D)"

    def _frequency(self, n: ast.Phrase) -> str:
        """Starts at which every term lies at its offset, with at most ``slop`` displacement in total."""
        rest = [(off, f"p{n.id}_{k}") for k, (off, _) in enumerate(n.terms)][1:]
        if not n.slop:
            test = " and ".join(f"array_contains({col}, cast(x + {off} as int))" for off, col in rest) or "true"
        else:
            gaps = " + ".join(f"array_min(transform({col}, y -> abs(y - x - {off})))" for off, col in rest) or "0"
            test = f"coalesce({gaps} <= {n.slop}, false)"
        return f"size(filter(p{n.id}_0, x -> {test}))"

    def _everywhere(self, n: ast.Node) -> bool:
        """Whether a document without any satisfied leaf can match."""
        if isinstance(n, ast.MatchAll):
            return True
        if isinstance(n, ast.Bool):
            needed = [*n.must, *n.filter]
            if any(not self._everywhere(c) for c in needed):
                return False
            return n.minimum <= sum(self._everywhere(c) for c in n.should)
        if isinstance(n, ast.DisMax):
            return any(self._everywhere(c) for c in n.queries)
        return isinstance(n, ast.Constant) and self._everywhere(n.query)

    def _flag(self, n: ast.Node) -> str:
        if isinstance(n, ast.LEAVES):
            return f"coalesce(f{n.id}, false)"
        if isinstance(n, (ast.MatchAll, ast.MatchNone)):
            return str(isinstance(n, ast.MatchAll)).lower()
        if isinstance(n, ast.Constant):
            return self._flag(n.query)
        if isinstance(n, ast.DisMax):
            return self._any(n.queries)
        c = [self._flag(x) for x in [*n.must, *n.filter]] + [f"not {self._flag(x)}" for x in n.must_not]
        if n.minimum == 1:
            c.append(self._any(n.should))
        elif n.minimum > 1:
            c.append(f"({' + '.join(f'if({self._flag(x)}, 1, 0)' for x in n.should) or '0'}) >= {n.minimum}")
        return f"({' and '.join(c)})" if c else "true"

    def _any(self, nodes: list[ast.Node]) -> str:
        return f"({' or '.join(self._flag(x) for x in nodes)})" if nodes else "false"

    def _score(self, n: ast.Node) -> str:
        """0 where a node does not match."""
        b = _number(n.boost)
        if isinstance(n, ast.Phrase):
            idf = " + ".join(self._idf(n.field, n.path, t) for _, t in n.terms)
            return f"if(s{n.id} > 0, {b} * ({idf}) * {self._norm(n.field, f's{n.id}', f'l{n.id}')}, 0D)"
        if isinstance(n, ast.LEAVES):
            return f"({b} * s{n.id})"
        if isinstance(n, ast.MatchAll):
            return b
        if isinstance(n, ast.MatchNone):
            return "0D"
        if isinstance(n, ast.Constant):
            return f"if({self._flag(n.query)}, {b}, 0D)"
        scores = [self._score(c) for c in (n.queries if isinstance(n, ast.DisMax) else [*n.must, *n.should])]
        total = f"({' + '.join(scores)})" if scores else "0D"
        if isinstance(n, ast.DisMax):
            top = f"greatest({', '.join(scores)})" if len(scores) > 1 else scores[0]
            return f"({b} * ({top} + {_number(n.tie)} * ({total} - {top})))"
        return f"if({self._flag(n)}, {b} * {total}, 0D)"


_OPS = {"eq": "=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def _text(v: str) -> str:
    """The string as a literal of Spark's SQL."""
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(v: float) -> str:
    v = float(v)
    return f"{v!r}D" if math.isfinite(v) else f"cast('{v}' as double)"


def _among(terms) -> str:
    return f"term in ({', '.join(map(_text, terms))})" if terms else "false"


def _compare(c: Column, ops: dict, cast) -> Column:
    out = F.lit(True)
    for k, v in ops.items():
        if k == "in":
            out = out & c.isin([cast(x) for x in v])
        else:
            v = F.lit(cast(v))
            out = out & {"eq": c == v, "gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[k]
    return out
