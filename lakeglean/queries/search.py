"""Queries fts_*, agg_* and json_*: full-text search over documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeglean.operators import aggregations, index
from lakeglean.operators.search import Index
from lakeglean.session import scratch, table

_opt = lambda tok=None, **k: k | ({"indexing": {"tokenizer": tok}} if tok else {})
DOCUMENTS = [
    {"name": "doc_id", "type": "i64", "options": _opt(stored=True, fast=True)},
    {"name": "text", "type": "text", "options": _opt(stored=True)},
    {"name": "lang", "type": "text", "options": _opt("raw", fast=True)},
    {"name": "source", "type": "text", "options": _opt("raw", fast=True)},
    {"name": "tag", "type": "text", "options": _opt("raw", fast=True)},
    {"name": "n_chars", "type": "i64", "options": _opt(fast=True)},
]
EVENTS = [
    {"name": "event_id", "type": "i64", "options": _opt(stored=True, fast=True)},
    {"name": "event_type", "type": "text", "options": _opt("raw", fast=True)},
    {"name": "value", "type": "f64", "options": _opt(fast=True)},
    {"name": "ts", "type": "date", "options": _opt(fast=True)},
    {"name": "props", "type": "json_object", "options": _opt(fast=True)},
]
_BUILT: dict[tuple, list[str]] = {}


def documents_index(spark: SparkSession, d: str) -> Index:
    """The documents in one split, built once for each application and input."""
    return _index(spark, d, "documents", DOCUMENTS, "doc_id")


def events_index(spark: SparkSession, d: str) -> Index:
    return _index(spark, d, "events", EVENTS, "event_id")


def _index(spark: SparkSession, d: str, name: str, schema: list, order: str) -> Index:
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _BUILT:
        path = scratch(spark, f"index-{name}")
        index.build(table(spark, d, name), path, schema, order=order)
        _BUILT[key] = [path]
    return Index(spark, _BUILT[key])


def halves(spark: SparkSession, d: str) -> Index:
    """The documents in two splits, even and odd ids, made by one build."""
    key = (spark.sparkContext.applicationId, d, "halves")
    if key not in _BUILT:
        root = scratch(spark, "index-halves")
        df = table(spark, d, "documents").withColumn("at", F.concat(F.lit(f"{root}/"), F.pmod("doc_id", F.lit(2))))
        index.build(df, None, DOCUMENTS, path_col="at", order="doc_id")
        _BUILT[key] = [f"{root}/0", f"{root}/1"]
    return Index(spark, _BUILT[key])


def hits(ix: Index, query, options: dict | None = None, exclude=None, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of a search, the score rounded for comparison."""
    h = ix.search(query, {"fast": [id_col]} | (options or {}), exclude)
    return h.select(F.get_json_object("doc", f"$.{id_col}").cast("long").alias(id_col), F.round("score", 6).alias("score"))


def _on_documents(query, options=None):
    return lambda spark, d: hits(documents_index(spark, d), query, options)


def _excluded(spark: SparkSession, d: str) -> DataFrame:
    """Documents of odd character counts: a set to be treated as deleted."""
    return table(spark, d, "documents").filter("n_chars % 2 = 1").select("doc_id")


def fts_token_stats(spark, d):
    ix = documents_index(spark, d)
    p = ix._read("postings").filter("field = 'text'")
    return p.agg(F.sum("tf").alias("n_tokens"), F.countDistinct("term").alias("n_terms"), F.countDistinct("_doc").alias("n_docs"))


def fts_doc_freq(spark, d):
    return documents_index(spark, d)._read("terms").filter("field = 'text'").select("term", "df", "cf")


def fts_doc_lengths(spark, d):
    ix = documents_index(spark, d)
    one = ix._read("postings").filter("field = 'text'").groupBy("_doc").agg(F.max("len").cast("long").alias("n_tokens"))
    return one.join(ix.docs().select("_doc", F.col("f_doc_id").alias("doc_id")), "_doc").select("doc_id", "n_tokens")


def fts_build_counts_by_group(spark, d):
    root = scratch(spark, "index-groups")
    df = table(spark, d, "documents").withColumn("at", F.concat(F.lit(f"{root}/"), F.coalesce("lang", F.lit("none"))))
    return index.build(df, None, DOCUMENTS, path_col="at", order="doc_id").select(F.regexp_extract("path", "([^/]+)$", 1).alias("lang"), "docs")


def fts_count(spark, d):
    return documents_index(spark, d).count_frame("canary OR footer")


def fts_count_limit(spark, d):
    return documents_index(spark, d).count_frame("the", {"limit": 100})


def fts_count_distinct(spark, d):
    return documents_index(spark, d).count_frame("the", {"distinct": "source"})


def fts_exclude_topk(spark, d):
    return hits(documents_index(spark, d), "canary footer", {"top_k": 20, "exclude_field": "doc_id"}, _excluded(spark, d))


def fts_global_stats(spark, d):
    return hits(halves(spark, d), "canary gable", {"global_stats": True})


def fts_local_stats(spark, d):
    return hits(halves(spark, d), "canary gable")


def fts_merge_counts(spark, d):
    ix, target = halves(spark, d), scratch(spark, "merged")
    kept = index.merge(spark, ix.paths, target, "doc_id", _excluded(spark, d))
    both = Index(spark, target)
    return both.count_frame("canary OR footer").withColumn("docs", F.lit(kept).cast("long"))


def fts_merged_top10(spark, d):
    target = scratch(spark, "merged")
    index.merge(spark, halves(spark, d).paths, target, "doc_id", _excluded(spark, d))
    return hits(Index(spark, target), "canary footer", {"top_k": 10})


def fts_highlight(spark, d):
    h = documents_index(spark, d).search("canary", {"top_k": 50, "fast": ["doc_id"], "highlight": {"fields": ["text"], "max_chars": 80}})
    snippet = F.get_json_object("highlight", "$.text")
    bare = F.regexp_replace(F.regexp_replace(snippet, "</?b>", ""), "&(amp|lt|gt|quot|#39);", "&")
    return h.select(F.get_json_object("doc", "$.doc_id").cast("long").alias("doc_id"), (F.lower(snippet).contains("<b>canary</b>") & (F.length(bare) <= 80)).alias("marked"))


def fts_more_like_this(spark, d):
    q = {"more_like_this": {"like": "the canary checked every footer of the ledger before the budget was sealed", "fields": ["text"], "min_doc_freq": 2, "max_query_terms": 5}}
    return hits(documents_index(spark, d), q, {"top_k": 20})


def fts_collapse_source(spark, d):
    ix = documents_index(spark, d)
    h = ix.search("canary footer", {"collapse": "source", "fast": ["doc_id", "source"]})
    return h.select(F.get_json_object("doc", "$.source").alias("source"), F.get_json_object("doc", "$.doc_id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"))


def fts_sort_field_desc(spark, d):
    h = documents_index(spark, d).search("canary", {"sort": {"field": "n_chars", "order": "desc"}, "top_k": 25, "fast": ["doc_id", "n_chars"]})
    return h.select(F.get_json_object("doc", "$.doc_id").cast("long").alias("doc_id"), F.get_json_object("doc", "$.n_chars").cast("long").alias("n_chars"), "score")


def fts_stored_doc(spark, d):
    h = documents_index(spark, d).search("canary", {"top_k": 10})
    return h.select(F.get_json_object("doc", "$.doc_id").cast("long").alias("doc_id"), F.get_json_object("doc", "$.text").alias("text"))


def fts_macro_create_and_match(spark, d):
    from lakeglean.plans.macros import create_index, match_bm25

    docs = table(spark, d, "documents")
    path = scratch(spark, "macro")
    create_index(docs, path, "doc_id", ["text", "source"], stemmer="none", stopwords="none", strip_accents=False)
    return match_bm25(docs.select("doc_id"), path, "doc_id", "Canary", fields="text").filter("score is not null").select("doc_id", F.round("score", 6).alias("score"))


def _bucket(ix: Index, query, kind: str, p: dict, subs: dict | None = None) -> DataFrame:
    return aggregations.bucket_frame(ix.matched_docs(query), kind, p, aggregations.parse(subs or {}))


def agg_terms_lang(spark, d):
    return _bucket(documents_index(spark, d), "*", "terms", {"field": "lang", "size": 5}).select(F.col("_key").alias("lang"), "doc_count")


def agg_terms_sub_stats(spark, d):
    b = _bucket(documents_index(spark, d), "the", "terms", {"field": "source", "size": 20}, {"n": {"stats": {"field": "n_chars"}}})
    return b.select(F.col("_key").alias("source"), "doc_count", F.col("`n.min`").alias("min_n"), F.col("`n.max`").alias("max_n"), F.round("`n.avg`", 6).alias("avg_n"), F.col("`n.sum`").alias("sum_n"))


def agg_histogram_nchars(spark, d):
    return _bucket(documents_index(spark, d), "*", "histogram", {"field": "n_chars", "interval": 1000}).select(F.col("_key").cast("double").alias("bucket"), "doc_count")


def agg_date_histogram_events(spark, d):
    b = _bucket(events_index(spark, d), "*", "date_histogram", {"field": "ts", "fixed_interval": "1d"}, {"v": {"sum": {"field": "value"}}})
    return b.select(F.col("_key").cast("long").alias("day_ms"), "doc_count", F.round("v", 4).alias("total"))


def agg_range_value(spark, d):
    return _bucket(events_index(spark, d), "*", "range", {"field": "value", "ranges": [{"to": 10}, {"from": 10, "to": 100}, {"from": 100}]}).select(F.col("_key").alias("bucket"), "doc_count")


def agg_stats(spark, d):
    df = events_index(spark, d).matched_docs("event_type:purchase")
    cols = aggregations.metric_columns(df, aggregations.parse({"v": {"stats": {"field": "value"}}}))
    return df.agg(*((F.round(c, 4) if n in ("v.avg", "v.sum") else c).alias(n.replace(".", "_")) for n, c in cols.items()))


def agg_cardinality(spark, d):
    """Approximate numbers of values, and whether they are within 5% of the exact ones."""
    df = documents_index(spark, d).matched_docs("*")
    cols = aggregations.metric_columns(df, aggregations.parse({f: {"cardinality": {"field": f}} for f in ("source", "doc_id")}))
    near = lambda n, c: F.abs(c - F.countDistinct(n)) <= 0.05 * F.countDistinct(n)
    return df.agg(*(near(n, c).alias(n) for n, c in cols.items()))


def json_terms_agg(spark, d):
    ix = events_index(spark, d)
    df = ix.matched_docs({"range": {"props.k": {"gte": 90}}}).select(F.get_json_object("props", "$.k").cast("long").alias("k"))
    return aggregations.bucket_frame(df, "terms", {"field": "k", "size": 10}).select(F.col("_key").alias("k"), "doc_count")


def _on_events(query, options=None):
    return lambda spark, d: hits(events_index(spark, d), query, options, id_col="event_id")


def fts_lateral_two_splits(spark, d):
    """A lateral call: each row of a table of splits is searched by the row's own query."""
    from lakeglean.plans.sql import sql

    splits = [(p.rsplit("/", 1)[1], p, q) for p in halves(spark, d).paths for q in ("canary", "footer")]
    spark.createDataFrame(splits, "split string, path string, query string").createOrReplaceTempView("lakeglean_splits")
    return sql(spark, "select s.split, s.query, count(*) as n from lakeglean_splits s cross join lateral fts_search(s.path, s.query, '{\"fast\": [\"doc_id\"]}') h group by s.split, s.query")


def fts_sql_match(spark, d):
    """Indexing a table's columns and scoring its rows by key, in SQL alone."""
    from lakeglean.plans.sql import sql

    table(spark, d, "documents").createOrReplaceTempView("lakeglean_documents")
    path = scratch(spark, "macro")
    made = sql(spark, f"select fts_create_index('lakeglean_documents', '{path}', 'doc_id', array('text'), 'none', 'none', false) as n").first()["n"]
    found = sql(spark, f"select doc_id, round(score, 6) as score from fts_match('lakeglean_documents', '{path}', 'doc_id', 'canary footer', 'text', true) where score is not null")
    return found.withColumn("indexed", F.lit(made).cast("long"))


QUERIES = {
    "fts_top10_bm25": _on_documents("canary footer", {"top_k": 10}),
    "fts_term": _on_documents({"term": {"text": "canary"}}),
    "fts_terms": _on_documents({"terms": {"text": ["canary", "gable", "footer"]}}),
    "fts_range_nchars": _on_documents({"range": {"n_chars": {"gte": 1000, "lt": 1200}}}),
    "fts_prefix": _on_documents({"prefix": {"text": "snap"}}),
    "fts_wildcard": _on_documents({"wildcard": {"text": "c?n*y"}}),
    "fts_regexp": _on_documents({"regexp": {"text": "gabl(e|es)"}}),
    "fts_fuzzy_d1": _on_documents({"fuzzy": {"text": {"value": "footre", "fuzziness": 1}}}),
    "fts_case_insensitive": _on_documents({"term": {"lang": {"value": "EN", "case_insensitive": True}}}),
    "fts_exists": _on_documents({"exists": {"field": "tag"}}),
    "fts_bool_filter": _on_documents({"bool": {"must": {"match": {"text": "canary"}}, "filter": {"term": {"lang": "en"}}, "must_not": {"term": {"text": "gable"}}}}),
    "fts_must_not_only": _on_documents({"bool": {"must_not": {"term": {"text": "the"}}}}),
    "fts_msm_75pct": _on_documents({"match": {"text": {"query": "canary footer gable ledger", "minimum_should_match": "75%"}}}),
    "fts_dis_max": _on_documents({"dis_max": {"queries": [{"term": {"text": "canary"}}, {"term": {"text": "footer"}}], "tie_breaker": 0.3}}),
    "fts_constant_score": _on_documents({"constant_score": {"filter": {"match": {"text": "canary"}}, "boost": 2.5}}),
    "fts_multi_match_best": _on_documents({"multi_match": {"query": "canary", "fields": ["text^2", "source"]}}),
    "fts_multi_match_most": _on_documents({"multi_match": {"query": "en", "fields": ["text", "lang"], "type": "most_fields"}}),
    "fts_querystring_and": _on_documents('canary AND footer lang:en', {"conjunctive": True, "fields": ["text"]}),
    "fts_querystring_signs": _on_documents("+canary -footer n_chars:[500 TO 3000]", {"fields": ["text"]}),
    "fts_phrase": _on_documents({"match_phrase": {"text": "of the"}}),
    "fts_phrase_slop": _on_documents({"constant_score": {"filter": {"match_phrase": {"text": {"query": "the canary", "slop": 1}}}}}),
    "fts_phrase_prefix": _on_documents({"constant_score": {"filter": {"match_phrase_prefix": {"text": "the cana"}}}}),
    "fts_page_offset": _on_documents("canary", {"offset": 10, "top_k": 10}),
    "json_term": _on_events({"term": {"props.k": 42}}),
    "json_range": _on_events({"range": {"props.k": {"gte": 95}}}),
    "json_exists": _on_events({"bool": {"filter": [{"exists": {"field": "props.k"}}, {"range": {"value": {"gt": 400}}}]}}),
} | {f.__name__: f for f in (
    fts_token_stats, fts_doc_freq, fts_doc_lengths, fts_build_counts_by_group, fts_count, fts_count_limit, fts_count_distinct, fts_exclude_topk, fts_global_stats, fts_local_stats,
    fts_merge_counts, fts_merged_top10, fts_highlight, fts_more_like_this, fts_collapse_source, fts_sort_field_desc, fts_stored_doc, fts_macro_create_and_match, fts_lateral_two_splits, fts_sql_match,
    agg_terms_lang, agg_terms_sub_stats, agg_histogram_nchars, agg_date_histogram_events, agg_range_value, agg_stats, agg_cardinality, json_terms_agg)}

# -- the same in SQL ----------------------------------------------------------
_T = r"""
with d as (select *, list_transform(list_filter(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: strlen(x) < 40), lambda x: lower(x)) ws from documents%s),
p as (select doc_id, term, count(*) tf, any_value(n) len from (select doc_id, unnest(ws) term, len(ws) n from d) group by 1, 2),
st as (select (select count(*) from d) n, (select sum(len(ws)) from d) tokens),
f as (select term, count(*) df from p group by 1),
s as (select doc_id, p.term, ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / (tokens::double / n))) s from p join f on f.term = p.term cross join st)
"""
_S = _T % ""
_any = lambda *terms: ", ".join(f"'{t}'" for t in terms)


def _sum(*terms, base=_S, where="") -> str:
    return base + f"select doc_id, round(sum(s), 6) score from s where term in ({_any(*terms)}) {where} group by 1"


def _const(where: str, score: float = 1.0) -> str:
    return _S + f"select doc_id, cast({score} as double) score from d where {where}"


_has = lambda t: f"list_contains(ws, '{t}')"
_RANK = " order by sum(s) desc, doc_id limit %d"
_LANG = ", lang_score as (select ln(1 + (n - c + 0.5::double) / (c + 0.5::double)) * 2.2::double / (1 + 1.2::double * (0.25::double + 0.75::double / (k::double / n))) l from (select count(*) filter (lang = 'en') c, count(lang) k from d) cross join st) "
SQL = {
    "fts_top10_bm25": _sum("canary", "footer") + _RANK % 10,
    "fts_term": _sum("canary"),
    "fts_terms": _const(f"list_has_any(ws, [{_any('canary', 'gable', 'footer')}])"),
    "fts_range_nchars": _const("n_chars >= 1000 and n_chars < 1200"),
    "fts_prefix": _const("len(list_filter(ws, lambda x: starts_with(x, 'snap'))) > 0"),
    "fts_wildcard": _const("len(list_filter(ws, lambda x: regexp_full_match(x, 'c.n.*y'))) > 0"),
    "fts_regexp": _const("len(list_filter(ws, lambda x: regexp_full_match(x, 'gabl(e|es)'))) > 0"),
    "fts_fuzzy_d1": _const("len(list_filter(ws, lambda x: damerau_levenshtein(x, 'footre') <= 1)) > 0"),
    "fts_case_insensitive": _const("lower(lang) = 'en'"),
    "fts_exists": _const("tag is not null"),
    "fts_bool_filter": _sum("canary", where=f"and doc_id in (select doc_id from d where lang = 'en' and not {_has('gable')})"),
    "fts_must_not_only": _const(f"ws is null or not {_has('the')}", 0.0),
    "fts_msm_75pct": _sum("canary", "footer", "gable", "ledger") + " having count(*) >= 3",
    "fts_dis_max": _S + "select doc_id, round(max(s) + 0.3::double * (sum(s) - max(s)), 6) score from s where term in ('canary', 'footer') group by 1",
    "fts_constant_score": _const(_has("canary"), 2.5),
    "fts_multi_match_best": _S + "select doc_id, round(2 * s, 6) score from s where term = 'canary'",
    "fts_multi_match_most": _S + _LANG + "select d.doc_id, round(coalesce(s.s, 0) + case when lang = 'en' then l else 0 end, 6) score from d cross join lang_score left join s on s.doc_id = d.doc_id and s.term = 'en' where s.s is not null or lang = 'en'",
    "fts_querystring_and": _S + _LANG + "select doc_id, round(sum(s) + any_value(l), 6) score from s cross join lang_score where term in ('canary', 'footer') and doc_id in (select doc_id from d where lang = 'en') group by 1 having count(*) = 2",
    "fts_querystring_signs": _S + "select d.doc_id, round(s + case when n_chars between 500 and 3000 then 1 else 0 end, 6) score from s join d on d.doc_id = s.doc_id where s.term = 'canary' and not " + _has("footer"),
    "fts_phrase": _S + ", o as (select doc_id, len(list_filter(range(1, len(ws)), lambda i: ws[i] = 'of' and ws[i + 1] = 'the')) tf, len(ws) len from d), idf as (select sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double))) x from f cross join st where term in ('of', 'the')) select doc_id, round(x * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / (tokens::double / n))), 6) score from o cross join idf cross join st where tf > 0",
    "fts_phrase_slop": _const("len(list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'the' and (ws[i + 1] = 'canary' or ws[i + 2] = 'canary'))) > 0"),
    "fts_phrase_prefix": _const("len(list_filter(range(1, len(ws)), lambda i: ws[i] = 'the' and starts_with(ws[i + 1], 'cana'))) > 0"),
    "fts_page_offset": _sum("canary") + _RANK % 10 + " offset 10",
    "json_term": "select event_id, cast(1.0 as double) score from events where cast(props->>'$.k' as int) = 42",
    "json_range": "select event_id, cast(1.0 as double) score from events where cast(props->>'$.k' as int) >= 95",
    "json_exists": "select event_id, cast(0.0 as double) score from events where props->>'$.k' is not null and value > 400",
    "fts_token_stats": _S + "select cast(sum(tf) as bigint) n_tokens, count(distinct term) n_terms, count(distinct doc_id) n_docs from p",
    "fts_doc_freq": _S + "select term, count(*) df, cast(sum(tf) as bigint) cf from p group by 1",
    "fts_doc_lengths": _S + "select doc_id, len(ws) n_tokens from d where len(ws) > 0",
    "fts_build_counts_by_group": "select coalesce(lang, 'none') lang, count(*) docs from documents group by 1",
    "fts_count": _S + f"select count(*) n from d where {_has('canary')} or {_has('footer')}",
    "fts_count_limit": _S + f"select least(count(*), 100) n from d where {_has('the')}",
    "fts_count_distinct": _S + f"select count(distinct source) n from d where {_has('the')}",
    "fts_exclude_topk": _S + "select doc_id, round(sum(s), 6) score from s where term in ('canary', 'footer') and doc_id not in (select doc_id from documents where n_chars % 2 = 1) group by 1" + _RANK % 20,
    "fts_global_stats": _sum("canary", "gable"),
    "fts_local_stats": "select * from (" + _sum("canary", "gable", base=_T % " where doc_id % 2 = 0") + ") union all select * from (" + _sum("canary", "gable", base=_T % " where doc_id % 2 <> 0") + ")",
    "fts_merge_counts": _T % " where coalesce(n_chars % 2 <> 1, true)" + f"select (select count(*) from d where {_has('canary')} or {_has('footer')}) n, (select count(*) from d) docs",
    "fts_merged_top10": _sum("canary", "footer", base=_T % " where coalesce(n_chars % 2 <> 1, true)") + _RANK % 10,
    "fts_collapse_source": _S + ", h as (select s.doc_id, source, sum(s) x from s join d on d.doc_id = s.doc_id where term in ('canary', 'footer') group by 1, 2) select source, doc_id, round(x, 6) score from h qualify row_number() over (partition by source order by x desc, doc_id) = 1",
    "fts_sort_field_desc": _S + f"select doc_id, n_chars, cast(null as double) score from d where {_has('canary')} order by n_chars desc nulls last, doc_id limit 25",
    "fts_stored_doc": _S + "select d.doc_id, text from s join d on d.doc_id = s.doc_id where s.term = 'canary' order by s.s desc, d.doc_id limit 10",
    "fts_lateral_two_splits": _S + "select cast(doc_id % 2 as varchar) split, term as query, count(*) n from p where term in ('canary', 'footer') group by 1, 2",
    "fts_sql_match": _S + "select doc_id, round(sum(s), 6) score, (select count(*) from documents) indexed from s where term in ('canary', 'footer') group by 1 having count(*) = 2",
    "fts_macro_create_and_match": _sum("canary"),
    "fts_highlight": _S + "select doc_id, true as marked from s where term = 'canary' order by s desc, doc_id limit 50",
    "fts_more_like_this": _S + ", w as (select unnest(string_split('the canary checked every footer of the ledger before the budget was sealed', ' ')) term), best as (select w.term, count(*) * (ln(any_value(n) / (any_value(df) + 1.0::double)) + 1) x from w join f on f.term = w.term cross join st where df >= 2 group by 1 order by 2 desc, 1 limit 5) select doc_id, round(sum(s), 6) score from s where term in (select term from best) group by 1" + _RANK % 20,
    "agg_cardinality": "select true as source, true as doc_id",
    "agg_terms_lang": "select lang, count(*) doc_count from documents where lang is not null group by 1 order by 2 desc, 1 limit 5",
    "agg_terms_sub_stats": _S + f"select source, count(*) doc_count, min(n_chars) min_n, max(n_chars) max_n, round(avg(n_chars), 6) avg_n, cast(sum(n_chars) as bigint) sum_n from d where {_has('the')} and source is not null group by 1 order by 2 desc, 1 limit 20",
    "agg_histogram_nchars": "select floor(n_chars / 1000.0::double) * 1000.0::double bucket, count(*) doc_count from documents where n_chars is not null group by 1",
    "agg_date_histogram_events": "select cast(epoch_ms(date_trunc('day', ts)) as bigint) day_ms, count(*) doc_count, round(sum(value), 4) total from events group by 1",
    "agg_range_value": "select case when value < 10 then '*-10' when value < 100 then '10-100' else '100-*' end bucket, count(*) doc_count from events where value is not null group by 1",
    "agg_stats": "select count(value) v_count, min(value) v_min, max(value) v_max, round(avg(value), 4) v_avg, round(sum(value), 4) v_sum from events where event_type = 'purchase'",
    "json_terms_agg": "select cast(props->>'$.k' as bigint) k, count(*) doc_count from events where cast(props->>'$.k' as bigint) >= 90 group by 1 order by 2 desc, 1 limit 10",
}
