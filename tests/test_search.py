"""Golden cases of the search engine, its errors, and properties against a naive scorer."""

import json
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lakeglean.functions.analyzers import Analyzer, AnalyzerError
from lakeglean.functions.stemmer import english
from lakeglean.operators import index
from lakeglean.operators.search import PAGE_RANGES, Index, _ordinals, osa_distance, roaring_ids
from lakeglean.plans.dsl import compile_query, fuzzy_distance, minimum_should_match, wildcard_regex
from lakeglean.plans.errors import QueryError
from lakeglean.plans.schema import Schema
from lakeglean.session import scratch

FTS = {"fts": {"tokenizer": "simple", "filters": ["lowercase", "ascii_folding", {"type": "stop_words", "language": "english"}, {"type": "stemmer", "language": "porter"}]}}
SCHEMA = [
    {"name": "no", "type": "i64", "options": {"stored": True, "fast": True}},
    {"name": "log", "type": "text", "options": {"stored": True, "indexing": {"tokenizer": "fts"}}},
    {"name": "berth", "type": "text", "options": {"stored": True, "fast": True, "indexing": {"tokenizer": "raw"}}},
    {"name": "tide", "type": "f64", "options": {"fast": True}},
    {"name": "arrived", "type": "date", "options": {"fast": True, "stored": True}},
    {"name": "cargo", "type": "json_object", "options": {"stored": True, "fast": True}},
]
HARBOUR = [
    (11, "Two ferries moored beside the naïve pilot's skiff", ["north"], 4.5, "2023-06-05T06:00:00Z", '{"kind": "dry salt", "tons": 12, "bonded": false}'),
    (12, "A ferry ran aground; pilots waited", ["south", "east"], 0.5, "2023-07-09T00:00:00Z", '{"kind": "salt", "tons": 7.25}'),
    (13, "fog <delayed> the pilot & ferry & ferry", ["north"], None, None, '{"hold": {"deck": 2}, "kind": "timber"}'),
    (14, "storm", ["west"], 4.5, "2023-06-20T18:30:00Z", None),
    (15, None, None, None, None, None),
]
EVERY = {11, 12, 13, 14, 15}


@pytest.fixture(scope="module")
def ix(spark):
    df = spark.createDataFrame(HARBOUR, "no int, log string, berth array<string>, tide double, arrived string, cargo string")
    path = scratch(spark, "t")
    assert [tuple(r) for r in index.build(df, path, SCHEMA, FTS, order="no").collect()] == [(path, 5)]
    return Index(spark, path)


def ids(ix, q, **o):
    return [json.loads(r.doc)["no"] for r in ix.search(q, {"fast": ["no"]} | o).collect()]


STRINGS = {
    "ferry": {11, 12, 13}, "ferry AND fog": {13}, "skiff OR storm": {11, 14}, "+pilot -fog": {11, 12}, '"ran aground"': {12}, '"ferry aground"': set(), '"ferry aground"~1': {12}, "NAIVE": {11}, "*": EVERY,
    "berth:east": {12}, "no:[12 TO 13]": {12, 13}, "no:{12 TO 14}": {13}, "no:>=14": {14, 15}, "cargo.kind:salt": {11, 12}, "moor*": {11}, "gale": set(), "the": set(), "(ferry storm) AND NOT aground": {11, 13, 14},
}
TREES = [
    ({"term": {"berth": "north"}}, {11, 13}), ({"terms": {"berth": ["east", "west"]}}, {12, 14}), ({"match": {"log": {"query": "skiff fog", "operator": "and"}}}, set()), ({"match": {"log": "the"}}, set()),
    ({"prefix": {"berth": {"value": "NO", "case_insensitive": True}}}, {11, 13}), ({"wildcard": {"berth": "?e*t"}}, {14}), ({"regexp": {"berth": "(ea|we)st"}}, {12, 14}),
    ({"fuzzy": {"berth": "nroth"}}, {11, 13}), ({"fuzzy": {"berth": {"value": "nroth", "transpositions": False, "fuzziness": 1}}}, set()), ({"range": {"tide": {"gt": 1}}}, {11, 14}),
    ({"range": {"arrived": {"gte": "2023-06-20"}}}, {12, 14}), ({"range": {"arrived": {"lte": 1685944800000}}}, {11}), ({"range": {"cargo.tons": {"gte": 8}}}, {11}), ({"term": {"cargo.bonded": False}}, {11}),
    ({"term": {"cargo.hold.deck": 2}}, {13}), ({"exists": {"field": "cargo.hold"}}, {13}), ({"exists": {"field": "tide"}}, {11, 12, 14}), ({"exists": {"field": "log"}}, EVERY - {15}), ({"exists": {"field": "berth"}}, EVERY - {15}),
    ({"match_phrase": {"cargo.kind": "dry salt"}}, {11}), ({"match_phrase_prefix": {"log": "ferries moo"}}, {11}), ({"bool": {"must_not": [{"term": {"berth": "north"}}]}}, {12, 14, 15}), ({"bool": {}}, EVERY), ({"match_none": {}}, set()),
    ({"bool": {"should": [{"term": {"berth": "north"}}, {"match": {"log": "fog"}}, {"match_all": {}}], "minimum_should_match": 2}}, {11, 13}), ({"query": {"dis_max": {"queries": [{"term": {"berth": "west"}}, {"match": {"log": "pilot"}}]}}}, EVERY - {15}),
    ({"multi_match": {"query": "north", "fields": ["log", "berth^3"]}}, {11, 13}), ({"query_string": {"query": "fog storm", "default_operator": "AND"}}, set()),
]


@pytest.mark.parametrize("query, want", [*STRINGS.items(), *TREES])
def test_matches(ix, query, want):
    assert set(ids(ix, query)) == want


def test_scores_and_order(ix):
    assert [r.score for r in ix.search({"constant_score": {"filter": {"term": {"berth": "north"}}, "boost": 1.5}}).collect()] == [1.5, 1.5]
    assert ids(ix, {"constant_score": {"filter": {"match_all": {}}}}) == sorted(EVERY)
    assert ids(ix, "*", top_k=2, offset=1) == [12, 13] and ids(ix, "*", top_k=0) == [] and ids(ix, "*", offset=99) == []
    assert ids(ix, "*", sort="tide") == [12, 11, 14, 13, 15] and ids(ix, "*", sort={"field": "tide", "order": "desc"}) == [11, 14, 12, 13, 15]
    assert ids(ix, "*", sort={"field": "tide", "order": "desc"}, top_k=3) == [11, 14, 12] and all(r.score is None for r in ix.search("*", {"sort": "tide"}).collect())
    assert ids(ix, "*", collapse="tide") == [11, 12, 13]
    assert ids(ix, "fog pilot", top_k=1) == [13]


def test_pages_are_fetched_by_ordinal(ix):
    far = list(range(0, 9000, 3)) + [10**9, 10**12]
    test = _ordinals(far)
    plan = str(test)
    assert plan.count(" OR ") < PAGE_RANGES or plan.count("or") < 3 * PAGE_RANGES
    got = ix.spark.range(0, 10**4).unionAll(ix.spark.createDataFrame([(10**9,), (10**12,), (10**13,)], "id long")).withColumnRenamed("id", "_doc").filter(test)
    assert {r[0] for r in got.collect()} >= set(far) and got.filter(f"_doc = {10**13}").count() == 0
    assert "PushedFilters: [Or" in ix.search("ferry", {"top_k": 3})._jdf.queryExecution().explainString(ix.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_exclusion_counts_and_json(ix, spark):
    assert ids(ix, "*", exclude_field="no") == sorted(EVERY)
    got = [json.loads(r.doc) for r in ix.search("*", {"exclude_field": "no", "top_k": 2}, [11, 12]).collect()]
    assert [d["no"] for d in got] == [13, 14]
    left = {r.score for r in ix.search("ferry", {"exclude_field": "no"}, [11]).collect()}
    assert left <= {r.score for r in ix.search("ferry").collect()}  # statistics don't see the exclusion
    assert ix.count("ferry") == 3 and ix.count("*", {"limit": 3}) == 3 and ix.count("*", {"distinct": "tide"}) == 2 and ix.count(None) is None and Index(spark, []).count("x") == 0
    one = {"term": {"berth": "north"}}
    assert ix.count(one) == 2 and ix.count(one, {"limit": 1}) == 1 and ix.count(one, {"exclude_field": "no"}, [13]) == 1
    assert json.loads(ix.search("skiff").first().doc) == {"no": 11, "log": HARBOUR[0][1], "berth": "north", "arrived": "2023-06-05T06:00:00Z", "cargo": {"kind": "dry salt", "tons": 12, "bonded": False}}
    assert json.loads(ix.search("aground").first().doc)["berth"] == ["south", "east"]
    assert ix.search("skiff", {"fast": []}).first().doc == "{}" and ix.search(None).count() == 0
    assert json.loads(ix.search("pilot AND fog", {"highlight": {"fields": ["log"]}}).first().highlight) == {"log": "<b>fog</b> &lt;delayed&gt; the <b>pilot</b> &amp; ferry &amp; ferry"}


def test_aggregations(ix):
    r = json.loads(ix.aggregate("*", {"t": {"terms": {"field": "berth", "size": 2}, "aggs": {"m": {"max": {"field": "tide"}}}}, "s": {"stats": {"field": "tide"}}, "r": {"range": {"field": "tide", "ranges": [{"to": 2}, {"from": 2}]}},
                                      "d": {"date_histogram": {"field": "arrived", "fixed_interval": "1d"}}}))
    assert r["t"] == {"buckets": [{"key": "north", "doc_count": 2, "m": {"value": 4.5}}, {"key": "east", "doc_count": 1, "m": {"value": 0.5}}], "sum_other_doc_count": 2, "doc_count_error_upper_bound": 0}
    assert r["s"] == {"count": 3, "min": 0.5, "max": 4.5, "avg": 9.5 / 3, "sum": 9.5}
    assert [(b["key"], b["doc_count"]) for b in r["r"]["buckets"]] == [("*-2", 1), ("2-*", 2)] and len(r["d"]["buckets"]) == 3
    for bad in ({"x": {"sorts": {}}}, {"x": {"terms": {"field": "quay"}}}, "[", {"x": {"max": {"field": "no"}, "aggs": {"y": {"max": {"field": "no"}}}}}):
        with pytest.raises(QueryError, match="aggregations"):
            ix.aggregate("*", bad)


SHAPES = {"term": ("berth", {"value": "x"}), "match": ("log", {"query": "x"}), "match_phrase": ("log", {"query": "x y"}), "match_phrase_prefix": ("log", {"query": "x y"}), "prefix": ("berth", {"value": "x"}),
          "wildcard": ("berth", {"value": "x*"}), "regexp": ("berth", {"value": "x+"}), "fuzzy": ("berth", {"value": "x"}), "range": ("no", {"gt": 1})}


@pytest.mark.parametrize("kind", SHAPES)
def test_each_query_refuses_what_it_does_not_know(kind):
    field, body = SHAPES[kind]
    schema = Schema(SCHEMA, FTS)
    compile_query({kind: {field: body}}, schema)
    for bad in ({kind: {field: body | {"surplus": 1}}}, {kind: {"quay": body}}, {kind: {field: body | {"boost": -0.5}}}, {kind: {}}, {kind: {field: {}}}, {f"{kind}_x": {field: body}}):
        with pytest.raises(QueryError):
            compile_query(bad, schema)


@pytest.mark.parametrize("query", [
    {"term": {"no": "twelve"}}, {"term": {"cargo": 1}}, {"bool": {"filter": {"term": {"no": 0.25}}}}, {"range": {"tide": {"lt": 3, "lte": 2}}}, {"wildcard": {"berth": "tail\\"}}, {"regexp": {"berth": "[open"}}, {"dis_max": {"queries": []}},
    {"dis_max": {"queries": [{"match_all": {}}], "tie_breaker": 1.5}}, {"match": {"log": {"query": "x", "operator": "maybe"}}}, {"fuzzy": {"berth": {"value": "x", "fuzziness": 9}}}, {"match_phrase": {"log": {"query": "x y", "slop": -3}}}, '{"term"', 7.5,
])
def test_values_out_of_range(query):
    with pytest.raises(QueryError):
        compile_query(query, Schema(SCHEMA, FTS))


def test_option_errors(ix):
    searches = [("x", {"bad": 1}), ("x", {"limit": 1}), ("x", {}, [11]), ("x", {"fast": ["log"]}), ("x", {"fast": ["quay"]}), ("x", {"collapse": "berth"}), ("x", {"sort": "no", "collapse": "no"}), ("x", {"top_k": -1}),
                ("x", {"highlight": {"fields": ["quay"]}}), ("quay:x", {"strict": True}), ("a AND", {"strict": True}), ("x", {"exclude_field": "berth"}, [11])]
    counts = [("x", {"sort": "no"}), ("x", {"limit": 1, "distinct": "no"})]
    for call, args in [*((ix.search, a) for a in searches), *((ix.count, a) for a in counts)]:
        with pytest.raises(QueryError):
            call(*args)
    assert set(ids(ix, "ferry AND")) == {11, 12, 13} and ids(ix, "quay:ferry") == []
    assert ids(ix, {"term": {"quay": 1}}, ignore_unmapped=True) == []


def test_build_merge_drop(spark, rows):
    root = scratch(spark, "t")
    df = rows("at string, no int, log string, berth string, extra int", [(f"{root}/a", 1, "red crab", "x", 0), (f"{root}/b", 2, "a gull", None, 0), (f"{root}/a", 3, None, None, 0)])
    made = index.build(df, None, SCHEMA[:3], FTS, path_col="at", order="no")
    assert sorted((r.path[-1], r.docs) for r in made.collect()) == [("a", 2), ("b", 1)]
    both = Index(spark, [f"{root}/a", f"{root}/b"])
    assert ids(both, "crab OR gull") and [r.path[-1] for r in both.search("*", {"fast": ["no"]}).collect()] == ["a", "a", "b"]
    with pytest.raises(FileExistsError):
        index.build(df.limit(1), f"{root}/a", SCHEMA[:3], FTS)
    for bad in (lambda: index.build(df, f"{root}/x", "["), lambda: index.build(df, f"{root}/x", [{"name": "no", "type": "zip"}]), lambda: index.build(df, f"{root}/x", [{"name": "no", "type": "text"}]),
                lambda: index.build(df.withColumn("at", df["berth"]), None, SCHEMA[:3], FTS, path_col="at"), lambda: index.merge(spark, [], f"{root}/m"), lambda: index.merge(spark, [f"{root}/a"] * 2, f"{root}/m"), lambda: index.merge(spark, [f"{root}/a"], f"{root}/m", None, [1])):
        with pytest.raises(QueryError):
            bad()
    assert index.merge(spark, both.paths, f"{root}/m", "no", [3]) == 2
    assert sorted(ids(Index(spark, f"{root}/m"), "*")) == [1, 2]
    assert index.drop(spark, f"{root}/m") is True and index.drop(spark, f"{root}/m") is False and index.drop(spark, None) is None
    assert index.build(df.limit(0), f"{root}/none", SCHEMA[:3], FTS).count() == 0
    with pytest.raises(FileNotFoundError):
        Index(spark, f"{root}/none")


WORDS = "red crab gull cat sun".split()


def naive(docs, terms, k1=1.2, b=0.75):
    n, avg = len(docs), sum(len(d) for d in docs) / len(docs)
    out = {}
    for i, d in enumerate(docs):
        s = 0.0
        for t in terms:
            df = sum(t in x for x in docs)
            tf = d.count(t)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / avg))
        if s:
            out[i] = s
    return out


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(WORDS), min_size=1, max_size=6), min_size=2, max_size=12), st.lists(st.sampled_from(WORDS), min_size=1, max_size=3, unique=True), st.integers(0, 5))
def test_ranking_is_that_of_a_naive_scorer(spark, docs, terms, k):
    path = scratch(spark, "t")
    index.build(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "no int, log string"), path, [SCHEMA[0], {"name": "log", "type": "text"}], order="no")
    ix = Index(spark, path)
    q, want = " ".join(terms), naive(docs, terms)
    ranked = sorted(want, key=lambda i: (-round(want[i], 9), i))
    got = ix.search(q, {"fast": ["no"]}).collect()
    assert [json.loads(r.doc)["no"] for r in got] == ranked and all(abs(r.score - want[json.loads(r.doc)["no"]]) < 1e-9 for r in got)
    assert ids(ix, q, offset=k, top_k=3) == ranked[k:k + 3]
    assert [json.loads(r.doc)["no"] for r in ix.search(q, {"fast": ["no"], "exclude_field": "no"}, [0, 1]).collect()] == [i for i in ranked if i > 1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab"()[]{}+-~^:*\\ ANDORTO.0123<>=', max_size=30))
def test_query_text_never_breaks(text):
    s = Schema(SCHEMA, FTS)
    compile_query(text if not text.lstrip().startswith("{") else "x" + text, s)
    try:
        compile_query(text, s, strict=True)
    except QueryError:
        pass


def test_helpers():
    assert [minimum_should_match(v, 4) for v in (2, -1, "75%", "-25%", "9", 9, -9, "-100%")] == [2, 3, 3, 3, 4, 4, 0, 0]
    assert [fuzzy_distance("AUTO", w) for w in ("ab", "abc", "abcdef", "éé")] == [0, 1, 2, 0] and fuzzy_distance("AUTO:4,9", "abcd") == 1
    assert wildcard_regex("a*b?\\*") == "a.*b.\\*"
    assert [osa_distance(a, b, 2) for a, b in (("rde", "red"), ("abc", "abc"), ("kitten", "sitting"), ("ca", "abc"))] == [1, 0, 3, 3]
    assert [english(w) for w in "caresses ponies ties cats feed agreed plastered motoring conflated hopping falling hoping happy relational conditional rationalization hopefulness generically skies dying news".split()] == \
        "caress poni tie cat feed agre plaster motor conflat hop fall hope happi relat condit ration hope generic sky die news".split()
    with pytest.raises(AnalyzerError):
        Analyzer({"tokenizer": "simple", "filters": [{"type": "stemmer", "language": "klingon"}]})
    with pytest.raises(AnalyzerError):
        Analyzer({"tokenizer": "simple", "oops": 1})


@pytest.mark.parametrize("spec", [
    "default", "raw", "whitespace", "en_stem", FTS["fts"], {"tokenizer": {"type": "ngram", "min": 2, "max": 3}, "filters": ["lowercase"]}, {"tokenizer": {"type": "ngram", "min": 1, "max": 2, "prefix_only": True}},
    {"tokenizer": {"type": "regex", "pattern": "[a-z]+"}}, {"tokenizer": "whitespace", "filters": ["alpha_num_only", {"type": "remove_long", "max": 5}, {"type": "stop_words", "words": ["Crab"]}]}])
def test_columns_analyse_as_python_does(spark, spec):
    from pyspark.sql import functions as F

    a = Analyzer(spec)
    texts = ["A pale, small Crabs_scuttled!", "", "Éclair straße œuvre ÅÆ", "a  b\tc\n" + "x" * 50, "Crab crab 12 3.5", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", a.column(F.col("t")).alias("x")).orderBy("i").collect()
    assert [[(y.pos, y.term) for y in r.x] if r.x is not None else None for r in got] == [a.tokens(t) if t is not None else None for t in texts]


def test_roaring_round_trip(spark):
    """Against the implementation that ships with Spark."""
    jvm = spark._jvm
    want = [1, 5, 70000, *range(100000, 100300, 3), *range(200000, 206000)]
    b = jvm.org.roaringbitmap.RoaringBitmap()
    for i in want:
        b.add(i)
    for optimised in (False, True):
        if optimised:
            b.runOptimize()
        out = jvm.java.io.ByteArrayOutputStream()
        b.serialize(jvm.java.io.DataOutputStream(out))
        assert roaring_ids(bytes(out.toByteArray())) == want
    wide = (1).to_bytes(8, "little") + (3).to_bytes(4, "little") + bytes(out.toByteArray())
    assert roaring_ids(wide) == [3 << 32 | i for i in want]
    with pytest.raises(QueryError):
        roaring_ids(b"nonsense")


def test_json_documents(spark):
    schema = [*SCHEMA, {"name": "flag", "type": "bool", "options": {"fast": True}}]
    docs = ['{"no": 1, "log": "red crab", "berth": ["a", "b"], "tide": 1.5, "arrived": "2024-01-01T00:00:00Z", "flag": true, "cargo": {"x": {"y": 1}}, "junk": 1}', '{"no": "2", "log": null, "berth": "c", "arrived": 1704067200000}', None]
    df = index.from_json(spark.createDataFrame([(d,) for d in docs], "doc string"), "doc", schema, FTS)
    path = scratch(spark, "t")
    index.build(df, path, schema, FTS, order="no")
    ix = Index(spark, path)
    assert ids(ix, "*") == [1, 2] and ids(ix, {"term": {"cargo.x.y": 1}}) == [1] and ids(ix, {"terms": {"berth": ["b", "c"]}}) == [1, 2] and ids(ix, {"term": {"flag": True}}) == [1]
    assert ids(ix, {"range": {"arrived": {"lte": 1704067200000}}}) == [1, 2]
    with pytest.raises(Exception, match="is not"):
        index.from_json(spark.createDataFrame([('{"no": "x"}',)], "doc string"), "doc", schema, FTS).collect()


def test_sql_surface(spark, ix):
    from lakeglean.plans.sql import sql

    p = ix.paths[0]
    got = sql(spark, f"select h.doc from fts_search('{p}', :q, '{{\"fast\": [\"no\"], \"exclude_field\": \"no\"}}', array(11, 12)) h -- fts_drop('x')\n order by 1", {"q": "ferry (skiff)"}).collect()
    assert [r.doc for r in got] == ['{"no":13}']
    r = sql(spark, f"select fts_count(array('{p}'), 'pilot fog') n, fts_count('{p}', null) z, 'fts_count(1)' s, fts_aggregate('{p}', '*', '{{\"m\": {{\"max\": {{\"field\": \"no\"}}}}}}') a").first()
    assert (r.n, r.z, r.s, json.loads(r.a)) == (3, None, "fts_count(1)", {"m": {"value": 15}})
    assert sql(spark, f"select count(*) n from fts_search('{p}', null)").first().n == 0
    target = scratch(spark, "t")
    assert sql(spark, f"select fts_merge(array('{p}'), '{target}') n").first().n == 5 and sql(spark, f"select fts_drop('{target}') a, fts_drop(null) b").first() == (True, None)
    with pytest.raises(QueryError):
        sql(spark, "select fts_count('x'")
    spark.createDataFrame([("ferry",), ("storm",), ("gale",), (None,), ("storm",)], "q string").createOrReplaceTempView("asked")
    lateral = f"select a.q, h.doc from asked a cross join lateral fts_search('{p}', a.q, '{{\"fast\": [\"no\"]}}') h where h.score > :least order by 2"
    assert sorted((r.q, json.loads(r.doc)["no"]) for r in sql(spark, lateral, {"least": 0.0}).collect()) == [("ferry", 11), ("ferry", 12), ("ferry", 13), ("storm", 14), ("storm", 14)]
    with pytest.raises(QueryError, match="alias"):
        sql(spark, f"select * from asked a, lateral fts_search('{p}', a.q)")
    spark.createDataFrame([(1, "salt, and rope", "x"), (2, None, None), (3, "ropes", "salt")], "k int, a string, b string").createOrReplaceTempView("stock")
    assert sql(spark, f"select fts_create_index('stock', '{target}-m', 'k', array('a', 'b')) n").first().n == 3
    both = lambda q, rest="": {r.k: r.score is not None for r in sql(spark, f"select k, score from fts_match('stock', '{target}-m', 'k', '{q}'{rest})").collect()}
    assert both("rope") == {1: True, 2: False, 3: True} and both("salt", ", 'b'") == {1: False, 2: False, 3: True} and both("salt rope", ", 'a', true") == {1: True, 2: False, 3: False}


def test_nested_aggregations(ix):
    r = json.loads(ix.aggregate("*", {"t": {"terms": {"field": "berth", "size": 2}, "aggs": {"h": {"histogram": {"field": "tide", "interval": 1}, "aggs": {"n": {"value_count": {"field": "no"}}}}, "k": {"terms": {"field": "no", "size": 1}}}}}))
    assert r["t"]["sum_other_doc_count"] == 2
    first, second = r["t"]["buckets"]
    assert first["h"]["buckets"] == [{"key": 4.0, "doc_count": 1, "n": {"value": 1}}] and second["h"]["buckets"] == [{"key": 0.0, "doc_count": 1, "n": {"value": 1}}]
    assert first["k"] == {"buckets": [{"key": 11, "doc_count": 1}], "sum_other_doc_count": 1, "doc_count_error_upper_bound": 0}
    assert json.loads(ix.aggregate("nothing", {"t": {"terms": {"field": "berth"}}})) == {"t": {"buckets": [], "sum_other_doc_count": 0, "doc_count_error_upper_bound": 0}}


def test_many_splits_rank_as_one_scan(spark):
    root = scratch(spark, "t")
    df = spark.createDataFrame([(f"{root}/{i % 12:02d}", i, f"crab {'gull ' * (i % 5)}") for i in range(48)], "at string, no int, log string")
    index.build(df, None, SCHEMA[:2], FTS, path_col="at", order="no")
    many = Index(spark, [f"{root}/{i:02d}" for i in range(12)])
    parts = [(round(r.score, 9), i, json.loads(r.doc)["no"]) for i in range(12) for r in Index(spark, f"{root}/{i:02d}").search("gull", {"fast": ["no"]}).collect()]
    assert [json.loads(r.doc)["no"] for r in many.search("gull", {"fast": ["no"]}).collect()] == [d for _, _, d in sorted(parts, key=lambda x: (-x[0], x[1], x[2]))]
    assert many.count("crab") == 48 and len(ids(many, "crab", global_stats=True, top_k=7)) == 7


def test_bucket_frames_are_whole(spark):
    from lakeglean.operators import aggregations

    df = spark.range(70_000).withColumnRenamed("id", "n")
    assert aggregations.bucket_frame(df, "histogram", {"field": "n", "interval": 1}).count() == 70_000
