"""Queries knn_*, ivf_* and the dashboards, lookups and loading recipes on the fixture tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeglean.operators import ivf
from lakeglean.session import scratch, table

#: The fixture's vectors barely cluster, so recall of 0.9 and more takes three quarters of the lists.
CLUSTERS, PROBES, K = 32, 24, 10
#: Of the ten label-mean lists; four would find 0.66 of the neighbours.
LABEL_PROBES = 8


def _queries(df: DataFrame) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return df.filter("vec_id % 50 = 0")


def knn_exact_l2(spark, d):
    e = table(spark, d, "embeddings")
    return ivf.knn(e, _queries(e), K).select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


def knn_cosine(spark, d):
    e = table(spark, d, "embeddings")
    return ivf.knn(e, _queries(e), K, cosine=True).select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


def _label_means(e: DataFrame) -> np.ndarray:
    """A fixed centroid for each label: the mean of its vectors."""
    rows = (e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
            .groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("label").collect())
    return np.array([[p["x"] for p in r["v"]] for r in rows])


def ivf_assign_fixed_centroids(spark, d):
    e = table(spark, d, "embeddings")
    return ivf.assign(e, _label_means(e)).select("vec_id", "cluster")


def ivf_probe_topk(spark, d):
    """The query set over the lists of each query's eight nearest fixed centroids, read back from sorted files."""
    e = table(spark, d, "embeddings")
    c, path = _label_means(e), scratch(spark, "ivf")
    ivf.write_lists(ivf.assign(e, c), path)
    return ivf.search(spark.read.parquet(path), _queries(e), c, K, LABEL_PROBES).select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


def ivf_recall(spark, d):
    """Recall at 10 of trained and of fixed lists against brute force; both at least 0.9."""
    e, out = table(spark, d, "embeddings"), None
    exact = ivf.knn(e, _queries(e), K)
    for name, c, probes in (("trained", ivf.train(e, CLUSTERS), PROBES), ("fixed", _label_means(e), LABEL_PROBES)):
        r = ivf.recall(ivf.search(ivf.assign(e, c), _queries(e), c, K, probes), exact).select(F.lit(name).alias("lists"), (F.col("recall") >= 0.9).alias("enough"), "n")
        out = r if out is None else out.unionByName(r)
    return out


def ivf_search(spark, d):
    e = table(spark, d, "embeddings")
    c = ivf.train(e, CLUSTERS)
    return ivf.search(ivf.assign(e, c), _queries(e), c, K, PROBES).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


# -- dashboards and lookups -----------------------------------------------------
def dash_daily_distinct_users(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("n"))


def dash_top_users(spark, d):
    e = table(spark, d, "events").filter("event_type = 'view'")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("views")).orderBy(F.desc("views"), "user_id").limit(10)


def dash_hourly(spark, d):
    e = table(spark, d, "events").filter("ts >= timestamp_ntz'2024-01-08' and ts < timestamp_ntz'2024-01-15'")
    return e.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def dash_regions(spark, d):
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def visitor_history(spark, d):
    return table(spark, d, "events").filter("user_id = 17").orderBy("ts", "event_id").limit(100).select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_type")


def area_summary(spark, d):
    """Counts and sums inside a box of two value ranges."""
    li = table(spark, d, "lineitem").filter("l_quantity between 10 and 20 and l_discount between 0.02 and 0.05")
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


def orders_by_customer(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return (o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey", "c_name")
            .agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")))


def id_range_sum(spark, d):
    return table(spark, d, "lineitem").filter("l_orderkey between 1000 and 1999").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


def dim_table_keys(spark, d):
    """Dense surrogate keys in name order; only the distinct names meet in one place."""
    names = table(spark, d, "part").select("p_brand").distinct()
    return names.select((F.row_number().over(Window.orderBy("p_brand")) - 1).cast("long").alias("key"), "p_brand")


def ntile_buckets(spark, d):
    """Eight equal-depth buckets of the customers, as a sorted load is cut.

    Rows are ranged by the order and written; a row's number is that in its
    part plus the rows of the parts before, so no task numbers the whole table.
    """
    n, path, order = 8, scratch(spark, "ranged"), ["c_mktsegment", "c_custkey"]
    table(spark, d, "customer").select(*order).repartitionByRange(*order).withColumn("part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.schema("c_mktsegment string, c_custkey long, part int").parquet(path)
    sizes = sorted((r["part"], r["rows"]) for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).collect())  # one row a part
    total, before = sum(r for _, r in sizes), dict(zip((p for p, _ in sizes), np.cumsum([0, *(r for _, r in sizes)]).tolist()))
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "part int, before long")
    at = ranged.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(*order))).join(F.broadcast(offsets), "part").withColumn("k", F.col("k") + F.col("before") - 1)
    size, more = divmod(total, n)  # the first ``more`` buckets have one row more
    wide = more * (size + 1)
    bucket = F.when(F.col("k") < wide, F.floor(F.col("k") / (size + 1))).otherwise(more + F.floor((F.col("k") - wide) / max(size, 1))) + 1
    return at.groupBy(bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high"))


def anti_join_new_keys(spark, d):
    """Parts never sold at full quantity: values a dimension load has not seen."""
    full = table(spark, d, "lineitem").filter("l_quantity >= 50")
    return table(spark, d, "part").join(full, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


def union_all_paths(spark, d):
    f, g = table(spark, d, "files").select("file_id"), table(spark, d, "dbfileids").select("file_id")
    return f.withColumn("kind", F.lit("volume")).unionByName(g.withColumn("kind", F.lit("database"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_id").alias("files"))


def approx_quantiles(spark, d):
    """Approximate quartiles, and whether each lies within a thousandth of its rank."""
    li, at = table(spark, d, "lineitem"), [0.25, 0.5, 0.75]
    q = li.agg(F.percentile_approx("l_extendedprice", F.array(*map(F.lit, at)), 10_000).alias("q")).select(F.posexplode("q").alias("i", "price"))
    ranks = li.join(F.broadcast(q)).groupBy("i").agg(F.avg((F.col("l_extendedprice") <= F.col("price")).cast("int")).alias("upto"), F.avg((F.col("l_extendedprice") < F.col("price")).cast("int")).alias("below"))
    wanted = F.element_at(F.array(*map(F.lit, at)), F.col("i") + 1)
    return ranks.select(wanted.alias("quantile"), ((F.col("below") <= wanted + 0.001) & (F.col("upto") >= wanted - 0.001)).alias("close"))


def exact_median(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.expr("percentile(o_totalprice, 0.5)").alias("median"))


def latest_version_at(spark, d):
    """For each database file the row at or below generation 3: the store's own lookup."""
    f = table(spark, d, "dbfiles").filter("gen <= 3")
    return f.groupBy("db_id", "path").agg(F.max(F.struct("gen", "file_id", "size")).alias("v")).select("db_id", "path", "v.gen", "v.file_id", "v.size")


def sampled_by_hash(spark, d):
    """A fixed sample: the 100 orders of least key hash, the same on every run and layout."""
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 2654435761 % 4294967296).alias("h")).orderBy("h", "o_orderkey").limit(100)


def prepared_lookup(spark, d):
    """A parameterised statement, bound twice."""
    table(spark, d, "orders").createOrReplaceTempView("lakeglean_orders")
    sql = "select :status as status, count(*) as n, round(sum(o_totalprice), 2) as total from lakeglean_orders where o_orderstatus = :status"
    return spark.sql(sql, {"status": "O"}).unionByName(spark.sql(sql, {"status": "F"}))


QUERIES = {f.__name__: f for f in (
    knn_exact_l2, knn_cosine, ivf_assign_fixed_centroids, ivf_probe_topk, ivf_recall, ivf_search, dash_daily_distinct_users, dash_top_users, dash_hourly, dash_regions,
    visitor_history, area_summary, orders_by_customer, id_range_sum, dim_table_keys, ntile_buckets, anti_join_new_keys, union_all_paths, approx_quantiles, exact_median, latest_version_at,
    sampled_by_hash, prepared_lookup)}
_DIST = "sqrt(list_sum(list_transform(list_zip(b.embedding, q.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))))"
_DOT = "list_sum(list_transform(list_zip({0}.embedding, {1}.embedding), lambda z: z[1]::double * z[2]::double))"
_MEANS = """with m as (select label, list(x order by i) v from (select label, i, avg(x) x from (select label, unnest(range(1, 65)) i, unnest(embedding)::double x from embeddings) group by 1, 2) group by 1),
c as (select row_number() over (order by label) - 1 as cluster, v from m),
near as (select vec_id, cluster, list_sum(list_transform(list_zip(embedding, v), lambda z: (z[1]::double - z[2]) * (z[1]::double - z[2]))) d2 from embeddings cross join c)
"""
SQL = {
    "knn_exact_l2": f"select q.vec_id query_id, b.vec_id, round({_DIST}, 6) distance from embeddings q cross join embeddings b where q.vec_id % 50 = 0 qualify row_number() over (partition by q.vec_id order by {_DIST}, b.vec_id) <= 10",
    "knn_cosine": f"select query_id, vec_id, abs(round(c, 6)) distance from (select q.vec_id query_id, b.vec_id, 1.0::double - {_DOT.format('b', 'q')} / (sqrt({_DOT.format('b', 'b')}) * sqrt({_DOT.format('q', 'q')})) c from embeddings q cross join embeddings b where q.vec_id % 50 = 0) qualify row_number() over (partition by query_id order by c, vec_id) <= 10",
    "ivf_assign_fixed_centroids": _MEANS + "select vec_id, cluster from near qualify row_number() over (partition by vec_id order by d2, cluster) = 1",
    "ivf_probe_topk": _MEANS + f", own as (select vec_id, cluster from near qualify row_number() over (partition by vec_id order by d2, cluster) = 1), p as (select vec_id query_id, cluster from near where vec_id % 50 = 0 qualify row_number() over (partition by vec_id order by d2, cluster) <= 8) select query_id, b.vec_id, round({_DIST}, 6) distance from p join own on own.cluster = p.cluster join embeddings b on b.vec_id = own.vec_id join embeddings q on q.vec_id = query_id qualify row_number() over (partition by query_id order by {_DIST}, b.vec_id) <= 10",
    "ivf_recall": "select lists, true as enough, 10 * count(*) as n from embeddings cross join (values ('trained'), ('fixed')) v(lists) where vec_id % 50 = 0 group by 1",
    "dash_daily_distinct_users": "select strftime(ts, '%Y-%m-%d') as day, count(distinct user_id) users, count(*) n from events group by 1",
    "dash_top_users": "select user_id, count(*) as views from events where event_type = 'view' group by 1 order by 2 desc, 1 limit 10",
    "dash_hourly": "select cast(extract(hour from ts) as int) as hour, count(*) n, round(avg(value), 6) as mean from events where ts >= '2024-01-08' and ts < '2024-01-15' group by 1",
    "dash_regions": "select r_name, count(*) customers, round(sum(c_acctbal), 2) balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1",
    "visitor_history": "select event_id, epoch_us(ts) ts_us, event_type from events where user_id = 17 order by ts, event_id limit 100",
    "area_summary": "select l_returnflag, count(*) n, round(sum(l_extendedprice), 2) price from lineitem where l_quantity between 10 and 20 and l_discount between 0.02::double and 0.05::double group by 1",
    "orders_by_customer": "select c_custkey, c_name, count(*) orders, round(sum(o_totalprice), 2) total from orders join customer on o_custkey = c_custkey group by 1, 2",
    "id_range_sum": "select count(*) n, round(sum(l_extendedprice), 2) total from lineitem where l_orderkey between 1000 and 1999",
    "dim_table_keys": "select row_number() over (order by p_brand) - 1 as key, p_brand from (select distinct p_brand from part)",
    "ntile_buckets": "select bucket, count(*) n, min(c_custkey) low, max(c_custkey) high from (select c_custkey, cast(ntile(8) over (order by c_mktsegment, c_custkey) as int) bucket from customer) group by 1",
    "anti_join_new_keys": "select p_partkey from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity >= 50)",
    "union_all_paths": "select kind, count(*) n, count(distinct file_id) files from (select 'volume' kind, file_id from files union all select 'database', file_id from dbfileids) group by 1",
    "approx_quantiles": "select quantile, true as close from (values (0.25::double), (0.5::double), (0.75::double)) v(quantile)",
    "exact_median": "select o_orderstatus, quantile_cont(o_totalprice, 0.5) median from orders group by 1",
    "latest_version_at": "select db_id, path, gen, file_id, size from dbfiles where gen <= 3 qualify row_number() over (partition by db_id, path order by gen desc, file_id desc nulls last, size desc nulls last) = 1",
    "sampled_by_hash": "select o_orderkey, o_orderkey * 2654435761 % 4294967296 as h from orders order by 2, 1 limit 100",
    "prepared_lookup": "select o_orderstatus status, count(*) n, round(sum(o_totalprice), 2) total from orders where o_orderstatus in ('O', 'F') group by 1",
}
