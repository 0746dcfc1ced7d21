"""Queries fn_*: the scalar, list, JSON, date, aggregate and layout functions that recipes use."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeglean.functions.curves import hilbert_key, scaled, zorder_key
from lakeglean.session import ship, table


def fn_strings(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"), F.repeat("c_mktsegment", 2).alias("twice"), F.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("trimmed"),
                    F.array_join(F.split("c_name", "#"), "/").alias("parts"), F.col("c_name").startswith("Customer#00000001").alias("starts"), F.col("c_mktsegment").like("%B%").alias("is_like"))


def fn_lists(spark, d):
    e = table(spark, d, "embeddings")
    x = F.transform("embedding", lambda v: F.round(v.cast("double") * 100, 0).cast("int"))
    return e.select("vec_id", F.array_join(F.slice(x, 1, 3).cast("array<string>"), ",").alias("head"), F.size(F.filter(x, lambda v: v > 0)).alias("positive"), F.array_contains(x, 7).alias("has7"), F.size(F.array_prepend(x, F.lit(0))).alias("longer"), F.array_max(x).alias("top"))


def fn_json(spark, d):
    e = table(spark, d, "events")
    made = F.to_json(F.struct("event_type", F.struct("user_id").alias("who")))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object(made, "$.who.user_id").cast("long").alias("who"), F.variant_get(F.parse_json("props"), "$.k", "int").alias("v"))


def fn_dates(spark, d):
    o = table(spark, d, "orders")
    day = F.to_date("o_orderdate")
    return o.select("o_orderkey", F.date_add(day, 30).cast("string").alias("due"), F.hour("o_orderdate").alias("hour"), F.datediff(day, F.lit("1992-01-01").cast("date")).alias("n_days"), F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM").alias("month"),
                    F.unix_seconds(F.timestamp_millis(F.col("o_orderkey") * 1000)).alias("at"))


def fn_conditional(spark, d):
    f = table(spark, d, "files")
    kind = F.when(F.col("size").isNull(), "unknown").when(F.col("size") < 0, "minus").when(F.col("size") < 1048576, "small").otherwise("large")
    return f.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))


def fn_aggregates(spark, d):
    """arg_min, arg_max, ordered list slice, bool_and, distinct count, exact and grouped by all."""
    li = table(spark, d, "lineitem")
    key = F.struct("l_extendedprice", "l_orderkey", "l_linenumber")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.min_by("l_orderkey", key).alias("cheapest"), F.max_by("l_orderkey", key).alias("dearest"), F.every(F.col("l_quantity") > 0).alias("all_positive"),
        F.countDistinct("l_suppkey").alias("suppliers"), F.round(F.avg("l_discount"), 6).alias("discount"))


def fn_first_files(spark, d):
    """For each directory of a volume its first three paths in byte order."""
    f = table(spark, d, "files").select("volume", "path").distinct().withColumn("dir", F.regexp_replace("path", "[^/]*$", ""))
    w = Window.partitionBy("volume", "dir").orderBy("path")
    return f.withColumn("n", F.row_number().over(w)).filter("n <= 3").select("volume", "path", "n")


def fn_lookup_at_version(spark, d):
    """Left join with the newest row at or below a version, per file; files without one stay."""
    ids = table(spark, d, "dbfileids").select("file_id", "db_id").distinct()
    gens = table(spark, d, "dbchunks").filter("gen <= 5").groupBy("file_id").agg(F.max("gen").alias("gen"))
    return ids.join(gens, "file_id", "left").select("file_id", "db_id", "gen")


def fn_join_on_expression(spark, d):
    """Equi-join on a computed key: orders meet the nation of key % 25."""
    o = table(spark, d, "orders").withColumn("bucket", (F.col("o_custkey") % 25).cast("int"))
    return o.join(table(spark, d, "nation"), F.col("bucket") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


def fn_semi_join(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "lineitem").filter("l_quantity >= 49"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


def fn_time_window(spark, d):
    e = table(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.unix_seconds("w.start").alias("start"), "event_type", "n")


def fn_zorder_layout(spark, d):
    """Sort keys of parts by (size, price), and the bucket of an equal-depth cut of them."""
    p = table(spark, d, "part")
    return p.select("p_partkey", zorder_key(F.col("p_size"), F.floor("p_retailprice").cast("long")).alias("key"))


def fn_hilbert_layout(spark, d):
    ship(spark)
    p = table(spark, d, "part")
    return p.select("p_partkey", hilbert_key(scaled(F.col("p_size"), 0, 64), scaled(F.col("p_retailprice"), 0, 4096)).alias("key"))


QUERIES = {f.__name__: f for f in (fn_strings, fn_lists, fn_json, fn_dates, fn_conditional, fn_aggregates, fn_first_files, fn_lookup_at_version, fn_join_on_expression, fn_semi_join, fn_time_window, fn_zorder_layout, fn_hilbert_layout)}
_X = "list_transform(embedding, lambda v: cast(round(v::double * 100) as int))"
SQL = {
    "fn_strings": "select c_custkey, lpad(cast(c_custkey as varchar), 8, '0') padded, repeat(c_mktsegment, 2) twice, trim('  ' || c_name || ' ') trimmed, array_to_string(string_split(c_name, '#'), '/') parts, starts_with(c_name, 'Customer#00000001') \"starts\", c_mktsegment like '%B%' is_like from customer",
    "fn_lists": f"select vec_id, array_to_string(({_X})[1:3], ',') head, len(list_filter({_X}, lambda v: v > 0)) positive, list_contains({_X}, 7) has7, len(list_prepend(0, {_X})) longer, list_max({_X}) top from embeddings",
    "fn_json": "select event_id, cast(props->>'$.k' as int) k, user_id who, cast(props->>'$.k' as int) v from events",
    "fn_dates": "select o_orderkey, cast(cast(o_orderdate as date) + 30 as varchar) due, cast(extract(hour from o_orderdate) as int) as hour, cast(date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as int) n_days, strftime(o_orderdate, '%Y-%m') as month, o_orderkey as at from orders",
    "fn_conditional": "select case when size is null then 'unknown' when size < 0 then 'minus' when size < 1048576 then 'small' else 'large' end kind, count(*) n, cast(sum(coalesce(size, 0)) as bigint) bytes from files group by 1",
    "fn_aggregates": "select l_returnflag, l_linestatus, arg_min(l_orderkey, (l_extendedprice, l_orderkey, l_linenumber)) cheapest, arg_max(l_orderkey, (l_extendedprice, l_orderkey, l_linenumber)) dearest, bool_and(l_quantity > 0) all_positive, count(distinct l_suppkey) suppliers, round(avg(l_discount), 6) discount from lineitem group by all",
    "fn_first_files": "select volume, path, row_number() over (partition by volume, regexp_replace(path, '[^/]*$', '') order by path) n from (select distinct volume, path from files) qualify n <= 3",
    "fn_lookup_at_version": "select i.file_id, i.db_id, g.gen from (select distinct file_id, db_id from dbfileids) i left join (select file_id, max(gen) gen from dbchunks where gen <= 5 group by 1) g on g.file_id = i.file_id",
    "fn_join_on_expression": "select n_name, count(*) n from orders join nation on o_custkey % 25 = n_nationkey group by 1",
    "fn_semi_join": "select s_suppkey, s_name from supplier where s_suppkey in (select l_suppkey from lineitem where l_quantity >= 49)",
    "fn_time_window": "select cast(epoch(time_bucket(interval '6 hours', ts, timestamp '1970-01-01')) as bigint) as start, event_type, count(*) n from events group by 1, 2",
    "fn_zorder_layout": "select p_partkey, cast(list_sum(list_transform(range(16), lambda i: (((p_size::bigint >> i) & 1) << (2 * i)) + (((cast(floor(p_retailprice) as bigint) >> i) & 1) << (2 * i + 1)))) as bigint) as key from part",
}
