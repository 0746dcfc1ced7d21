"""Queries lake_*, inc_index_*, db_*, volume_*: versioned storage on the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeglean.session import scratch, table
from lakeglean.sources.database import Database, missing_references, unique_violations
from lakeglean.sources.lake import LakeTable
from lakeglean.sources.volume import VolumeStore
from lakeglean.streaming.incremental_index import IncrementalIndex, latest_per_row

TEXT = [{"name": "doc_id", "type": "i64", "options": {"stored": True, "fast": True}}, {"name": "text", "type": "text"}]


def _orders(spark: SparkSession, d: str) -> LakeTable:
    """create (version 1), insert (2), update (3), delete (4)."""
    o = table(spark, d, "orders")
    t = LakeTable(spark, scratch(spark, "lake"))
    t.create(o.filter("o_orderkey % 3 <> 0"), sorted_by=["o_orderkey"], not_null=["o_orderkey"])
    t.insert(o.filter("o_orderkey % 3 = 0"))
    t.update("o_orderkey % 10 = 1", {"o_totalprice": F.col("o_totalprice") * 2})
    t.delete("o_orderkey % 7 = 0")
    return t


def lake_time_travel_count(spark, d):
    t, out = _orders(spark, d), None
    for v in range(1, 5):
        one = t.at(v).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn("version", F.lit(v))
        out = one if out is None else out.unionByName(one)
    return out


def lake_after_delete(spark, d):
    return _orders(spark, d).at().select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def lake_change_feed(spark, d):
    return _orders(spark, d).changes(2, 4).groupBy("change_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.sum("o_orderkey").alias("keys"))


def lake_latest_per_rowid(spark, d):
    """Each row's last event of the feed, deletes included."""
    last = latest_per_row(_orders(spark, d).changes(1, 4))
    return last.select("o_orderkey", "change_type")


def lake_compacted_equals(spark, d):
    t = _orders(spark, d)
    before = t.files().count()
    t.compact()
    return t.at().agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")).withColumn("fewer", F.lit(t.files().count() <= before)).withColumn("changes", F.lit(t.changes(5).count()))


def lake_rewritten(spark, d):
    t = _orders(spark, d)
    t.rewrite(0.05)
    t.expire(5)
    t.cleanup(0)
    return t.at().groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def _indexed(spark: SparkSession, d: str) -> IncrementalIndex:
    docs = table(spark, d, "documents").select("doc_id", "text")
    t = LakeTable(spark, scratch(spark, "lake"))
    t.create(docs.filter("doc_id % 4 <> 3"))
    ix = IncrementalIndex(spark, t, scratch(spark, "index"), TEXT)
    ix.run()
    t.insert(docs.filter("doc_id % 4 = 3"))
    t.update("doc_id % 5 = 0", {"text": F.concat(F.lit("zebrafish "), F.coalesce("text", F.lit("")))})
    ix.run()
    t.delete("doc_id % 6 = 0")
    return ix


def inc_index_live_counts(spark, d):
    """Before and after the delete-only commit is indexed."""
    ix = _indexed(spark, d)
    early = ix.search("zebrafish").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.lit("before")).first()
    ix.run()
    late = ix.search("zebrafish").agg(F.count(F.lit(1)).alias("n")).first()
    return spark.createDataFrame([("before", early["n"]), ("after", late["n"])], "step string, n long")


def inc_index_stream(spark, d):
    """The same, driven by a stream over the table's log; coherent with the table."""
    ix = _indexed(spark, d)
    q = ix.follow(scratch(spark, "stream"))
    q.awaitTermination()
    return ix.rows("canary").select("doc_id")


def inc_index_compacted(spark, d):
    ix = _indexed(spark, d)
    ix.run()
    docs = ix.compact()
    return ix.search("canary").agg(F.count(F.lit(1)).alias("n")).withColumn("docs", F.lit(docs).cast("long"))


def db_pinned_snapshot(spark, d):
    db = Database(spark, scratch(spark, "db"))
    w = db.writer()
    w.create("customers", table(spark, d, "customer"), primary_key=["c_custkey"])
    w.create("orders", table(spark, d, "orders").filter("o_orderkey % 2 = 0"), primary_key=["o_orderkey"], foreign_keys=[(["o_custkey"], "customers", ["c_custkey"])], checks=["o_totalprice >= 0"])
    w.commit()
    pinned = db.at()
    w.append("orders", table(spark, d, "orders").filter("o_orderkey % 2 = 1"))
    w.commit()
    counts = lambda s, name: s.table("orders").join(s.table("customers"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("at", F.lit(name))
    return counts(pinned, "pinned").unionByName(counts(db.at(), "newest"))


def db_fk_violations(spark, d):
    """Chunks of database files whose file is not registered, as a foreign-key check finds them."""
    return missing_references(table(spark, d, "dbfiles").select("db_id", "gen", "file_id"), ["file_id"], table(spark, d, "dbfileids"), ["file_id"]).distinct()


def db_unique_violations(spark, d):
    return unique_violations(table(spark, d, "dbgens"), ["db_id", "gen"])


def volume_listing(spark, d):
    """Files of a volume after publishing, replacing, renaming and removing, as a DataFrame."""
    store = VolumeStore(spark, scratch(spark, "volumes"))
    for i in range(6):
        store.publish("plain", f"a/{i % 3}/f{i}.bin", bytes([i]) * (i + 1))
    store.publish("plain", "a/0/f0.bin", b"replaced")
    store.rename("plain", "a/1/f1.bin", "b/f1.bin")
    store.remove("plain", "a/2/f2.bin")
    return store.frame("plain").select("path", "size")


def volume_blobs(spark, d):
    store = VolumeStore(spark, scratch(spark, "volumes"))
    for i in range(4):
        store.publish("plain", f"x/{i}.txt", b"abc" * i)
    return store.blobs("plain", "x/*.txt").select("path", F.length("content").alias("n"))


QUERIES = {f.__name__: f for f in (
    lake_time_travel_count, lake_after_delete, lake_change_feed, lake_latest_per_rowid, lake_compacted_equals, lake_rewritten, inc_index_live_counts, inc_index_stream, inc_index_compacted,
    db_pinned_snapshot, db_fk_violations, db_unique_violations, volume_listing, volume_blobs)}
_PRICE = "case when o_orderkey % 10 = 1 then o_totalprice * 2 else o_totalprice end"
_WS = r"list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x))"
SQL = {
    "lake_time_travel_count": f"""select 1 as version, count(*) n, round(sum(o_totalprice), 2) total from orders where o_orderkey % 3 <> 0
        union all select 2, count(*), round(sum(o_totalprice), 2) from orders union all select 3, count(*), round(sum({_PRICE}), 2) from orders
        union all select 4, count(*), round(sum({_PRICE}), 2) from orders where o_orderkey % 7 <> 0""",
    "lake_after_delete": f"select o_orderkey, o_custkey, o_orderstatus, {_PRICE} o_totalprice from orders where o_orderkey % 7 <> 0",
    "lake_change_feed": f"""with e as (select 'insert' change_type, o_totalprice p, o_orderkey k from orders where o_orderkey % 3 = 0
        union all select 'update_preimage', o_totalprice, o_orderkey from orders where o_orderkey % 10 = 1 union all select 'update_postimage', o_totalprice * 2, o_orderkey from orders where o_orderkey % 10 = 1
        union all select 'delete', {_PRICE}, o_orderkey from orders where o_orderkey % 7 = 0) select change_type, count(*) n, round(sum(p), 2) total, cast(sum(k) as bigint) as keys from e group by 1""",
    "lake_latest_per_rowid": "select o_orderkey, case when o_orderkey % 7 = 0 then 'delete' when o_orderkey % 10 = 1 then 'update_postimage' else 'insert' end change_type from orders",
    "lake_compacted_equals": "select count(*) n, cast(sum(o_orderkey) as bigint) as keys, true as fewer, 0 as changes from orders where o_orderkey % 7 <> 0",
    "lake_rewritten": "select o_orderstatus, count(*) n from orders where o_orderkey % 7 <> 0 group by 1",
    "inc_index_live_counts": "select 'before' step, count(*) n from documents where doc_id % 5 = 0 union all select 'after', count(*) from documents where doc_id % 5 = 0 and doc_id % 6 <> 0",
    "inc_index_stream": f"select doc_id from documents where doc_id % 6 <> 0 and list_contains({_WS}, 'canary')",
    "inc_index_compacted": f"select (select count(*) from documents where doc_id % 6 <> 0 and list_contains({_WS}, 'canary')) n, (select count(*) from documents where doc_id % 6 <> 0) docs",
    "db_pinned_snapshot": "select c_mktsegment, count(*) n, 'pinned' as at from orders join customer on o_custkey = c_custkey where o_orderkey % 2 = 0 group by 1 union all select c_mktsegment, count(*), 'newest' from orders join customer on o_custkey = c_custkey group by 1",
    "db_fk_violations": "select distinct db_id, gen, file_id from dbfiles where file_id is not null and file_id not in (select file_id from dbfileids where file_id is not null)",
    "db_unique_violations": "select db_id, gen, count(*) n from dbgens where db_id is not null and gen is not null group by 1, 2 having count(*) > 1",
    "volume_listing": "select * from (values ('a/0/f0.bin', 8), ('a/0/f3.bin', 4), ('a/1/f4.bin', 5), ('a/2/f5.bin', 6), ('b/f1.bin', 2)) t(path, size)",
    "volume_blobs": "select * from (values ('x/0.txt', 0), ('x/1.txt', 3), ('x/2.txt', 6), ('x/3.txt', 9)) t(path, n)",
}
