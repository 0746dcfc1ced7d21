"""Queries p1 to p5: the general data-preparation operators on the store tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeglean.operators import changefeed, compaction, incremental, orphans, skew
from lakeglean.session import scratch, table

DOMINANT = 0.02


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    pending = incremental.pending_versions(t("dbgens"), t("dbs"), t("index_runs"), scratch(spark, "versions"))
    return pending.select("db_id", "gen")


def p1_pending_by_db(spark: SparkSession, d: str) -> DataFrame:
    """What the next run of each database must take: how many versions, from which to which."""
    return p1_found(spark, d).groupBy("db_id").agg(F.count(F.lit(1)).alias("n_gens"), F.min("gen").alias("first_gen"), F.max("gen").alias("last_gen"))


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    """Of the runs that kept p1_found up to date: the deliveries they read in all, and whether each read just the files that had arrived."""
    t, root = (lambda n: table(spark, d, n)), scratch(spark, "versions")
    incremental.pending_versions(t("dbgens"), t("dbs"), t("index_runs"), root)
    log = incremental.PendingVersions(spark, root)
    read, arrived, n = [], [], 0
    for v in log.pending.versions():
        m = log.pending.manifest(v)
        read.append(m["files_read"])
        arrived.append({f"pending/{name}": len(t.manifest(v)["add"]) for name, t in (("gens", log.gens), ("runs", log.runs))})
        n += log.gens.diff(v - 1, v).count()
    return spark.createDataFrame([(len(read), n, read == arrived)], "n_runs long, n_deliveries long, only_arrived boolean")


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    return skew.sequence_profile(table(spark, d, "chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.dominant_keys(table(spark, d, "chunks"), DOMINANT)


def _orphans(spark: SparkSession, d: str, months: bool = True) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return orphans.store_orphans(t("chunks"), t("files"), t("garbage"), t("dbfiles"), t("dbchunks"), t("dbgens"), t("dbfileids"), months)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d, months=False).select("src", "file_id").distinct()


def p3_orphans_by_period(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).groupBy("src", F.date_format("month", "yyyy-MM").alias("month")).agg(F.sum("n_refs").cast("long").alias("n_refs"), F.countDistinct("file_id").alias("n_files"))


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return compaction.plan_merges(compaction.small_files(table(spark, d, "files"), table(spark, d, "garbage")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).select("file_id").distinct()


def p4_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)


def p4_plan_by_volume(spark: SparkSession, d: str) -> DataFrame:
    """Files before the merge and their bytes; both are independent of how the plan was cut."""
    return _plan(spark, d).groupBy("volume").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size").cast("long").alias("n_bytes"), F.countDistinct("dir").alias("n_dirs"))


def p4_plan_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the plan however it was cut: each byte once, no gap, no output too large, few too small."""
    plan = _plan(spark, d)
    outs = plan.groupBy("volume", "dir", "output").agg(
        F.sum("size").alias("bytes"), F.max(F.col("first_byte") + F.col("size")).alias("end"), F.min("first_byte").alias("start"), F.count(F.lit(1)).alias("files"),
        F.countDistinct(F.when(F.col("size") > 0, F.col("first_byte"))).alias("starts"), F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("full"))
    part = F.regexp_extract("output", r"merged-(\d+)-\d+$", 1)
    low = F.when(F.col("bytes") < compaction.TARGET - 2 * compaction.SMALL, 1).otherwise(0)
    per = outs.withColumn("low", low).groupBy("volume", "dir", part.alias("part")).agg(
        F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.sum("low").alias("low"),
        F.max((F.col("end") != F.col("bytes")) | (F.col("start") != 0) | (F.col("starts") != F.col("full"))).alias("torn"), F.max("bytes").alias("largest"))
    return per.agg(F.sum("files").alias("n_files"), F.sum("bytes").cast("long").alias("n_bytes"), F.max("torn").alias("torn"), (F.max("largest") > compaction.TARGET).alias("too_large"), (F.max("low") > 1).alias("too_many"))


def p4_compacted_refs(spark: SparkSession, d: str) -> DataFrame:
    """The ``dbfileids`` table written as tiny files, compacted, and read back."""
    scattered, whole = scratch(spark, "scattered"), scratch(spark, "compacted")
    table(spark, d, "dbfileids").repartition(64).write.parquet(scattered)
    compaction.compact(spark, scattered, whole)
    return spark.read.parquet(whole).groupBy("db_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("file_id").alias("sum_ids"))


def p5_state(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.committed_files(table(spark, d, "dbfiles"), table(spark, d, "dbs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_state(spark, d).select("db_id", "path", "file_id")


def p5_from_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The same state, from the state at generation 2 and the later changes alone."""
    dbs, feed = table(spark, d, "dbs"), table(spark, d, "dbfiles")
    base = changefeed.committed_files(feed.filter("gen <= 2"), dbs)
    return changefeed.committed_files(feed.filter("gen > 2"), dbs, base=base)


QUERIES = {f.__name__: f for f in (p1_found, p1_pending_by_db, p1_runs, p2_found, p2_profile, p3_found, p3_orphans_by_period, p4_found, p4_plan, p4_plan_by_volume, p4_plan_checks, p4_compacted_refs, p5_found, p5_state, p5_from_snapshot)}

_HEAD = "head as (select db_id, max(committed_gen) head from dbs group by 1)"
_PENDING = f"""
with {_HEAD},
g as (select g.db_id, g.gen, max(g.committed_at) newest from dbgens g join head h on h.db_id = g.db_id and g.gen <= h.head group by 1, 2),
ok as (select * from index_runs where run_id in (select run_id from index_runs where lower(trim(status)) = 'succeeded')),
pending as (select db_id, gen from g where not exists (select 1 from ok r where r.db_id = g.db_id and r.from_gen < g.gen and g.gen <= r.to_gen and (g.newest is null or r.started_at >= g.newest)))
"""
_REFS = """
with month_of as (select db_id, gen, cast(date_trunc('month', max(committed_at)) as date) as month from dbgens group by 1, 2),
refs as (
  select 'chunks' src, cast(null as date) as month, file_id from chunks where file_id not in (select file_id from files where file_id is not null union all select file_id from garbage where file_id is not null)
  union all select 'dbchunks', null, file_id from dbchunks where file_id not in (select file_id from dbfileids where file_id is not null)
  union all select 'dbfiles', m.month, f.file_id from dbfiles f left join month_of m on m.db_id = f.db_id and m.gen = f.gen where f.file_id is not null and f.file_id not in (select file_id from dbfileids where file_id is not null)
  union all select 'dbgens', m.month, g.file_id from (select db_id, gen, unnest(list_transform(range(1, len(changes) + 1, 3), lambda i: changes[i])) file_id from dbgens) g left join month_of m on m.db_id = g.db_id and m.gen = g.gen where g.file_id is not null and g.file_id not in (select file_id from dbfileids where file_id is not null))
"""
_SMALL = """
with present as (select volume, path, file_id, coalesce(size, -1) size, regexp_replace(path, '[^/]*$', '') dir from (select distinct volume, path, file_id, size from files) qualify row_number() over (partition by volume, path order by file_id desc, coalesce(size, -1) desc) = 1),
small as (select * from present where file_id not in (select file_id from garbage where file_id is not null) and size between 0 and 1048575),
busy as (select * from small qualify count(*) over (partition by volume, dir) >= 5)
"""
_LIVE = f"""
with {_HEAD},
f as (select f.* from dbfiles f join head h on h.db_id = f.db_id and f.gen <= h.head),
live as (select * from f qualify row_number() over (partition by db_id, path order by gen desc, file_id desc nulls last, size desc nulls last) = 1)
"""
SQL = {
    "p1_found": _PENDING + "select db_id, gen from pending",
    "p1_pending_by_db": _PENDING + "select db_id, count(*) n_gens, min(gen) first_gen, max(gen) last_gen from pending group by 1",
    "p1_runs": "select 3 as n_runs, count(*) as n_deliveries, true as only_arrived from dbgens",
    "p2_found": "select file_id from chunks where file_id is not null group by 1 having count(*) >= 0.02 * (select count(*) from chunks)",
    "p2_profile": "select file_id, count(*) n_rows, count(distinct no) n_chunks, cast(min(no) as bigint) min_no, cast(max(no) as bigint) max_no, cast(case when max(no) >= 0 then max(no) + 1 - count(distinct case when no >= 0 then no end) else 0 end as bigint) n_gaps from chunks group by 1",
    "p3_found": _REFS + "select distinct src, file_id from refs",
    "p3_orphans_by_period": _REFS + "select src, strftime(month, '%Y-%m') as month, count(*) n_refs, count(distinct file_id) n_files from refs group by 1, 2",
    "p4_found": _SMALL + "select distinct file_id from busy",
    "p4_plan_by_volume": _SMALL + "select volume, count(*) n_files, cast(sum(size) as bigint) n_bytes, count(distinct dir) n_dirs from busy group by 1",
    "p4_plan_checks": _SMALL + "select count(*) n_files, cast(sum(size) as bigint) n_bytes, false torn, false too_large, false too_many from busy",
    "p4_compacted_refs": "select db_id, count(*) n_rows, cast(sum(file_id) as bigint) sum_ids from dbfileids group by 1",
    "p5_found": _LIVE + "select db_id, path, file_id from live where file_id is not null",
    "p5_from_snapshot": _LIVE + "select db_id, path, gen, file_id, size from live where file_id is not null",
    "p5_state": _LIVE + "select db_id, path, gen, file_id, size from live where file_id is not null",
}
