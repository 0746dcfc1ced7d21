"""Far too many small files: plans and rewrites them through an adaptive REBALANCE."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeglean.session import scratch
from lakeglean.sources.fs import Fs

SMALL = 1_048_576
TARGET = 128 * 1_048_576
#: Outputs of a directory that one task of the plan cuts.
PART_OUTPUTS = 64


class ChecksumMismatch(RuntimeError):
    """Input and output are not the same multiset of rows; nothing was committed."""


@contextmanager
def advisory(spark: SparkSession, size: int):
    """Runtime statistics aim at partitions of ``size`` bytes inside the block."""
    keys = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(size),
            "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def multiset_checksum(df: DataFrame) -> tuple:
    """(rows, sum of row hashes, xor of row hashes): equal for equal multisets in any order."""
    row = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns)), F.concat(*(F.col(f"`{c}`").isNull().cast("string") for c in sorted(df.columns))))
    return tuple(df.select(row.alias("h")).agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first())


def directory(path: Column) -> Column:
    """The path up to and with its last '/', or '' for none."""
    return F.left(path, F.length(path) - F.length(F.substring_index(path, "/", -1)))


def present_versions(files: DataFrame, garbage: DataFrame) -> DataFrame:
    """The present version of each published path.

    The row with the largest file_id of a (volume, path) is present; if that
    file is in ``garbage`` the path is unpublished. Rows that repeat are one;
    if they differ in size, the largest known size holds.
    """
    newest = (files.filter("file_id is not null").groupBy("volume", "path")
              .agg(F.max(F.struct("file_id", F.coalesce("size", F.lit(-1)).alias("size"))).alias("v"))
              .select("volume", "path", "v.file_id", "v.size"))
    dead = garbage.select("file_id").filter("file_id is not null").distinct()
    return newest.join(dead, "file_id", "left_anti")


def small_files(files: DataFrame, garbage: DataFrame, company: int = 5, below: int = SMALL) -> DataFrame:
    """(volume, dir, path, file_id, size): small published files with ``company`` in their directory.

    A null or negative size is unknown, hence not small. Null volume and null
    path are values of their own. Counting is a partial aggregate joined back,
    so a directory with a third of all files is never one task's work.
    """
    small = (present_versions(files, garbage).filter((F.col("size") >= 0) & (F.col("size") < below))
             .withColumn("dir", directory(F.col("path"))))
    busy = small.groupBy("volume", "dir").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= company).select(F.col("volume").alias("v"), F.col("dir").alias("d"))
    return small.join(busy, small["volume"].eqNullSafe(busy["v"]) & small["dir"].eqNullSafe(busy["d"]), "left_semi").select("volume", "dir", "path", "file_id", "size")


def plan_merges(small: DataFrame, target: int = TARGET) -> DataFrame:
    """Assign each small file to one output file and one byte range of it.

    Columns: volume, dir, path, file_id, size, output (path of the merged file
    in its volume), first_byte.

    Rows are shuffled by directory under REBALANCE, each file as one row for
    every mean file size it holds, so the runtime statistics weigh files by
    their bytes: small directories are merged into one partition of the plan,
    a directory of more than ``PART_OUTPUTS`` outputs is split, and none is one
    task's work. Within a partition running sums in file order cut each
    directory into outputs. No output exceeds ``target`` (unless one file
    does), and only the last of a directory in a partition has fewer bytes than
    ``target`` less twice the largest small file.

    The plan is committed only if it is the same multiset of (volume, path,
    file_id, size) as its input, else ChecksumMismatch is raised. No files, no
    plan.
    """
    spark = small.sparkSession
    root = scratch(spark, "merge-plan")
    fs = Fs(spark, root)
    small.write.parquet(f"{root}/files")
    source = spark.read.schema(small.schema).parquet(f"{root}/files")
    n, total, largest = source.agg(F.count(F.lit(1)), F.sum("size"), F.max("size")).first()
    unit = max((total or 0) // max(n, 1), 1)
    row_bytes = sum(size for _, size in fs.data_files("files")) / max(n, 1)
    with advisory(spark, max(int(PART_OUTPUTS * target / unit * row_bytes), 1 << 16)):
        weighed = source.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / unit) - 1, F.lit(0).cast("long")))))
        weighed.hint("rebalance", "volume", "dir").filter("__k = 0").drop("__k").withColumn("part", F.spark_partition_id()).write.parquet(f"{root}/parts")
    parts = spark.read.schema(T.StructType([*small.schema.fields, T.StructField("part", T.IntegerType())])).parquet(f"{root}/parts")
    w = Window.partitionBy("part", "volume", "dir").orderBy("file_id", "path")
    room = max(target - (largest or 0), 1)  # a file that starts in it ends within the target
    at = parts.withColumn("start", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("bin", F.floor(F.col("start") / room))
    first = F.min("start").over(Window.partitionBy("part", "volume", "dir", "bin"))
    output = F.concat(F.coalesce("dir", F.lit("null-")), F.lit("merged-"), F.col("part"), F.lit("-"), F.col("bin"))
    at.select("volume", "dir", "path", "file_id", "size", output.alias("output"), (F.col("start") - first).alias("first_byte")).write.parquet(f"{root}/plan")
    plan = spark.read.schema("volume string, dir string, path string, file_id long, size long, output string, first_byte long").parquet(f"{root}/plan")
    same = ["volume", "path", "file_id", "size"]
    if multiset_checksum(source.select(*same)) != multiset_checksum(plan.select(*same)):
        raise ChecksumMismatch("the plan does not hold each small file exactly once")
    for part in ("files", "parts"):
        fs.delete(part)
    return plan


def compact(spark: SparkSession, source: str, target: str, target_bytes: int = TARGET, by: list[str] = ()) -> dict:
    """Rewrite the Parquet files below ``source`` into fewer, well-sized ones at ``target``.

    Rows are shuffled under REBALANCE (on ``by``, if given), written to a
    staging folder, compared with the input as multisets and only then renamed
    to ``target``, which must not exist. Returns counts of rows and files.
    """
    fs = Fs(spark, target.rsplit("/", 1)[0])
    name, stage = target.rsplit("/", 1)[1], f".staging-{target.rsplit('/', 1)[1]}"
    if fs.exists(name):
        raise FileExistsError(target)
    df = spark.read.parquet(source)
    fs.delete(stage)
    with advisory(spark, target_bytes):
        df.hint("rebalance", *by).write.parquet(f"{fs.root}/{stage}")
    made = spark.read.schema(df.schema).parquet(f"{fs.root}/{stage}")
    before, after = multiset_checksum(df), multiset_checksum(made)
    if before != after:
        fs.delete(stage)
        raise ChecksumMismatch(f"{before} became {after}")
    if not fs.rename(stage, name):
        raise ChecksumMismatch(f"{target} was published by another writer")
    return {"rows": after[0], "files_before": len(df.inputFiles()), "files_after": len(made.inputFiles())}
