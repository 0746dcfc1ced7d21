"""Applying a stream of inserts, updates and deletes: newest-first resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeglean.session import scratch
from lakeglean.sources.fs import Fs

#: Number of change batches the feed is cut into by its order column.
BATCHES = 3


def _images(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The newest image of each key in one batch, combined before the shuffle."""
    best = F.max(F.struct(F.col(order), *(F.col(v) for v in values))).alias("__v")
    return df.groupBy(*keys).agg(best).select(*keys, f"__v.{order}", *(f"__v.{v}" for v in values))


def resolve(changes: DataFrame, keys: list[str], order: str, values: list[str], base: DataFrame | None = None,
            tombstone=None, batches: int = BATCHES) -> DataFrame:
    """Current rows (keys, order, values) after applying ``changes`` to ``base``.

    The feed is written once, cut into ``batches`` ranges of ``order``, and
    processed from the newest range backwards. In each, keys that a newer batch
    resolved are dropped by an anti join; the rest get their newest image, live
    or tombstone, which is written to the shared folder and never touched
    again. Finally base rows whose key no batch resolved are appended, and
    tombstones (rows for which ``tombstone`` holds) are left out.

    Repeated and out-of-order changes don't matter; among changes of one key
    with equal ``order`` the largest values win, null being the least, so a
    removal yields to a creation of the same number. A change older than the
    base row of its key, one that came late, yields to it; one as old as it
    wins. Changes with a null order are older than all others. Null keys are
    keys; a key of which base has several rows keeps them all or none. Columns
    beyond those named are ignored. Empty changes return base; empty both, no
    rows.
    """
    spark = changes.sparkSession
    if not keys or not values:
        raise ValueError("keys and values must be named")
    dead = F.coalesce(F.lit(False) if tombstone is None else tombstone, F.lit(False))
    feed = changes.select(*keys, order, *values)
    root, schema = scratch(spark, "resolved"), feed.schema
    feed.write.parquet(f"{root}/feed")
    staged = spark.read.schema(schema).parquet(f"{root}/feed")
    cuts = sorted(set(staged.approxQuantile(order, [i / batches for i in range(1, batches)], 0.02))) if batches > 1 else []
    bounds = [None, *cuts, None]
    known = lambda n: spark.read.schema(schema).parquet(*(f"{root}/{i}" for i in range(n)))
    for n, (lo, hi) in enumerate(reversed(list(zip(bounds, bounds[1:])))):
        part = staged
        if lo is not None:
            part = part.filter(F.col(order) > F.lit(lo))
        if hi is not None:
            part = part.filter((F.col(order) <= F.lit(hi)) | F.col(order).isNull() if lo is None else F.col(order) <= F.lit(hi))
        images = _images(part, keys, order, values)
        if n:
            images = _match(images, known(n), keys, "left_anti")
        images.write.parquet(f"{root}/{n}")
    Fs(spark, root).delete("feed")
    done = known(len(bounds) - 1)
    if base is None:
        return done.filter(~dead)
    images = done.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(order).alias("__order"), F.lit(True).alias("__changed"))
    met = base.select(*keys, order, *values).join(images, _same(base, images, keys), "left")
    newer = F.col(order) > F.col("__order")
    kept = met.filter(F.col("__changed").isNull() | F.coalesce(newer, F.col(order).isNotNull() & F.col("__order").isNull())).select(*keys, order, *values)
    kept.write.parquet(f"{root}/base")
    kept = spark.read.schema(schema).parquet(f"{root}/base")
    return _match(done, kept, keys, "left_anti").unionByName(kept).filter(~dead)


def _same(left: DataFrame, right: DataFrame, keys: list[str]):
    on = None
    for k in keys:
        test = left[k].eqNullSafe(right[f"__{k}"])
        on = test if on is None else on & test
    return on


def _match(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    r = right.select(*(F.col(k).alias(f"__{k}") for k in keys))
    return left.join(r, _same(left, r, keys), how)


def committed_feed(dbfiles: DataFrame, dbs: DataFrame) -> DataFrame:
    """(db_id, path, gen, file_id, size): changes not above the committed version of their database, the largest of its rows."""
    head = dbs.groupBy("db_id").agg(F.max("committed_gen").alias("head")).filter("head is not null")
    return dbfiles.select("db_id", "path", "gen", "file_id", "size").join(head, "db_id").filter("gen <= head").select("db_id", "path", "gen", "file_id", "size")


def committed_files(dbfiles: DataFrame, dbs: DataFrame, batches: int = BATCHES, base: DataFrame | None = None) -> DataFrame:
    """(db_id, path, gen, file_id, size): files each database has at its committed version.

    The committed version is the largest ``committed_gen`` of the database's
    rows; changes above it, and databases without one, don't count. A null
    file_id is a removal. ``base`` is an earlier result to start from.
    """
    return resolve(committed_feed(dbfiles, dbs), ["db_id", "path"], "gen", ["file_id", "size"], base=base, tombstone=F.col("file_id").isNull(), batches=batches)
