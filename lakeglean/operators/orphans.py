"""References to records that do not exist: Bloom filter first, exact join for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeglean.session import materialise

#: Upper bound of the broadcast filter: 8 MB, the largest that Spark's own runtime filters use.
MAX_BITS = 67_108_864
MAX_ITEMS = 4_000_000


def bloom(parents: DataFrame, key: str, expected: int) -> DataFrame:
    """One row with the Bloom filter of ``key``, at 10 bits a key and never above MAX_BITS."""
    from pyspark.sql.classic.column import Column as Classic

    jvm = parents.sparkSession._jvm
    u = jvm.org.apache.spark.sql.classic.ExpressionUtils
    items = max(1, min(expected, MAX_ITEMS))
    bits = max(1024, min(expected * 10, MAX_BITS))
    long = lambda n: u.expression(F.lit(n).cast("long")._jc)
    agg = jvm.org.apache.spark.sql.catalyst.expressions.aggregate.BloomFilterAggregate(u.expression(F.col(key)._jc), long(items), long(bits))
    return parents.agg(Classic(u.column(agg.toAggregateExpression())).alias("filter"))


def might_contain(filter_row: DataFrame, key: Column) -> Column:
    """True unless the filter proves that ``key`` is not among its keys."""
    from pyspark.sql.classic.column import Column as Classic

    jvm = filter_row.sparkSession._jvm
    u = jvm.org.apache.spark.sql.classic.ExpressionUtils
    test = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(u.expression(filter_row.scalar()._jc), u.expression(key._jc))
    return F.coalesce(Classic(u.column(test)), F.lit(False))  # a filter of no keys is null


def orphans(references: DataFrame, parents: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows of ``references`` whose ``key`` is not in ``parents``; a null key refers to nothing.

    Keys the broadcast filter rejects are orphans for certain and take no part
    in any join. Only the rest, the true references and about 1% of orphans,
    are verified by an exact anti join. With more than about seven million
    parents the filter, whose size is bounded, rejects less and the join
    verifies more; the result is the same. Repeated references stay; parents
    may repeat and hold nulls; no parents make every reference an orphan.
    """
    refs = references.filter(F.col(key).isNotNull())
    keys = parents.select(F.col(key).cast("long").alias(key)).filter(F.col(key).isNotNull())
    flag = "__maybe"
    n = keys.count()
    # written once: both branches read it, and it is cheap after pre-aggregation
    tested = materialise(refs.withColumn(flag, might_contain(bloom(keys, key, n), F.col(key).cast("long"))), "references")
    certain = tested.filter(~F.col(flag)).drop(flag)
    verified = tested.filter(F.col(flag)).drop(flag).join(keys.distinct(), key, "left_anti")
    return certain.unionByName(verified)


def store_references(chunks: DataFrame, dbfiles: DataFrame, dbchunks: DataFrame, dbgens: DataFrame, months: bool = True) -> DataFrame:
    """(src, month, file_id, n_refs) of the four tables that refer to files.

    month is that of the generation's newest committed_at for dbfiles and
    dbgens (null if unknown), null for the others. Counted before any shuffle
    of rows, so a file_id with a third of all rows is one row from there on.
    Without ``months`` nothing is looked up and month is always null.
    """
    month = F.trunc("newest", "month").cast("date")
    when = dbgens.groupBy("db_id", "gen").agg(F.max("committed_at").alias("newest"))
    none = F.lit(None).cast("date")

    def counted(df: DataFrame, src: str, n=F.count(F.lit(1))) -> DataFrame:
        return df.groupBy("month", "file_id").agg(n.alias("n_refs")).select(F.lit(src).alias("src"), "month", "file_id", "n_refs")

    first = F.expr("transform(filter(changes, (x, i) -> i % 3 = 0), x -> x)")
    keys = ["db_id", "gen", "file_id"] if months else ["file_id"]
    per_gen = dbfiles.filter("file_id is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    triples = dbgens.select("db_id", "gen", F.explode(first).alias("file_id")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    dated = lambda df: df.select(none.alias("month"), "file_id", "n") if not months else df.join(when, ["db_id", "gen"], "left").select(month.alias("month"), "file_id", "n")
    return (counted(chunks.select(none.alias("month"), "file_id"), "chunks")
            .unionByName(counted(dbchunks.select(none.alias("month"), "file_id"), "dbchunks"))
            .unionByName(counted(dated(per_gen), "dbfiles", F.sum("n")))
            .unionByName(counted(dated(triples), "dbgens", F.sum("n"))))


def store_orphans(chunks: DataFrame, files: DataFrame, garbage: DataFrame, dbfiles: DataFrame, dbchunks: DataFrame,
                  dbgens: DataFrame, dbfileids: DataFrame, months: bool = True) -> DataFrame:
    """(src, month, file_id, n_refs) of references that neither parent table holds."""
    refs = store_references(chunks, dbfiles, dbchunks, dbgens, months)
    of_volume = orphans(refs.filter("src = 'chunks'"), files.select("file_id").unionByName(garbage.select("file_id")))
    of_db = orphans(refs.filter("src <> 'chunks'"), dbfileids)
    return of_volume.unionByName(of_db)
