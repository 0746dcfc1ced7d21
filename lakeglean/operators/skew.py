"""Per-key results when a few keys hold most rows: two-stage salted aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy from this share of all rows on, so there are at most 500 heavy keys.
HEAVY_SHARE = 0.002
SALTS = 8
_SEED = 20_417
_WORD = 64
#: Counters of the frequent-items sketch; any key above a thousandth of all rows is among them for certain.
_COUNTERS = 10_000


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> tuple[int, list]:
    """(rows, keys with about ``share`` of them or more; at most 1/share keys), in one pass over the key column.

    A sketch of bounded size counts frequent keys, so nothing is shuffled but
    one sketch a task. Its counts may be off by a few rows in ten thousand,
    which moves work and never a result. Null is no key.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    most = max(1, min(int(1 / share), _COUNTERS))
    r = df.select(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(k, {most}, {_COUNTERS}) filter (where k is not null)").alias("top")).first()
    return r["n"], [x["item"] for x in r["top"] or [] if x["count"] >= r["n"] * share]


def salted(key: Column, heavy: list, salts: int = SALTS) -> Column:
    """A random salt below ``salts`` for heavy keys, else 0.

    The generator is seeded for each partition, and a scan returns its rows in
    the same order when a lost task is run again: a retry draws the same salts
    and can neither lose nor repeat rows. Rows whose order is not fixed, such
    as those behind a shuffle, must be written before they are salted.
    """
    return F.when(key.isin(heavy), F.floor(F.rand(_SEED) * salts).cast("int")).otherwise(F.lit(0)) if heavy else F.lit(0)


def partials(chunks: DataFrame, heavy: list, salts: int = SALTS) -> DataFrame:
    """Stage 1: (file_id, salt, word, n, mask, lo, hi) of the rows of each salted key, for each 64 numbers of it.

    ``mask`` has a bit for each number seen, so partials of different salts
    merge exactly however often a number repeats.
    """
    own = chunks.select("file_id", F.col("no").cast("long").alias("no"))
    word, bit = F.floor(F.col("no") / _WORD).cast("long"), F.expr(f"shiftleft(1L, cast(pmod(no, {_WORD}) as int))")
    rows = own.withColumns({"salt": salted(F.col("file_id"), heavy, salts), "word": word})
    return rows.groupBy("file_id", "salt", "word").agg(F.count(F.lit(1)).alias("n"), F.bit_or(bit).alias("mask"), F.min("no").alias("lo"), F.max("no").alias("hi"))


def sequence_profile(chunks: DataFrame, share: float = HEAVY_SHARE, salts: int = SALTS, heavy: list | None = None) -> DataFrame:
    """One row for each file_id of ``chunks`` (file_id, no).

    Columns: file_id, n_rows (repeated rows count), n_chunks (distinct no),
    min_no, max_no, n_gaps (numbers from 0 to max_no that are missing).

    Stage 1 groups by (file_id, salt, 64 numbers), where heavy file_ids get a
    random salt; stage 2 merges the salts of each file_id, first number by
    number, since masks of different salts overlap, then over the whole file.

    A null file_id forms one group of its own. A null no counts as a row but is
    no chunk; a negative no counts as a chunk and as min_no but fills no gap.
    Files with only null or negative numbers have n_gaps 0. No rows, no result.
    Extra columns are ignored.
    """
    heavy = heavy_keys(chunks, "file_id", share)[1] if heavy is None else heavy
    merged = partials(chunks, heavy, salts)
    if heavy:
        merged = merged.groupBy("file_id", "word").agg(F.sum("n").alias("n"), F.bit_or("mask").alias("mask"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    seen = F.coalesce(F.bit_count("mask"), F.lit(0))
    out = merged.groupBy("file_id").agg(
        F.sum("n").alias("n_rows"), F.sum(seen).cast("long").alias("n_chunks"),
        F.sum(F.when(F.col("word") >= 0, seen).otherwise(0)).alias("filled"),
        F.min("lo").alias("min_no"), F.max("hi").alias("max_no"))
    gaps = F.when(F.col("max_no") >= 0, F.col("max_no") + 1 - F.col("filled")).otherwise(F.lit(0))
    return out.select("file_id", "n_rows", "n_chunks", "min_no", "max_no", gaps.cast("long").alias("n_gaps"))


def dominant_keys(chunks: DataFrame, share: float) -> DataFrame:
    """file_id of the files that hold at least ``share`` of all rows, by their profile; null is no file."""
    total, heavy = heavy_keys(chunks, "file_id")
    profile = sequence_profile(chunks, heavy=heavy)
    return profile.filter(F.col("file_id").isNotNull() & (F.col("n_rows") >= total * share)).select("file_id")
