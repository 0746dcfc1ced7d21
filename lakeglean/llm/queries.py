"""Queries p6 to p8 on documents and eval_items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeglean.llm import leakage, packing, repetition


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_table(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose pieces the packing laid into more than one container."""
    return p6_containers(spark, d).filter("n_pieces > 1 and piece = 0").select("doc_id").distinct()


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the packing whatever the tokenizer: each byte once, in order, in containers that are not too full but nearly so."""
    p = p6_containers(spark, d)
    per = p.groupBy("doc_id").agg(F.sum("n_bytes").alias("bytes"), F.max(F.col("first_byte") + F.col("n_bytes")).alias("end"), F.count(F.lit(1)).alias("pieces"), F.max("n_pieces").alias("n"), F.sum("n_tokens").alias("tokens"))
    docs = per.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("bytes").cast("long").alias("n_bytes"), F.max(F.col("end") != F.col("bytes")).alias("torn"), F.max((F.col("pieces") != F.col("n")) | (F.col("n") != F.greatest(F.ceil(F.col("tokens") / packing.CAPACITY), F.lit(1)))).alias("badly_cut"))
    full = packing.fill(p).agg((F.min("slack") < 0).alias("too_full"), (F.sum("slack") > 0.02 * packing.CAPACITY * F.count(F.lit(1)) + packing.CAPACITY * 16).alias("wasteful"))
    return docs.join(full)


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Leaks whose own words qualify; those found only as templates don't."""
    return p7_leaks(spark, d).filter("kind <> 'reparameterised'").select("doc_id", "item_id")


def p7_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """For each test item that leaked: in how many documents, and by kind."""
    return p7_leaks(spark, d).groupBy("item_id", "kind").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_words").alias("longest"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.clean_lines(_table(spark, d, "documents"), rules=("repetition",)).select("doc_id", "n_words", "n_repeated", "repeated_share")


def p8_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """All line rules: what the cleaning removes, the text it leaves, and which documents it rejects."""
    return repetition.clean_lines(_table(spark, d, "documents"), keep=True)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the line pass, with all its rules, rejects for repetition."""
    return repetition.clean_lines(_table(spark, d, "documents")).filter("array_contains(rejected_for, 'repetition')").select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p6_found, p6_containers, p6_checks, p7_found, p7_leaks, p7_leaked_items, p8_found, p8_shares, p8_cleaning)}
_WORDS = r"""
with w as (select doc_id, regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\p{L}\p{N}]+') ws from documents),
g as (select doc_id, pos, array_to_string(ws[pos:pos + 4], ' ') gram from (select doc_id, ws, unnest(range(1, len(ws) - 3)) pos from w)),
again as (select doc_id, pos from g qualify row_number() over (partition by doc_id, gram order by pos) > 1),
cover as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(pos, pos + 5)) p from again) group by 1),
shares as (select w.doc_id, cast(len(ws) as bigint) n_words, coalesce(n, 0) n_repeated, case when len(ws) > 0 then coalesce(n, 0) / len(ws) else 0.0 end repeated_share from w left join cover c on c.doc_id = w.doc_id)
"""
SQL = {
    "p6_found": r"select doc_id from documents where len(regexp_extract_all(text, '[\p{L}\p{N}]+')) > 2048",
    "p6_checks": "select count(*) n_docs, cast(sum(coalesce(strlen(text), 0)) as bigint) n_bytes, false torn, false badly_cut, false too_full, false wasteful from documents",
    "p8_shares": _WORDS + "select doc_id, n_words, n_repeated, cast(repeated_share as double) repeated_share from shares",
    "p8_found": _WORDS + "select doc_id from shares where repeated_share >= 0.3",
}
