"""Queries of this subpackage, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import leaks, percentiles, sampling, splitting, tokens, topn
from strandloom.session import materialize, table

SAMPLE_READS = 1000


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "alndata").filter("aligned_bases > 0").withColumn("first_line", F.expr("coalesce(cast((flag & 2304) = 0 as int), 0)"))
    return topn.top_n(entries, "qname", "aln_id", ["aligned_bases", "first_line"], 3).select("qname", "aln_id")


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.uniform_sample(table(spark, sf_dir, "alndata"), "qname", "batch_no", SAMPLE_READS, seed=42)


def p2_sample_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sample is merged from: each batch's population of reads and the size of its reservoir."""
    held = sampling.piece_reservoirs(table(spark, sf_dir, "alndata"), "qname", "batch_no", SAMPLE_READS, seed=42)
    return held.groupBy("piece").agg(F.first("population").alias("population"), F.countDistinct("item").alias("held"))


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda e: F.date_format(e, "yyyy-MM-dd")
    unions = {"day": day(F.col("run_day")), "week": day(F.date_trunc("week", "run_day")), "all": F.lit("all")}
    identity = ["qname", "read_type", "aligned_bases", "total_bases", "qlen", "run_no", "run_day"]
    return percentiles.day_and_union_percentiles(table(spark, sf_dir, "lengths"), identity, "run_day", "read_type", ["qlen", "aligned_bases"], [50, 90, 99], unions)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, decoded from their ids; null texts come back empty.

    The ids are written in between, so that a task doesn't put documents together and decode them at once.
    """
    return tokens.decode_corpus(materialize(p6_ids(spark, sf_dir), "ids"), "doc_id", "ids")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact leaks; the operator makes no re-parameterised windows for them."""
    return leaks.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text", kinds=("exact",)).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_sample, p2_sample_pieces, p5_percentiles, p6_ids, p6_decoded, p7_found, p7_leaks, p8_found, p8_pieces)}


_P5 = """
WITH r AS (SELECT DISTINCT qname, read_type, aligned_bases, total_bases, qlen, run_no, run_day FROM lengths),
 m AS (SELECT run_day, read_type, 'qlen' AS metric, qlen AS v FROM r UNION ALL SELECT run_day, read_type, 'aligned_bases', aligned_bases FROM r),
 u AS (SELECT 'day' AS scope, strftime(run_day, '%Y-%m-%d') AS period, read_type, metric, v FROM m
  UNION ALL SELECT 'week', strftime(date_trunc('week', run_day), '%Y-%m-%d'), read_type, metric, v FROM m
  UNION ALL SELECT 'all', 'all', read_type, metric, v FROM m),
 o AS (SELECT *, row_number() OVER (PARTITION BY scope, period, read_type, metric ORDER BY v) AS i, count(*) OVER (PARTITION BY scope, period, read_type, metric) AS n FROM u WHERE v >= 0)
SELECT scope, period, read_type, metric, n, max(v) FILTER (i = (n * 50 + 99) // 100) AS p50, max(v) FILTER (i = (n * 90 + 99) // 100) AS p90, max(v) FILTER (i = (n * 99 + 99) // 100) AS p99
FROM o GROUP BY scope, period, read_type, metric, n
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
WITH e AS (SELECT DISTINCT qname, aln_id, aligned_bases, flag FROM alndata WHERE qname IS NOT NULL AND aligned_bases > 0)
SELECT qname, aln_id FROM e
QUALIFY row_number() OVER (PARTITION BY qname ORDER BY aligned_bases DESC, CASE WHEN (flag & 2304) = 0 THEN 0 ELSE 1 END, aln_id) <= 3
""",
        "p2_sample_pieces": f"""
WITH f AS (SELECT qname, min(coalesce(batch_no, -1)) AS piece FROM alndata WHERE qname IS NOT NULL GROUP BY qname)
SELECT piece, count(*) AS population, least(count(*), {SAMPLE_READS}) AS held FROM f GROUP BY piece
""",
        "p5_percentiles": _P5,
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
