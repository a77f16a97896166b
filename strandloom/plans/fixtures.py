"""Reads of several exons and base pairs derived from orders and gpd, with the same views as SQL.

They stand in for alignments with several exons and for base sequences, which the given
tables don't hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.plans import inputs
from strandloom.session import table


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons of the reference transcripts: (tx, gene, chrom, strand, exon_no, start, end)."""
    x = inputs.transcripts(spark, sf_dir).select("tx", "gene", "chrom", "strand", F.posexplode("exons").alias("exon_no", "x"))
    return x.select("tx", "gene", "chrom", "strand", "exon_no", "x.start", "x.end")


def read_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons of one read per order, neighbouring exons of a transcript with ends a few bases off: (read_name, chrom, strand, exon_no, start, end).

    Some reads leave an exon out, some are shifted, some lie on a chromosome without transcripts.
    """
    # The reference has a bounded number of transcripts, so one task may number them.
    t = inputs.transcripts(spark, sf_dir).select("chrom", "strand", "exons", (F.row_number().over(Window.orderBy("tx")) - 1).alias("i"))
    n = t.agg(F.count("*").alias("n")).scalar()
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % n).alias("i")).join(t, "i")
    o = o.withColumn("a", F.least(F.col("o_orderkey") % 3, F.size("exons") - 1)).select("o_orderkey", "chrom", "strand", "a", F.posexplode("exons").alias("exon_no", "x"))
    kept = o.filter("exon_no >= a and exon_no < a + 1 + o_orderkey % 6 and not (o_orderkey % 11 = 0 and exon_no = a + 1)")
    shift = F.when(F.col("o_orderkey") % 17 == 0, 25).otherwise(0)
    return kept.select(
        F.concat(F.lit("r"), "o_orderkey").alias("read_name"), F.when(F.col("o_orderkey") % 23 == 0, "chrU").otherwise(F.col("chrom")).alias("chrom"), "strand", "exon_no",
        (F.col("x.start") + F.col("o_orderkey") % 5 + shift).alias("start"), (F.col("x.end") - F.col("o_orderkey") % 3 + shift).alias("end"),
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_exons(spark, sf_dir).groupBy("read_name", "chrom", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("exon_count"), F.sum(F.col("end") - F.col("start")).alias("read_length"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty aligned base pairs per order, as two strings: (aln_id, target, query)."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = [np.frombuffer(x, np.uint8) for x in (b"ACGT", b"CGTA")]
        for b in batches:
            ids, pos = b.column(0).to_numpy()[:, None], np.arange(30)
            m = ids * 7 + pos * pos * 3 + pos * (ids % 5) * 11
            target = np.where(m % 29 == 0, ord("-"), letters[0][m % 4])
            query = np.where((m % 29 != 0) & (m % 31 == 0), ord("-"), np.where(m % 17 == 0, letters[1][m % 4], letters[0][m % 4]))
            text = lambda x: pa.array(np.ascontiguousarray(x.astype(np.uint8)).view("S30").ravel()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), text(target), text(query)], ["aln_id", "target", "query"])

    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("aln_id")).mapInArrow(spell, "aln_id long, target string, query string")


_LISTS = ", ".join(f"unnest(list_transform(string_split(rtrim({c}, ','), ','), lambda x: CAST(x AS BIGINT))) AS {n}" for c, n in (("exon_starts", "s"), ("exon_ends", "e")))
EXONS = f"v_exons AS (SELECT tx, gene, chrom, strand, unnest(range(exon_count)) AS exon_no, {_LISTS} FROM gpd)"
READ_EXONS = f"""v_tx AS (SELECT exon_count, row_number() OVER (ORDER BY tx) - 1 AS i, count(*) OVER () AS n, chrom, strand, exon_starts, exon_ends FROM gpd), v_all AS (SELECT i, chrom, strand, unnest(range(exon_count)) AS exon_no, {_LISTS} FROM v_tx),
v_read_exons AS (SELECT 'r' || o AS read_name, CASE WHEN o % 23 = 0 THEN 'chrU' ELSE chrom END AS chrom, strand, exon_no, s + o % 5 + CASE WHEN o % 17 = 0 THEN 25 ELSE 0 END AS s, e - o % 3 + CASE WHEN o % 17 = 0 THEN 25 ELSE 0 END AS e
 FROM (SELECT o_orderkey AS o, i, least(o_orderkey % 3, exon_count - 1) AS a FROM orders JOIN v_tx ON i = o_orderkey * 7919 % n) JOIN v_all USING (i) WHERE exon_no >= a AND exon_no < a + 1 + o % 6 AND NOT (o % 11 = 0 AND exon_no = a + 1))"""
READS = """v_reads AS (SELECT read_name, chrom, strand, MIN(s) AS s, MAX(e) AS e, COUNT(*) AS exon_count, CAST(SUM(e - s) AS BIGINT) AS read_length FROM v_read_exons GROUP BY read_name, chrom, strand)"""
PAIRS = """v_pairs AS (SELECT aln_id, pos, CASE WHEN m % 29 = 0 THEN '-' ELSE SUBSTR('ACGT', CAST(1 + m % 4 AS INT), 1) END AS target,
 CASE WHEN m % 29 <> 0 AND m % 31 = 0 THEN '-' WHEN m % 17 = 0 THEN SUBSTR('CGTA', CAST(1 + m % 4 AS INT), 1) ELSE SUBSTR('ACGT', CAST(1 + m % 4 AS INT), 1) END AS query
 FROM (SELECT aln_id, pos, (aln_id * 7 + pos * pos * 3 + pos * (aln_id % 5) * 11) AS m FROM (SELECT o_orderkey AS aln_id, pos FROM orders CROSS JOIN range(30) AS a(pos))))"""
