"""The given tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.session import table

ALIGNMENT = ["aln_id", "qname", "flag", "qlen", "q_start", "q_end", "chrom", "strand", "t_start", "t_end", "aligned_bases"]


def alignments(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Alignment entries, each once however often it arrived.

    Only the ``columns`` named (all, if none) are read and compared, and aln_id.
    """
    return table(spark, sf_dir, "alndata").select("aln_id", *[c for c in columns or ALIGNMENT if c != "aln_id"]).distinct()


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference spans of the aligned entries: (aln_id, qname, chrom, start, end)."""
    return alignments(spark, sf_dir, "qname", "chrom", "t_start", "t_end").select("aln_id", "qname", "chrom", F.col("t_start").alias("start"), F.col("t_end").alias("end")).filter("chrom is not null and start < end")


def _list(column: str) -> Column:
    return F.expr(f"transform(split(rtrim(',', {column}), ','), x -> cast(x as bigint))")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gpd with its exons as an array of (start, end)."""
    t = table(spark, sf_dir, "gpd")
    zipped = F.arrays_zip(_list("exon_starts").alias("start"), _list("exon_ends").alias("end"))
    return t.withColumn("exons", zipped)


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, tx, chrom, strand, exon_count, exon_no from 1, start, end)."""
    x = transcripts(spark, sf_dir).select("gene", "tx", "chrom", "strand", "exon_count", F.posexplode("exons").alias("i", "x"))
    return x.select("gene", "tx", "chrom", "strand", "exon_count", (F.col("i") + 1).alias("exon_no"), "x.start", "x.end")


def chroms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chrlens")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """annotbest with normalised gene and tx, each row once however often it arrived."""
    a = table(spark, sf_dir, "annotbest").drop("load_ts")
    clean = {c: F.upper(F.btrim(F.col(c), F.lit(" \t"))) for c in ("gene", "tx")}
    return a.withColumns(clean).distinct()


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length table, each read once however often it arrived."""
    return table(spark, sf_dir, "lengths").drop("load_ts").distinct()


def read_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the length table's reads, aligned or not, each once."""
    return table(spark, sf_dir, "lengths").select(F.col("qname").alias("read_name")).distinct()
