"""Per-read resolution of several alignments, and feature assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _secondary() -> Column:
    """1 unless the entry is primary; a null flag isn't."""
    return F.when((F.col("flag").bitwiseAND(2304)) == 0, 0).otherwise(1)


def best_alignment(entries: DataFrame) -> DataFrame:
    """The first primary entry of each read in input order, else its first entry.

    Entries without aligned bases and without a read take no part. The rows of a hot
    read are ranked in their own tasks first (the rank limit is pushed before the shuffle).
    """
    w = Window.partitionBy("qname").orderBy(_secondary(), "aln_id")
    aligned = entries.filter("qname is not null and aligned_bases > 0")
    return aligned.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def assign_feature(overlaps: DataFrame, sizes: DataFrame) -> DataFrame:
    """(qname, length, exon_bases, intron_bases, intergenic_bases, feature).

    exon if at least half of the read lies in exons, else intron, else intergenic by the
    same rule, else the largest share, exon before intron before intergenic. Reads
    without any overlap drop out.
    """
    kinds = ["exon", "intron", "intergenic"]
    wide = overlaps.groupBy("qname").agg(*[F.sum(F.when(F.col("kind") == k, F.col("overlap")).otherwise(0)).alias(f"{k}_bases") for k in kinds])
    bases = [F.col(f"{k}_bases") for k in kinds]
    feature = F.when(2 * bases[0] >= F.col("length"), "exon").when(2 * bases[1] >= F.col("length"), "intron").when(2 * bases[2] >= F.col("length"), "intergenic")
    feature = feature.when((bases[0] >= bases[1]) & (bases[0] >= bases[2]), "exon").when(bases[1] >= bases[2], "intron").otherwise("intergenic")
    return wide.join(sizes, "qname").select("qname", "length", *bases, feature.alias("feature"))
