"""Depth histograms and coverage tables over depth segments (chrom, start, end, depth)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators import intervals


def depth_histogram(segments: DataFrame) -> DataFrame:
    """Bases at each depth of each chromosome: (chrom, depth, bases). All tables below derive from it."""
    return segments.groupBy("chrom", "depth").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


def per_chromosome(histogram: DataFrame, chroms: DataFrame) -> DataFrame:
    """(chrom, depth, bases, covered, chrom_length)."""
    covered = histogram.withColumn("covered", F.sum("bases").over(Window.partitionBy("chrom")))
    return covered.join(chroms, "chrom").select("chrom", "depth", "bases", "covered", "chrom_length")


def total(histogram: DataFrame, chroms: DataFrame) -> DataFrame:
    """(depth, bases, covered, genome_length)."""
    sizes = chroms.agg(F.sum("chrom_length").alias("n"))
    known = histogram.join(chroms.select("chrom"), "chrom", "left_semi")
    # This window, as those below, runs over distinct depths, not over the data.
    return known.groupBy("depth").agg(F.sum("bases").alias("bases")).select("depth", "bases", F.sum("bases").over(Window.partitionBy()).alias("covered"), sizes.scalar().alias("genome_length"))


def cumulative_line(totals: DataFrame) -> DataFrame:
    """Two points per depth of the cumulative base count, which begins after the uncovered bases: (depth, position, genome_length).

    The window runs over distinct depths, not over the data.
    """
    upto = F.sum("bases").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))
    end = F.col("genome_length") - F.col("covered") + upto
    ends = totals.select("depth", "bases", "genome_length", end.alias("_end"))
    return ends.select("depth", F.explode(F.array(F.col("_end") - F.col("bases") + 1, F.col("_end"))).alias("position"), "genome_length")


def aligned_fraction(histogram: DataFrame, chroms: DataFrame, least: float = 1e-5) -> DataFrame:
    """(chrom, covered, chrom_length, fraction, log2_fraction), with a row 'all' for the genome."""
    covered = chroms.join(histogram.groupBy("chrom").agg(F.sum("bases").alias("covered")), "chrom", "left").select("chrom", F.coalesce("covered", F.lit(0)).alias("covered"), "chrom_length")
    rows = covered.unionByName(covered.agg(F.lit("all").alias("chrom"), F.sum("covered").alias("covered"), F.sum("chrom_length").alias("chrom_length")))
    share = F.col("covered") / F.col("chrom_length")
    return rows.select("*", F.round(share, 6).alias("fraction"), F.round(F.log2(F.greatest(share, F.lit(least))), 6).alias("log2_fraction"))


def depth_quartiles(histogram: DataFrame) -> DataFrame:
    """Quartiles of depth over covered bases, per chromosome, by weighted percentiles: (chrom, q1, median, q3)."""
    q = histogram.groupBy("chrom").agg(F.percentile("depth", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("bases")).alias("q"))
    return q.select("chrom", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def strata(totals: DataFrame, least: int = 100_000) -> DataFrame:
    """Stratum of each depth: (depth, stratum). From the deepest depth on, a stratum is full at ``least`` bases."""
    above = F.sum("bases").over(Window.orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("depth", F.floor(F.coalesce(above, F.lit(0)) / least).alias("stratum"))


def features(exons: DataFrame, transcripts: DataFrame, chroms: DataFrame) -> DataFrame:
    """Disjoint exon, intron and intergenic ranges: (chrom, start, end, kind). Strand is ignored."""
    genome = chroms.select("chrom", F.lit(0).cast("long").alias("start"), F.col("chrom_length").alias("end"))
    return intervals.layers({"exon": exons, "intron": transcripts, "intergenic": genome}, ["chrom"])


def depth_in_features(segments: DataFrame, ranges: DataFrame, tile: int = 1 << 14) -> DataFrame:
    """Pieces of depth segments within feature ranges: (chrom, start, end, depth, kind)."""
    right = ranges.withColumnsRenamed({"start": "r_start", "end": "r_end"})
    pairs = intervals.overlap_join(segments, right, ["chrom"], tile)
    return pairs.select("chrom", F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"), "depth", "kind")


def feature_depth(pieces: DataFrame, sizes: DataFrame) -> DataFrame:
    """Cumulative share of each kind of feature by depth, uncovered bases first: (kind, depth, bases, upto, size, share)."""
    by_depth = pieces.groupBy("kind", "depth").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
    covered = F.sum("bases").over(Window.partitionBy("kind"))
    upto = F.sum("bases").over(Window.partitionBy("kind").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))
    rows = by_depth.join(sizes, "kind").withColumn("upto", F.col("size") - covered + upto)
    return rows.select("kind", "depth", "bases", "upto", "size", F.round(F.col("upto") / F.col("size"), 6).alias("share"))


def weighted_depth(exons: DataFrame, counts: DataFrame, tile: int = intervals.TILE) -> DataFrame:
    """Depth of transcripts' exons, each counted as often as ``counts`` (tx, n) says, without copies of rows."""
    return intervals.depth(exons.join(counts, "tx"), ["chrom"], F.col("n"), tile)


def overlap_of(left: DataFrame, row_id: str, right: DataFrame, kind: str, tile: int, keys: list[str] | None = None) -> DataFrame:
    """Overlapping bases of each row with each kind of (disjoint) right interval: (row_id, kind, overlap)."""
    pairs = intervals.overlap_join(left, right, keys or ["chrom"], tile)
    return pairs.groupBy(row_id, kind).agg(F.sum(intervals.overlap_size()).alias("overlap"))


