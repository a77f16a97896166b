"""Loci: clusters of overlapping reads, their numbering, depth and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators import intervals
from strandloom.session import discard, materialize


def number_loci(loci: DataFrame) -> DataFrame:
    """Adds ``locus``, the place in the order of (chrom, start, end), from 1.

    Loci are ranked within the tile they begin in; the counts of the tiles before give
    the offset, so no task ranks a whole chromosome.
    """
    rows = loci.withColumn("_tile", F.expr(f"start div {intervals.TILE}"))
    sizes = rows.groupBy("chrom", "_tile").agg(F.count("*").alias("_n"))
    chroms = sizes.groupBy("chrom").agg(F.sum("_n").alias("_all"))
    # A row per chromosome, then a row per tile of a chromosome: both are bounded by the genome, not by the reads.
    ahead = chroms.select("chrom", (F.sum("_all").over(Window.orderBy("chrom")) - F.col("_all")).alias("_ahead"))
    before = sizes.select("chrom", "_tile", (F.sum("_n").over(Window.partitionBy("chrom").orderBy("_tile")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("chrom", "_tile").orderBy("start", "end"))
    numbered = rows.withColumn("_rank", rank).join(before, ["chrom", "_tile"]).join(ahead, "chrom")
    return numbered.withColumn("locus", F.col("_ahead") + F.col("_before") + F.col("_rank")).drop("_tile", "_rank", "_before", "_ahead")


def locus_reads(reads: DataFrame, tile: int = intervals.TILE) -> DataFrame:
    """Reads (read_name, chrom, start, end) with the locus they lie in: adds locus, locus_start, locus_end."""
    inside = intervals.clusters(reads, ["chrom"], "locus", tile)
    loci = inside.select("chrom", F.col("locus_start").alias("start"), F.col("locus_end").alias("end")).distinct()
    numbered = number_loci(loci).withColumnsRenamed({"start": "locus_start", "end": "locus_end"})
    return inside.join(numbered, ["chrom", "locus_start", "locus_end"])


def _depth_sums(reads: DataFrame, row_id: str, min_depth: float, tile: int) -> DataFrame:
    """(row_id, area, deep, size): depth summed over a read's span, its bases at ``min_depth`` or more and all of them.

    Depth is integrated along each tile once; a read then needs the integral at its two
    ends only, looked up in the tile, however many depth changes lie between. Reads over
    several tiles add up their parts.
    """
    rows = reads.select(row_id, "chrom", "start", "end").dropna().filter("start < end")
    parts = intervals.cut_at_tiles(rows, tile)
    steps = parts.groupBy("chrom", "_tile", "start", "end").agg(F.count("*").alias("n"))
    ends = F.array(F.struct(F.col("start").alias("pos"), F.col("n").alias("d")), F.struct(F.col("end").alias("pos"), (-F.col("n")).alias("d")))
    bounds = steps.select("chrom", "_tile", F.explode(ends).alias("b")).groupBy("chrom", "_tile", F.col("b.pos").alias("pos")).agg(F.sum("b.d").alias("d"))
    w = Window.partitionBy("chrom", "_tile").orderBy("pos")
    level = bounds.withColumn("depth", F.sum("d").over(w)).withColumn("width", F.coalesce(F.lead("pos").over(w) - F.col("pos"), F.lit(0)))
    deep = F.when(F.col("depth") >= min_depth, F.col("width")).otherwise(0)
    integral = level.select("chrom", "_tile", "pos", (F.sum(F.col("depth") * F.col("width")).over(w) - F.col("depth") * F.col("width")).alias("area"), (F.sum(deep).over(w) - deep).alias("deep"))
    at = lambda side: integral.withColumnsRenamed({"pos": side, "area": f"{side}_area", "deep": f"{side}_deep"})
    both = parts.join(at("start"), ["chrom", "_tile", "start"]).join(at("end"), ["chrom", "_tile", "end"])
    total = lambda to, since: F.sum(F.col(to) - F.col(since))
    return both.groupBy(row_id).agg(total("end_area", "start_area").alias("area"), total("end_deep", "start_deep").alias("deep"), total("end", "start").alias("size"))


def depth_statistics(reads: DataFrame, row_id: str, min_depth: float, tile: int = intervals.TILE) -> DataFrame:
    """(row_id, average_depth, covered_share): mean depth over a read's span and the share at ``min_depth`` or more."""
    share = lambda part: F.round(F.col(part) / F.col("size"), 6)
    return _depth_sums(reads, row_id, min_depth, tile).select(row_id, share("area").alias("average_depth"), share("deep").alias("covered_share"))


def deep_reads(reads: DataFrame, row_id: str, min_exons: int = 2, min_depth: float = 1.5, min_share: float = 0.8, tile: int = intervals.TILE) -> DataFrame:
    """Reads (with exon_count) that loci are made of: of ``min_exons`` or more and, among these, deep enough.

    Mean depth is at least ``min_depth``; if that is over 1, at least ``min_share`` of the span has it too.
    """
    several = reads.filter(F.col("exon_count") >= min_exons)
    share = lambda part: F.col(part) / F.col("size")
    deep = share("area") >= min_depth
    if min_depth > 1:
        deep &= share("deep") >= min_share
    return several.join(_depth_sums(several, row_id, min_depth, tile).filter(deep).select(row_id), row_id, "left_semi")


def exon_components(read_exons: DataFrame, row_id: str, tile: int = intervals.TILE) -> DataFrame:
    """(row_id, component): reads that are linked by overlapping exons, directly or through others.

    Overlapping exons are merged to islands first, so that a read is linked to few islands
    and not to the reads that share them; the smallest island reached is then passed on
    between reads and islands until nothing changes.
    """
    inside = intervals.clusters(read_exons.select(row_id, "chrom", "start", "end"), ["chrom"], "island", tile)
    islands = number_loci(inside.select("chrom", F.col("island_start").alias("start"), F.col("island_end").alias("end")).distinct()).withColumnsRenamed({"start": "island_start", "end": "island_end", "locus": "island"})
    links = materialize(inside.join(islands, ["chrom", "island_start", "island_end"]).select(row_id, "island").distinct(), "links")
    labels = materialize(links.groupBy(row_id).agg(F.min("island").alias("component")), "labels")
    while True:
        by_island = links.join(labels, row_id).groupBy("island").agg(F.min("component").alias("least"))
        # The island's own label's label: halves the way to the smallest each round.
        further = by_island.join(by_island.select(F.col("island").alias("least"), F.col("least").alias("next")), "least", "left").select("island", F.least("least", F.coalesce("next", "least")).alias("least"))
        new = materialize(links.join(further, "island").groupBy(row_id).agg(F.min("least").alias("component")), "labels")
        changed = new.alias("a").join(labels.alias("b"), row_id).filter("a.component <> b.component")
        done = changed.isEmpty()
        discard(labels)
        labels = new
        if done:
            return labels
