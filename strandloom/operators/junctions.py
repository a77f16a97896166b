"""Distances of read junctions from known ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.intervals import nearest


def junction_sides(exons: DataFrame, row_id: str) -> DataFrame:
    """Inner exon bounds of rows with several exons: (row_id, chrom, side, pos); side 'start' is where an exon begins."""
    n = F.count("*").over(Window.partitionBy(row_id))
    rows = exons.withColumn("_n", n).filter("_n > 1")
    w = Window.partitionBy(row_id)
    rows = rows.withColumn("_first", F.min("start").over(w)).withColumn("_last", F.max("end").over(w))
    sides = F.array(F.struct(F.lit("start").alias("side"), F.col("start").alias("pos"), (F.col("start") > F.col("_first")).alias("inner")), F.struct(F.lit("end").alias("side"), F.col("end").alias("pos"), (F.col("end") < F.col("_last")).alias("inner")))
    return rows.select(row_id, "chrom", F.explode(sides).alias("s")).filter("s.inner").select(row_id, "chrom", "s.side", "s.pos")


def distances(read_exons: DataFrame, reference_exons: DataFrame, window: int = 30) -> DataFrame:
    """(distance, n) of read junction sides to the nearest reference side within ``window``.

    Positive where the read's exon is longer. Equal positions are looked up once and
    weighted by the number of reads.
    """
    points = junction_sides(read_exons, "read_name").groupBy("chrom", "side", "pos").agg(F.count("*").alias("n"))
    sites = junction_sides(reference_exons, "tx").select("chrom", "side", F.col("pos").alias("site")).distinct()
    near = nearest(points, sites, ["chrom", "side"], window)
    longer = F.when(F.col("side") == "start", F.col("site") - F.col("pos")).otherwise(F.col("pos") - F.col("site"))
    return near.join(points, ["chrom", "side", "pos"]).groupBy(longer.alias("distance")).agg(F.sum("n").alias("n"))


def variance_rollup(found: DataFrame) -> DataFrame:
    """(truncated, perfect, elongated): sides with negative, zero and positive distance."""
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    d = F.col("distance")
    return found.agg(part(d < 0).alias("truncated"), part(d == 0).alias("perfect"), part(d > 0).alias("elongated"))


def _outermost(spans: DataFrame, keys: list[str], side: str, end_support: int) -> DataFrame:
    """(keys, side): the outermost ``side`` that at least ``end_support`` reads of the group reach, the innermost where the group has fewer.

    Equal ends are counted first, so that the running count goes over distinct ends.
    """
    order, inner = (F.col(side), F.max) if side == "start" else (F.col(side).desc(), F.min)
    counts = spans.groupBy(*keys, side).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(order))
    reached = counts.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_n"))
    return reached.filter(F.col("_before") < end_support).groupBy(*keys).agg(inner(side).alias(side))


ISOFORM = ["chrom", "strand", "chain"]


def read_chains(read_exons: DataFrame, tolerance: int = 10) -> DataFrame:
    """(read_name, chrom, strand, chain, start, end) of reads with several exons.

    A side is snapped to the side with most reads within ``tolerance``, the smaller
    position on ties; the chain has a read's sides in order.
    """
    sides = junction_sides(read_exons, "read_name")
    counts = sides.groupBy("chrom", "side", "pos").agg(F.count("*").alias("n"))
    width = tolerance + 1
    a = counts.select("chrom", "side", "pos", F.explode(F.expr(f"sequence(pos div {width} - 1, pos div {width} + 1)")).alias("band"))
    b = counts.select("chrom", "side", F.col("pos").alias("to"), F.col("n").alias("m"), F.expr(f"pos div {width}").alias("band"))
    near = a.join(b, ["chrom", "side", "band"]).filter(F.abs(F.col("pos") - F.col("to")) <= tolerance)
    snapped = near.groupBy("chrom", "side", "pos").agg(F.max_by("to", F.struct("m", -F.col("to"))).alias("to"))
    chains = sides.join(snapped, ["chrom", "side", "pos"]).groupBy("read_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("to", "side"))), lambda x: x["to"].cast("string")), ",").alias("chain"))
    spans = read_exons.groupBy("read_name", "chrom", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.join(chains, "read_name").select("read_name", *ISOFORM, "start", "end")


def isoforms(rows: DataFrame, support: int = 2, end_support: int = 2) -> DataFrame:
    """Isoforms of the rows of :func:`read_chains`: (chrom, strand, chain, start, end, n_reads).

    Chains of fewer than ``support`` reads drop out. An isoform begins and ends at the
    outermost places that ``end_support`` of its reads reach.
    """
    kept = rows.groupBy(*ISOFORM).agg(F.count("*").alias("n_reads")).filter(F.col("n_reads") >= support)
    found = kept.join(_outermost(rows, ISOFORM, "start", end_support), ISOFORM).join(_outermost(rows, ISOFORM, "end", end_support), ISOFORM)
    return found.select(*ISOFORM, "start", "end", "n_reads")


def nonredundant(read_exons: DataFrame, tolerance: int = 10, support: int = 2, end_support: int = 2) -> DataFrame:
    """Isoforms of reads with one chain of junctions, sides snapped first: :func:`isoforms` of :func:`read_chains`."""
    return isoforms(read_chains(read_exons, tolerance), support, end_support)


def with_genes(found: DataFrame, rows: DataFrame, genes: DataFrame) -> DataFrame:
    """Adds ``gene`` to isoforms: the gene of most of their reads, the first by name on ties; ``genes`` is (read_name, gene)."""
    counts = rows.join(genes.filter("gene is not null"), "read_name").groupBy(*ISOFORM, "gene").agg(F.count("*").alias("_n"))
    best = counts.groupBy(*ISOFORM).agg(F.min_by("gene", F.struct(-F.col("_n"), "gene")).alias("gene"))
    return found.join(best, ISOFORM, "left")
