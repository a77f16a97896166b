"""Isoforms and loci that the reference annotation doesn't have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import annotate, junctions, loci
from strandloom.session import materialize


def isoform_exons(isoforms: DataFrame) -> DataFrame:
    """Exon rows (gene, tx, chrom, strand, exon_no, start, end) of isoforms with genes; tx is made of place and chain."""
    bounds = F.expr("concat(array(start), transform(split(chain, ','), x -> cast(x as bigint)), array(end))")
    pairs = F.expr("transform(sequence(0, size(p) div 2 - 1), i -> struct(p[2 * i] as start, p[2 * i + 1] as end))")
    name = F.concat_ws(":", "chrom", "strand", "chain")
    rows = isoforms.withColumn("p", bounds).select("gene", name.alias("tx"), "chrom", "strand", F.posexplode(pairs).alias("exon_no", "x"))
    return rows.select("gene", "tx", "chrom", "strand", "exon_no", "x.start", "x.end")


def _classes(read_exons: DataFrame, reference: DataFrame, tile: int) -> DataFrame:
    sizes = read_exons.groupBy("read_name").agg(F.count("*").alias("read_exons"))
    return annotate.read_classes(annotate.best_transcript(read_exons, reference, tile), sizes)


def _of(read_exons: DataFrame, classes: DataFrame, kind: str) -> DataFrame:
    return read_exons.join(classes.filter(F.col("class") == kind).select("read_name"), "read_name", "left_semi")


def _isoforms(read_exons: DataFrame, genes: DataFrame, tolerance: int, support: int, end_support: int) -> DataFrame:
    rows = materialize(junctions.read_chains(read_exons, tolerance), "chains")
    return materialize(junctions.with_genes(junctions.isoforms(rows, support, end_support), rows, genes), "isoforms")


def novel_transcriptome(read_exons: DataFrame, reference: DataFrame, tile: int, tolerance: int = 10, support: int = 2, end_support: int = 2) -> tuple[DataFrame, DataFrame]:
    """Novel isoforms (gene, chrom, strand, chain, start, end, n_reads) and named novel loci (name, chrom, start, end, n_reads).

    Reads are classed against the reference; those of novel isoforms are collapsed; reads
    of novel loci are classed again against these isoforms, and what matches a new
    isoform only in part joins the isoform reads for the final collapse. An isoform has the
    gene that most of its reads were classed with. Isoforms that are a full match or a subset
    of a known transcript are taken out. The other reads of novel loci are clustered.
    Reads of one exon take no part.
    """
    first = materialize(_classes(read_exons, reference, tile), "classes")
    isoform_reads, locus_reads = _of(read_exons, first, "novel-isoform"), _of(read_exons, first, "novel-locus")
    genes = first.filter("class = 'novel-isoform'").select("read_name", "gene")
    draft = isoform_exons(_isoforms(isoform_reads, genes, tolerance, support, end_support))
    second = materialize(_classes(locus_reads, draft, tile), "classes")
    merged = isoform_reads.unionByName(_of(locus_reads, second, "novel-isoform"))
    genes = genes.unionByName(second.filter("class = 'novel-isoform'").select("read_name", "gene"))
    found = _isoforms(merged, genes, tolerance, support, end_support)
    known = _classes(isoform_exons(found).withColumn("read_name", F.col("tx")), reference, tile).filter(F.col("class").isin("full", "subset"))
    named = found.withColumn("read_name", F.concat_ws(":", "chrom", "strand", "chain"))
    fresh = named.join(known.select("read_name"), "read_name", "left_anti").drop("read_name")
    left = _of(locus_reads, second, "novel-locus").groupBy("read_name", "chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    clusters = loci.locus_reads(left).groupBy("locus", "chrom", F.col("locus_start").alias("start"), F.col("locus_end").alias("end")).agg(F.count("*").alias("n_reads"))
    name = F.expr("concat('LOC', locus, '|', n_reads, '|', chrom, ':', start, '-', end)")
    return fresh, clusters.select(name.alias("name"), "chrom", "start", "end", "n_reads")
