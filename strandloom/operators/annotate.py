"""Annotation of reads with transcripts, and what the annotations say."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.bins import percent_text, ratio
from strandloom.operators import intervals


def best_transcript(read_exons: DataFrame, exons: DataFrame, tile: int) -> DataFrame:
    """The best reference transcript of each read.

    ``read_exons``: (read_name, chrom, exon_no, start, end); ``exons``: (gene, tx, chrom,
    exon_no, start, end). A match is 'full' if all of the transcript's exons are hit in a
    row, else 'partial'. Ranked by full, exons hit, overlap, then the shorter transcript
    and its name. Reads without any exon overlap drop out.
    """
    tx_size = exons.groupBy("tx").agg(F.count("*").alias("tx_exons"), F.sum(F.col("end") - F.col("start")).alias("tx_length"))
    read_size = read_exons.groupBy("read_name").agg(F.count("*").alias("read_exons"), F.sum(F.col("end") - F.col("start")).alias("read_length"))
    right = exons.select("gene", "tx", "chrom", F.col("exon_no").alias("tx_exon"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    hits = intervals.overlap_join(read_exons.select("read_name", "chrom", "start", "end"), right, ["chrom"], tile)
    # One shuffle by read serves all groupings below; a read's hits are bounded by its length.
    hits = hits.select("read_name", "gene", "tx", "tx_exon", "start", "end", "r_start", "r_end").repartition("read_name")
    by_exon = hits.groupBy("read_name", "gene", "tx", "tx_exon").agg(F.sum(intervals.overlap_size()).alias("overlap"))
    # A run of neighbouring exons has one value of (exon number - rank).
    run = F.col("tx_exon") - F.row_number().over(Window.partitionBy("read_name", "gene", "tx").orderBy("tx_exon"))
    runs = by_exon.withColumn("_run", run).groupBy("read_name", "gene", "tx", "_run").agg(F.count("*").alias("n"), F.sum("overlap").alias("overlap"))
    pairs = runs.groupBy("read_name", "gene", "tx").agg(F.sum("n").alias("matching_exon_count"), F.max("n").alias("consecutive_exons"), F.sum("overlap").alias("overlap_bases"))
    scored = pairs.join(tx_size, "tx").withColumn("match_type", F.when(F.col("consecutive_exons") == F.col("tx_exons"), "full").otherwise("partial"))
    order = Window.partitionBy("read_name").orderBy("match_type", F.col("matching_exon_count").desc(), F.col("overlap_bases").desc(), "tx_length", "tx")
    best = scored.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")
    return best.join(read_size, "read_name")


def read_classes(annotated: DataFrame, reads: DataFrame, least_exons: int = 2) -> DataFrame:
    """(read_name, gene, class): full, subset, novel-isoform, and novel-locus for reads without annotation.

    ``annotated``: (read_name, gene, match_type, consecutive_exons, read_exons);
    ``reads``: (read_name, read_exons). Reads of fewer than ``least_exons`` exons take no part.
    """
    seen = annotated.filter(F.col("read_exons") >= least_exons)
    kind = F.when(F.col("match_type") == "full", "full").when(F.col("consecutive_exons") == F.col("read_exons"), "subset").otherwise("novel-isoform")
    novel = reads.filter(F.col("read_exons") >= least_exons).join(seen.select("read_name"), "read_name", "left_anti")
    return seen.select("read_name", "gene", kind.alias("class")).unionByName(novel.select("read_name", F.lit(None).cast("string").alias("gene"), F.lit("novel-locus").alias("class")))


def unknown_isoforms(classes: DataFrame, isoforms: DataFrame) -> DataFrame:
    """Isoforms (read_name, ...) that aren't a full match or a subset of a known transcript."""
    return isoforms.join(classes.filter(F.col("class").isin("full", "subset")).select("read_name"), "read_name", "left_anti")


def lengths_by_status(reads: DataFrame, annotated: DataFrame) -> DataFrame:
    """(read_name, status, length, exon_count): status is the match type, or unannotated."""
    a = annotated.select("read_name", "match_type", "read_exons")
    return reads.join(a, "read_name", "left").select("read_name", F.coalesce("match_type", F.lit("unannotated")).alias("status"), "length", F.col("read_exons").alias("exon_count"))


def reference_counts(reference: DataFrame, annotated: DataFrame, key: str) -> DataFrame:
    """(key, n_reads, n_full) of every reference gene or transcript, 0 included."""
    counts = annotated.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("match_type") == "full").alias("f"))
    return reference.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n_reads"), F.coalesce("f", F.lit(0)).alias("n_full"))


def detected(reference: DataFrame, annotated: DataFrame, levels: list[str]) -> DataFrame:
    """A row per level (column of keys): how many of the reference's keys are detected, by any and by full matches.

    All levels are counted in one pass over the annotations.
    """
    key = F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("key")) for c in levels])).alias("x")
    full = F.max(F.when(F.col("match_type") == "full", 1).otherwise(0)).alias("full")
    seen = annotated.select("match_type", key).select("match_type", "x.*").filter("key is not null").groupBy("level", "key").agg(full)
    every = reference.select(key).select("x.*").filter("key is not null").distinct().join(seen, ["level", "key"], "left")
    n = every.groupBy("level").agg(F.count("*").alias("n_reference"), F.count("full").alias("n_any"), F.count_if(F.col("full") == 1).alias("n_full"))
    return n.select("level", "n_reference", "n_any", "n_full", ratio("n_any", "n_reference").alias("any_share"), percent_text("n_full", "n_reference").alias("full_percent"))


def top_keys(annotated: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The ``n`` keys with most reads; ties go by name."""
    return annotated.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_reads")).orderBy(F.col("n_reads").desc(), key).limit(n)


def counts_by_gene_and_transcript(annotated: DataFrame) -> DataFrame:
    """Read counts per gene (null tx) and per gene and transcript, in one pass: (gene, tx, level, n)."""
    rows = annotated.filter("gene is not null and tx is not null")
    sets = rows.groupingSets([["gene"], ["gene", "tx"]], "gene", "tx").agg(F.grouping("tx").alias("_g"), F.count("*").alias("n"))
    return sets.select("gene", "tx", F.when(F.col("_g") == 1, "gene").otherwise("transcript").alias("level"), "n")
