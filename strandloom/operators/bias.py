"""Coverage along transcripts from 5' to 3'."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators import intervals
from strandloom.session import materialize

BINS = 100


def bias_bins(read_exons: DataFrame, exons: DataFrame, annotated: DataFrame, least_reads: int = 5, least_length: int = 100, least_exons: int = 2, covered_ends: bool = False, overflow: bool = True) -> DataFrame:
    """(tx, bin 1..100, value): mean depth per read in each hundredth of a transcript, from its 5' end.

    ``annotated``: (read_name, tx, matching_exon_count, read_length). A mean of depth is
    a sum over the pieces of reads, so pieces are spread over the bins they touch and
    added up; equal exons of a transcript's reads are counted before they meet its exons,
    so a transcript of very many reads is joined by its distinct intervals only. Bins without a position (transcripts
    shorter than 100) are 0. ``covered_ends`` leaves the uncovered ends of a transcript
    out; without ``overflow``, reads that reach beyond their transcript take no part.
    """
    good = annotated.filter((F.col("matching_exon_count") >= least_exons) & (F.col("read_length") >= least_length)).select("read_name", "tx")
    if not overflow:
        reads = read_exons.groupBy("read_name").agg(F.min("start").alias("s"), F.max("end").alias("e"))
        spans = exons.groupBy("tx").agg(F.min("start").alias("ts"), F.max("end").alias("te"))
        good = good.join(reads, "read_name").join(spans, "tx").filter("s >= ts and e <= te").select("read_name", "tx")
    good = materialize(good, "annotated")
    counts = good.groupBy("tx").agg(F.count("*").alias("reads")).filter(F.col("reads") >= least_reads)
    w = Window.partitionBy("tx").orderBy("start")
    placed = exons.withColumn("offset", F.sum(F.col("end") - F.col("start")).over(w) - (F.col("end") - F.col("start"))).withColumn("length", F.sum(F.col("end") - F.col("start")).over(Window.partitionBy("tx")))
    parts = placed.select("tx", "strand", "offset", "length", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    spans = read_exons.select("read_name", "start", "end").join(good, "read_name").groupBy("tx", "start", "end").agg(F.count("*").alias("n"))
    pairs = spans.join(counts, "tx").join(parts, "tx").filter("start < r_end and r_start < end")
    begin = F.col("offset") + F.greatest("start", "r_start") - F.col("r_start")
    pieces = pairs.select("tx", "strand", "length", "reads", "n", begin.alias("a"), (begin + intervals.overlap_size()).alias("b"))
    minus = F.col("strand") == "-"
    pieces = pieces.select("tx", "length", "reads", "n", F.when(minus, F.col("length") - F.col("b")).otherwise(F.col("a")).alias("a"), F.when(minus, F.col("length") - F.col("a")).otherwise(F.col("b")).alias("b"))
    pieces = pieces.groupBy("tx", "length", "reads", "a", "b").agg(F.sum("n").alias("n"))
    sizes = placed.select("tx", "length").distinct()
    if covered_ends:
        ends = pieces.groupBy("tx").agg(F.min("a").alias("lo"), F.max("b").alias("hi"))
        pieces = pieces.join(ends, "tx").select("tx", (F.col("hi") - F.col("lo")).alias("length"), "reads", (F.col("a") - F.col("lo")).alias("a"), (F.col("b") - F.col("lo")).alias("b"), "n")
        sizes = ends.select("tx", (F.col("hi") - F.col("lo")).alias("length"))
    touched = pieces.withColumn("bin", F.explode(F.expr(f"sequence(a * {BINS} div length + 1, (b - 1) * {BINS} div length + 1)")))
    low, high = F.expr(f"((bin - 1) * length + {BINS - 1}) div {BINS}"), F.expr(f"(bin * length + {BINS - 1}) div {BINS}")
    sums = touched.groupBy("tx", "bin").agg(F.sum(F.col("n") * (F.least("b", high) - F.greatest("a", low))).alias("total"))
    every = sizes.join(counts, "tx").withColumn("bin", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(BINS).cast("long"))))
    value = F.coalesce(F.try_divide(F.col("total"), (high - low) * F.col("reads")), F.lit(0.0))
    return every.join(sums, ["tx", "bin"], "left").select("tx", "bin", F.round(value, 6).alias("value"))
