"""From alignment files to the tables that the queries read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import annotate, errors, paths, reads
from strandloom.sources import formats

#: Tile of the join of read exons with transcript exons.
EXON_TILE = 1 << 12


def _comma_list(column: str) -> Column:
    return F.concat(F.array_join(F.transform("exons", lambda x: x[column].cast("string")), ","), F.lit(","))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """The reference transcripts of a genePred file or, by its suffix, of a GTF, in the columns of ``gpd``."""
    read = formats.read_gtf if path.removesuffix(".gz").endswith(".gtf") else formats.read_genepred
    t = read(spark, path)
    return t.select("gene", "tx", "chrom", "strand", "tx_start", "tx_end", "cds_start", "cds_end", "exon_count", _comma_list("start").alias("exon_starts"), _comma_list("end").alias("exon_ends"))


def exon_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per exon of rows with an array ``exons``: (keys, exon_no, start, end)."""
    return rows.select(*keys, F.posexplode("exons").alias("exon_no", "x")).select(*keys, "exon_no", "x.start", "x.end")


def best_annotations(best: DataFrame, gpd_exons: DataFrame, tile: int = EXON_TILE) -> DataFrame:
    """The columns of ``annotbest`` for the best alignment of each read (aln_id, qname, chrom, exons); unannotated reads have null gene and tx."""
    read_exons = exon_rows(best.withColumnRenamed("qname", "read_name"), "read_name", "chrom")
    found = annotate.best_transcript(read_exons, gpd_exons, tile).drop("read_exons", "read_length")
    size = F.aggregate("exons", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    place = F.expr("concat(chrom, ':', exons[0].start + 1, '-', element_at(exons, -1).end)")
    every = best.select(F.col("aln_id").alias("read_line"), F.col("qname").alias("read_name"), F.size("exons").alias("read_exons"), size.alias("read_length"), place.alias("rng"))
    ints = [F.col(c).cast("int").alias(c) for c in ("matching_exon_count", "consecutive_exons", "read_exons", "tx_exons")]
    return every.join(found, "read_name", "left").select("read_line", "read_name", "gene", "tx", "match_type", *ints, F.col("overlap_bases").cast("long").alias("overlap_bases"), "read_length", F.col("tx_length").cast("long").alias("tx_length"), "rng")


def build_tables(spark: SparkSession, alignments: str, out: str, annotation: str | None = None, genome: str | None = None, min_intron: int = formats.MIN_INTRON, options: paths.PathOptions | None = None) -> list[str]:
    """Write the tables of a SAM text or BAM file under ``out``; returns their names.

    Always alndata, aln_exons, lengths and chrlens; with ``annotation`` (genePred or GTF)
    gpd and annotbest; with ``genome`` (FASTA) aligned_pairs and error_stats. Files have
    one batch, run and day, so batch_no and run_no are 0 and run_day and load_ts null.
    """
    read = formats.read_bam if alignments.endswith(".bam") else formats.read_sam
    done: list[str] = []

    def write(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
        done.append(name)
        return spark.read.parquet(f"{out}/{name}.parquet")

    no_time = F.lit(None).cast("timestamp")
    rows = write("aln_exons", read(spark, alignments, min_intron))
    entries = rows.drop("exons", "cigar", "seq").withColumns({"batch_no": F.lit(0), "load_ts": no_time})
    aln = write("alndata", entries)
    write("chrlens", formats.read_sam_header(spark, alignments))
    resolved = paths.resolve_paths(aln, options).select("qname", "read_type", F.col("single_bases").alias("aligned_bases"), "total_bases", "qlen")
    write("lengths", resolved.withColumns({"run_no": F.lit(0), "run_day": no_time, "load_ts": no_time}))
    if annotation:
        gpd = write("gpd", transcripts(spark, annotation))
        lists = F.arrays_zip(*[F.expr(f"transform(split(rtrim(',', {c}), ','), x -> cast(x as bigint))").alias(n) for c, n in (("exon_starts", "start"), ("exon_ends", "end"))])
        best = reads.best_alignment(rows.select("aln_id", "qname", "flag", "aligned_bases", "chrom", "exons"))
        found = best_annotations(best, exon_rows(gpd.withColumn("exons", lists), "gene", "tx", "chrom"))
        write("annotbest", found.withColumn("load_ts", no_time))
    if genome:
        best = reads.best_alignment(rows.select("aln_id", "qname", "flag", "aligned_bases", "chrom", "exons", "cigar", "seq"))
        pairs = write("aligned_pairs", formats.aligned_bases(best, formats.read_fasta_tiles(spark, genome), min_intron=min_intron))
        write("error_stats", errors.error_stats(pairs))
    return done
