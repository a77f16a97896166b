"""Line formats of alignments, transcripts, features and sequences, as DataFrames; plain or gzip by suffix.

Coordinates are 0-based and half-open throughout.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.session import ship_package
from strandloom.sources import bam

MIN_INTRON = 68


def _fields(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    lines = spark.read.text(path).filter(~F.col("value").startswith(comment) & (F.length(F.trim("value")) > 0))
    return lines.select(F.split("value", "\t").alias("f"))


def _numbers(column: Column) -> Column:
    return F.transform(F.split(F.rtrim(column, F.lit(",")), ","), lambda x: x.cast("long"))


def read_genepred(spark: SparkSession, path: str) -> DataFrame:
    """Trusted genePred lines; for lines that may be broken see :mod:`strandloom.sources.rejects`."""
    f = F.col("f")
    exons = F.arrays_zip(_numbers(f[9]).alias("start"), _numbers(f[10]).alias("end"))
    return _fields(spark, path).select(
        f[0].alias("gene"), f[1].alias("tx"), f[2].alias("chrom"), f[3].alias("strand"), *[f[i].cast("long").alias(n) for i, n in enumerate(("tx_start", "tx_end", "cds_start", "cds_end"), 4)], f[8].cast("int").alias("exon_count"), exons.alias("exons")
    )


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, payload): the fields after the third as an array. Track and browser lines are skipped."""
    rows = _fields(spark, path).filter(~F.col("f")[0].rlike("^(track|browser)\\b"))
    return rows.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("start"), F.col("f")[2].cast("long").alias("end"), F.expr("slice(f, 4, size(f))").alias("payload"))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Exon lines of a GTF grouped to transcripts, in the columns of :func:`read_genepred`."""
    f = F.col("f")
    rows = _fields(spark, path).filter(f[2] == "exon").select(
        F.regexp_extract(f[8], 'gene_id "([^"]*)"', 1).alias("gene"), F.regexp_extract(f[8], 'transcript_id "([^"]*)"', 1).alias("tx"), f[0].alias("chrom"), f[6].alias("strand"), (f[3].cast("long") - 1).alias("start"), f[4].cast("long").alias("end"), F.lit(None).alias("exon_no")
    )
    t = to_genepred(rows, "tx")
    return t.withColumn("exons", F.arrays_zip(_numbers(F.col("exon_starts")).alias("start"), _numbers(F.col("exon_ends")).alias("end"))).drop("exon_starts", "exon_ends")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence) of each record; the name ends at the first blank."""
    records = spark.read.option("lineSep", ">").text(path).filter(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", r"^(\S*)", 1)
    return records.select(head.alias("name"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", "")).alias("sequence"))


def read_fasta_tiles(spark: SparkSession, path: str, tile: int = 1 << 16) -> DataFrame:
    """(chrom, tile, bases): sequences cut into tiles, so that what follows doesn't move a chromosome as one row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, sequence in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                starts = range(0, len(sequence), tile)
                for i in range(0, len(starts), 64):
                    part = starts[i : i + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([x // tile for x in part], pa.int64()), pa.array([sequence[x : x + tile] for x in part])], ["chrom", "tile", "bases"])

    return read_fasta(spark, path).mapInArrow(cut, "chrom string, tile long, bases string")


def read_sam_header(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, chrom_length) of the sequences of a SAM text or, by its suffix, of a BAM file."""
    if path.endswith(".bam"):
        with bam.open_file(path) as f:
            return spark.createDataFrame(bam.read_header(f)[0], "chrom string, chrom_length long")
    rows = spark.read.text(path).filter(F.col("value").startswith("@SQ\t"))
    return rows.select(F.regexp_extract("value", "\tSN:([^\t]+)", 1).alias("chrom"), F.regexp_extract("value", "\tLN:([0-9]+)", 1).cast("long").alias("chrom_length"))


def read_sam(spark: SparkSession, path: str, min_intron: int = MIN_INTRON) -> DataFrame:
    """Alignments of a SAM text; see :func:`alignments`. ``aln_id`` grows with the place in the file."""
    f = F.col("f")
    rows = _fields(spark, path, "@").select(F.monotonically_increasing_id().alias("aln_id"), f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("chrom"), (f[3].cast("long") - 1).alias("t"), f[5].alias("cigar"), f[9].alias("seq"))
    return alignments(rows, min_intron)


def read_bam(spark: SparkSession, path: str, min_intron: int = MIN_INTRON, split: int = bam.SPLIT_BYTES) -> DataFrame:
    """Alignments of a BAM file; see :func:`alignments`. ``aln_id`` is the place in the file."""
    ship_package(spark)
    spark.dataSource.register(bam.BamSource)
    return alignments(spark.read.format(bam.BamSource.name()).option("split", split).load(path), min_intron)


def alignments(rows: DataFrame, min_intron: int = MIN_INTRON) -> DataFrame:
    """The columns of an alignment table from the fields (aln_id, qname, flag, chrom, t, cigar, seq) of SAM or BAM.

    Gives (aln_id, qname, flag, qlen, q_start, q_end, chrom, strand, t_start, t_end,
    exons, aligned_bases, cigar, seq). Gaps (N or D) of at least ``min_intron`` split
    exons, shorter ones are smoothed over. The query range is on the read as sequenced:
    clips count, and it is mirrored on the reverse strand. Unaligned entries have null
    positions and 0 aligned bases; their length is that of their sequence.
    """
    ops = "transform(regexp_extract_all(cigar, '([0-9]+[MIDNSHP=X])', 1), x -> struct(cast(substr(x, 1, length(x) - 1) as bigint) as n, right(x, 1) as op))"
    rows = rows.withColumn("ops", F.expr(ops)).withColumn("aligned", (F.col("flag").bitwiseAND(4) == 0) & (F.col("cigar") != "*"))
    total = lambda kinds: F.expr(f"aggregate(filter(ops, x -> x.op in ({kinds})), 0L, (a, x) -> a + x.n)")
    # Walk over the target: an exon grows by M, =, X and short gaps, a long gap begins a new one.
    walk = (
        f"aggregate(filter(ops, x -> x.op in ('M', '=', 'X', 'D', 'N')), struct(t as at, array(struct(t as start, t as end)) as e), "
        f"(a, x) -> struct(a.at + x.n as at, if(x.op in ('D', 'N') and x.n >= {min_intron}, concat(a.e, array(struct(a.at + x.n as start, a.at + x.n as end))), "
        "concat(slice(a.e, 1, size(a.e) - 1), array(struct(element_at(a.e, -1).start as start, a.at + x.n as end)))) as e), a -> a.e)"
    )
    lead, tail = F.expr("if(ops[0].op in ('S', 'H'), ops[0].n + if(ops[1].op = 'S', ops[1].n, 0), 0)"), F.expr("if(element_at(ops, -1).op in ('S', 'H'), element_at(ops, -1).n + if(size(ops) > 1 and element_at(ops, -2).op = 'S', element_at(ops, -2).n, 0), 0)")
    reverse = F.col("flag").bitwiseAND(16) != 0
    span, qlen = total("'M', 'I', '=', 'X'"), total("'M', 'I', '=', 'X', 'S', 'H'")
    start = F.when(reverse, tail).otherwise(lead)
    on = lambda c: F.when(F.col("aligned"), c)
    known = F.when(F.col("seq") != "*", F.length("seq").cast("long"))
    exons = rows.withColumn("exons", on(F.expr(walk)))
    return exons.select(
        "aln_id", "qname", "flag", F.when(F.col("aligned"), qlen).otherwise(known).alias("qlen"), on(start).alias("q_start"), on(start + span).alias("q_end"), on(F.col("chrom")).alias("chrom"), on(F.when(reverse, "-").otherwise("+")).alias("strand"),
        F.expr("exons[0].start").alias("t_start"), F.expr("element_at(exons, -1).end").alias("t_end"), "exons", F.when(F.col("aligned"), total("'M', '=', 'X'")).otherwise(F.lit(0).cast("long")).alias("aligned_bases"), "cigar", "seq",
    )


_OPERATION = re.compile(r"([0-9]+)([MIDNSHP=X])")


def _spelled(cigar: str, seq: str, target: str, min_intron: int) -> tuple[str, str]:
    """Both sides of an alignment base by base, from the bases of its exons; long gaps in the target are left out."""
    t = q = 0
    left, right = [], []
    for n, op in _OPERATION.findall(cigar):
        n = int(n)
        if op in "M=X":
            left.append(target[t : t + n])
            right.append(seq[q : q + n])
            t, q = t + n, q + n
        elif op == "I":
            left.append("-" * n)
            right.append(seq[q : q + n])
            q += n
        elif op == "S":
            q += n
        elif op in "DN" and n < min_intron:
            left.append(target[t : t + n])
            right.append("-" * n)
            t += n
    return "".join(left), "".join(right)


def aligned_bases(rows: DataFrame, genome: DataFrame, tile: int = 1 << 16, min_intron: int = MIN_INTRON) -> DataFrame:
    """(aln_id, target, query): the aligned bases of alignments with a sequence, '-' for a gap, as the error profiles take them.

    ``genome`` has tiles (chrom, tile, bases). Exons are cut at tiles, looked up there and put
    together again by alignment, so a chromosome is never sent to an alignment as a whole.
    Alignments on sequences that the genome lacks, or beyond their end, drop out.
    """
    held = rows.filter("exons is not null and seq is not null and seq <> '*'")
    exons = held.select("aln_id", "chrom", F.explode("exons").alias("x")).select("aln_id", "chrom", "x.start", "x.end").filter("start < end")
    parts = exons.withColumn("tile", F.explode(F.sequence(F.expr(f"start div {tile}"), F.expr(f"(end - 1) div {tile}"))))
    first, last = F.greatest("start", F.col("tile") * tile), F.least("end", (F.col("tile") + 1) * tile)
    cut = parts.select("aln_id", "chrom", "tile", first.alias("start"), last.alias("end"))
    pieces = cut.join(genome, ["chrom", "tile"]).select("aln_id", "start", F.expr(f"substr(bases, int(start - tile * {tile}) + 1, int(end - start))").alias("bases"))
    targets = pieces.groupBy("aln_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "bases"))), lambda x: x["bases"]), "").alias("target"))
    size = F.aggregate("exons", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    both = held.select("aln_id", "cigar", "seq", size.alias("size")).join(targets, "aln_id").filter("length(target) = size").select("aln_id", "cigar", F.upper("seq").alias("seq"), "target")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_spelled(c, s, t, min_intron) for c, s, t in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.string())], ["aln_id", "target", "query"])

    return both.mapInArrow(spell, "aln_id long, target string, query string")


def to_genepred(exons: DataFrame, tx: str) -> DataFrame:
    """Exon rows (gene, tx, chrom, strand, start, end) as genePred columns with comma lists."""
    sorted_exons = F.sort_array(F.collect_list(F.struct("start", "end"))).alias("x")
    t = exons.groupBy("gene", F.col(tx).alias("tx"), "chrom", "strand").agg(sorted_exons)
    joined = lambda c: F.concat(F.array_join(F.transform("x", lambda e: e[c].cast("string")), ","), F.lit(","))
    first, last = F.element_at("x", 1)["start"], F.array_max(F.transform("x", lambda e: e["end"]))
    return t.select("gene", "tx", "chrom", "strand", first.alias("tx_start"), last.alias("tx_end"), first.alias("cds_start"), last.alias("cds_end"), F.size("x").alias("exon_count"), joined("start").alias("exon_starts"), joined("end").alias("exon_ends"))


def to_bed12(transcripts: DataFrame, color: Column | str = "0,0,0", keep: list[str] | None = None) -> DataFrame:
    """genePred columns as BED12 columns, after the columns ``keep``; blocks are relative to the start."""
    starts, ends = _numbers(F.col("exon_starts")), _numbers(F.col("exon_ends"))
    joined = lambda c: F.concat(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(","))
    return transcripts.select(
        *(keep or []), "chrom", F.col("tx_start").alias("start_pos"), F.col("tx_end").alias("end_pos"), F.col("tx").alias("name"), F.lit(1000).alias("score"), "strand", F.col("cds_start").alias("thick_start"), F.col("cds_end").alias("thick_end"),
        (F.lit(color) if isinstance(color, str) else color).alias("color"), F.col("exon_count").alias("block_count"), joined(F.zip_with(starts, ends, lambda s, e: e - s)).alias("block_sizes"), joined(F.transform(starts, lambda s: s - F.col("tx_start"))).alias("block_starts"),
    )


def from_bed12(bed: DataFrame) -> DataFrame:
    """BED12 columns as genePred columns; the name is gene and transcript."""
    starts = F.transform(_numbers(F.col("block_starts")), lambda s: s + F.col("start_pos"))
    ends = F.zip_with(starts, _numbers(F.col("block_sizes")), lambda s, n: s + n)
    joined = lambda c: F.concat(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(","))
    return bed.select(F.col("name").alias("gene"), F.col("name").alias("tx"), "chrom", "strand", F.col("start_pos").alias("tx_start"), F.col("end_pos").alias("tx_end"), F.col("thick_start").alias("cds_start"), F.col("thick_end").alias("cds_end"), F.col("block_count").alias("exon_count"), joined(starts).alias("exon_starts"), joined(ends).alias("exon_ends"))


def write_lines(df: DataFrame, path: str, gzip: bool = True) -> None:
    """Tab-separated lines without a header, one file per partition."""
    df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value")).write.option("compression", "gzip" if gzip else "none").text(path)
