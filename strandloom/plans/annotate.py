"""Annotation, detection and rarefaction queries over annotbest, gpd and lengths."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import bins
from strandloom.operators import annotate, sampling, stats
from strandloom.plans import inputs, sql
from strandloom.session import table

SAMPLES = 10


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.annotations(spark, sf_dir).filter("gene is not null")


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "gpd").select(F.upper("gene").alias("gene"), F.upper("tx").alias("tx"))


def gene_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct genes and transcripts by any and by full matches."""
    full = F.col("match_type") == "full"
    cols = [F.countDistinct(c).alias(f"{c}_any") for c in ("gene", "tx")] + [F.countDistinct(F.when(full, F.col(c))).alias(f"{c}_full") for c in ("gene", "tx")]
    return inputs.annotations(spark, sf_dir).agg(*cols)


def ref_gene_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.reference_counts(_reference(spark, sf_dir), _annotated(spark, sf_dir), "gene")


def ref_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.detected(_reference(spark, sf_dir), _annotated(spark, sf_dir), ["gene", "tx"])


def top_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.top_keys(_annotated(spark, sf_dir), "gene")


def top_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.top_keys(_annotated(spark, sf_dir), "tx")


def gene_tx_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.counts_by_gene_and_transcript(_annotated(spark, sf_dir))


def annot_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = inputs.lengths(spark, sf_dir).filter("read_type <> 'unaligned'").select(F.col("qname").alias("read_name"), F.col("aligned_bases").alias("length"))
    return annotate.lengths_by_status(reads, inputs.annotations(spark, sf_dir).filter("match_type is not null"))


def annot_length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(annot_lengths(spark, sf_dir), "length", "exon_count", "status")


def tx_length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(_annotated(spark, sf_dir).filter("match_type is not null"), "tx_length", "tx_exons", "match_type")


def exon_size_distro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and exon count of each reference transcript."""
    size = F.aggregate("exons", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return inputs.transcripts(spark, sf_dir).select("tx", size.alias("length"), F.size("exons").alias("exon_count"))


def exon_plot_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and exon count of each reference transcript on the scale of the plots, with the length as their labels have it."""
    return exon_size_distro(spark, sf_dir).select("tx", *[F.round(bins.log2_plus_one(c), 6).alias(f"log_{c}") for c in ("length", "exon_count")], bins.with_commas("length").alias("label"))


def exon_count_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exon_size_distro(spark, sf_dir).withColumn("kind", F.lit("transcript"))
    return stats.histogram(rows, "length", "exon_count", "kind")


def read_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = inputs.annotations(spark, sf_dir).filter("read_name is not null")
    return annotate.read_classes(a.filter("gene is not null and match_type is not null"), a.select("read_name", "read_exons"))


def known_isoform_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = inputs.annotations(spark, sf_dir).filter("read_name is not null")
    return annotate.unknown_isoforms(read_classes(spark, sf_dir), a.select("read_name", "read_exons", "read_length"))


def bias_read_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated reads good enough for the position bias: two exons hit and 100 bases."""
    return _annotated(spark, sf_dir).filter("matching_exon_count >= 2 and read_length >= 100").select("read_name", "gene", "tx", "matching_exon_count", "read_length")


def contained_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated reads whose range (1-based, inclusive) lies within their transcript."""
    a = _annotated(spark, sf_dir).filter("tx is not null")
    part = lambda i: F.regexp_extract("rng", r"^(.+):([0-9]+)-([0-9]+)$", i)
    a = a.select("read_name", "tx", part(1).alias("chrom"), (part(2).try_cast("long") - 1).alias("start_pos"), part(3).try_cast("long").alias("end_pos"))
    t = table(spark, sf_dir, "gpd").select(F.upper("tx").alias("tx"), "chrom", "tx_start", "tx_end")
    return a.join(t, ["tx", "chrom"]).filter("start_pos >= tx_start and end_pos <= tx_end").select("read_name", "tx", "start_pos", "end_pos")


def _rarefaction(key: str, full: bool, min_depth: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curve over all reads; those without annotation are draws that find nothing."""
    rows = inputs.annotations(spark, sf_dir)
    value = F.when(F.col("match_type") == "full", F.col(key)) if full else F.col(key)
    draws = sampling.with_null_draws(rows.select("read_name", "read_line", value.alias("v")), "read_name", "read_line", "v", inputs.read_names(spark, sf_dir))
    return sampling.rarefaction(draws, "read_line", "v", SAMPLES, min_depth)


_CURVES = {"rarefaction_gene": ("gene", False, 1), "rarefaction_gene_full": ("gene", True, 1), "rarefaction_tx": ("tx", False, 1), "rarefaction_tx_full": ("tx", True, 1), "rarefaction_tx_twice": ("tx", False, 2)}


def _curve(name: str):
    f = partial(_rarefaction, *_CURVES[name])
    f.__name__ = name
    return f


def bias_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 500,000 annotated reads in draw order (the reference's limit for this analysis)."""
    return sampling.downsample(_annotated(spark, sf_dir).select("read_line", "read_name", "tx"), "read_line", 500_000)


def gene_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 100 reads of each gene."""
    return sampling.downsample_groups(_annotated(spark, sf_dir).select("read_line", "read_name", "gene"), ["gene"], "read_line", 100)


def length_budget_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads in draw order until 1,000,000 bases are reached."""
    return sampling.within_budget(_annotated(spark, sf_dir).filter("read_length > 0").select("read_line", "read_length"), "read_line", "read_length", 1_000_000)


QUERIES = (
    gene_counts, ref_gene_counts, ref_detected, top_genes, top_transcripts, gene_tx_grouping, annot_lengths, annot_length_hist, tx_length_hist, exon_size_distro, exon_plot_sizes, exon_count_hist, read_classes,
    known_isoform_filter, bias_read_filter, contained_reads, *map(_curve, _CURVES), bias_downsample, gene_downsample, length_budget_sample,
)

_A = "a AS (SELECT DISTINCT * EXCLUDE (load_ts) REPLACE (upper(trim(gene, ' ' || chr(9))) AS gene, upper(trim(tx, ' ' || chr(9))) AS tx) FROM annotbest)"
_L = "l AS (SELECT DISTINCT * EXCLUDE (load_ts) FROM lengths)"
_AL = f"{_A}, {_L}, al AS (SELECT qname AS read_name, coalesce(match_type, 'unannotated') AS status, l.aligned_bases AS length, read_exons AS exon_count FROM l LEFT JOIN (SELECT * FROM a WHERE match_type IS NOT NULL) AS b ON l.qname = b.read_name WHERE l.read_type <> 'unaligned')"
_CLASSES = f"""{_A}, b AS (SELECT * FROM a WHERE read_name IS NOT NULL), n AS (SELECT read_name, gene, CASE WHEN match_type = 'full' THEN 'full' WHEN consecutive_exons = read_exons THEN 'subset' ELSE 'novel-isoform' END AS class FROM b WHERE gene IS NOT NULL AND match_type IS NOT NULL AND read_exons >= 2),
cl AS (SELECT * FROM n UNION ALL SELECT read_name, NULL, 'novel-locus' FROM b WHERE read_exons >= 2 AND read_name NOT IN (SELECT read_name FROM n))"""


def _hist(source: str, length: str, count: str, kind: str) -> str:
    return f"""SELECT 'length' AS axis, {sql.length_bin(length)} AS bin, {kind}, count(*) AS n FROM {source} WHERE {length} IS NOT NULL GROUP BY ALL UNION ALL
SELECT 'exons', CASE WHEN {count} > 20 THEN '>20' ELSE CAST({count} AS VARCHAR) END AS bin, {kind}, count(*) AS n FROM {source} WHERE {count} IS NOT NULL GROUP BY ALL"""


def _rare(key: str, full: bool, depth: int) -> str:
    value = f"CASE WHEN match_type = 'full' THEN {key} END" if full else key
    draws = f"""ra AS (SELECT read_line, {value} AS v FROM a UNION ALL
SELECT CAST('0x' || substr(md5(qname), 1, 15) AS BIGINT), NULL FROM (SELECT DISTINCT qname FROM lengths) WHERE qname NOT IN (SELECT read_name FROM a))"""
    return f"WITH {_A}, {draws}, {sql.rarefaction('ra', 'read_line', 'v', SAMPLES, depth)}"


ORACLES = {
    "gene_counts": f"WITH {_A} SELECT count(DISTINCT gene) AS gene_any, count(DISTINCT tx) AS tx_any, count(DISTINCT gene) FILTER (match_type = 'full') AS gene_full, count(DISTINCT tx) FILTER (match_type = 'full') AS tx_full FROM a",
    "ref_gene_counts": f"WITH {_A}, g AS (SELECT DISTINCT upper(gene) AS gene FROM gpd) SELECT g.gene, count(a.gene) AS n_reads, count(*) FILTER (match_type = 'full') AS n_full FROM g LEFT JOIN a ON g.gene = a.gene GROUP BY g.gene",
    "ref_detected": f"WITH {_A}, " + ", ".join(f"{k}r AS (SELECT k, count(a.{k}) AS r, count(*) FILTER (match_type = 'full') AS f FROM (SELECT DISTINCT upper({k}) AS k FROM gpd) LEFT JOIN (SELECT * FROM a WHERE gene IS NOT NULL) AS a ON k = a.{k} GROUP BY k)" for k in ("gene", "tx"))
    + " UNION ALL ".join(f" SELECT '{k}' AS level, count(*) AS n_reference, count(*) FILTER (r > 0) AS n_any, count(*) FILTER (f > 0) AS n_full, round(count(*) FILTER (r > 0) / count(*), 6) AS any_share, CAST(CAST(round(100 * count(*) FILTER (f > 0) / count(*)) AS BIGINT) AS VARCHAR) || '%' AS full_percent FROM {k}r" for k in ("gene", "tx")),
    "top_genes": f"WITH {_A} SELECT gene, count(*) AS n_reads FROM a WHERE gene IS NOT NULL GROUP BY gene ORDER BY n_reads DESC, gene LIMIT 5",
    "top_transcripts": f"WITH {_A} SELECT tx, count(*) AS n_reads FROM a WHERE tx IS NOT NULL AND gene IS NOT NULL GROUP BY tx ORDER BY n_reads DESC, tx LIMIT 5",
    "gene_tx_grouping": f"WITH {_A} SELECT gene, tx, CASE WHEN grouping(tx) = 1 THEN 'gene' ELSE 'transcript' END AS level, count(*) AS n FROM a WHERE gene IS NOT NULL AND tx IS NOT NULL GROUP BY GROUPING SETS ((gene), (gene, tx))",
    "annot_lengths": f"WITH {_AL} SELECT * FROM al",
    "annot_length_hist": f"WITH {_AL} {_hist('al', 'length', 'exon_count', 'status')}",
    "tx_length_hist": f"WITH {_A}, h AS (SELECT * FROM a WHERE gene IS NOT NULL AND match_type IS NOT NULL) {_hist('h', 'tx_length', 'tx_exons', 'match_type')}",
    "exon_size_distro": f"WITH {sql.EXONS} SELECT tx, CAST(sum(e - s) AS BIGINT) AS length, CAST(count(*) AS INTEGER) AS exon_count FROM gx GROUP BY tx",
    "exon_plot_sizes": f"WITH {sql.EXONS}, d AS (SELECT tx, CAST(sum(e - s) AS BIGINT) AS length, count(*) AS n FROM gx GROUP BY tx) SELECT tx, round(log2(length) + 1, 6) AS log_length, round(log2(n) + 1, 6) AS log_exon_count, format('{{:,}}', length) AS label FROM d",
    "exon_count_hist": f"WITH {sql.EXONS}, h AS (SELECT 'transcript' AS kind, sum(e - s) AS length, count(*) AS c FROM gx GROUP BY tx) {_hist('h', 'length', 'c', 'kind')}",
    "read_classes": f"WITH {_CLASSES} SELECT * FROM cl",
    "known_isoform_filter": f"WITH {_CLASSES} SELECT read_name, read_exons, read_length FROM b WHERE read_name NOT IN (SELECT read_name FROM cl WHERE class IN ('full', 'subset'))",
    "bias_read_filter": f"WITH {_A} SELECT read_name, gene, tx, matching_exon_count, read_length FROM a WHERE gene IS NOT NULL AND matching_exon_count >= 2 AND read_length >= 100",
    "contained_reads": f"WITH {_A}, p AS (SELECT read_name, tx, regexp_extract(rng, '^(.+):([0-9]+)-([0-9]+)$', 1) AS chrom, TRY_CAST(regexp_extract(rng, '^(.+):([0-9]+)-([0-9]+)$', 2) AS BIGINT) - 1 AS start_pos, TRY_CAST(regexp_extract(rng, '^(.+):([0-9]+)-([0-9]+)$', 3) AS BIGINT) AS end_pos FROM a WHERE gene IS NOT NULL AND tx IS NOT NULL) SELECT read_name, p.tx, start_pos, end_pos FROM p JOIN gpd ON p.tx = upper(gpd.tx) AND p.chrom = gpd.chrom WHERE start_pos >= tx_start AND end_pos <= tx_end",
    **{k: _rare(*v) for k, v in _CURVES.items()},
    "bias_downsample": f"WITH {_A} SELECT read_line, read_name, tx FROM a WHERE gene IS NOT NULL ORDER BY {sql.mix('read_line', '0')}, read_line LIMIT 500000",
    "gene_downsample": f"WITH {_A} SELECT read_line, read_name, gene FROM a WHERE gene IS NOT NULL QUALIFY row_number() OVER (PARTITION BY gene ORDER BY {sql.mix('read_line', '0')}, read_line) <= 100",
    "length_budget_sample": f"WITH {_A}, b AS (SELECT read_line, read_length, sum(read_length) OVER (ORDER BY {sql.mix('read_line', '0')}, read_line) - read_length AS upto FROM a WHERE gene IS NOT NULL AND read_length > 0) SELECT read_line, read_length FROM b WHERE upto < 1000000",
}
