"""Depth, coverage, features and interval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import bins
from strandloom.operators import coverage as cov
from strandloom.operators import intervals, reads
from strandloom.plans import inputs, sql

#: Tile of the joins of reads with features: about the length of a long read.
JOIN_TILE = 1 << 14


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.depth(inputs.spans(spark, sf_dir), ["chrom"])


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.depth_histogram(_segments(spark, sf_dir))


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.total(_histogram(spark, sf_dir), inputs.chroms(spark, sf_dir))


def depth_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_segments(spark, sf_dir))


def depth_hist_chrom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.per_chromosome(_histogram(spark, sf_dir), inputs.chroms(spark, sf_dir))


def depth_hist_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir)


def depth_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.cumulative_line(_totals(spark, sf_dir))


def depth_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.strata(_totals(spark, sf_dir))


def chrom_aligned_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.aligned_fraction(_histogram(spark, sf_dir), inputs.chroms(spark, sf_dir))


def depth_boxplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.depth_quartiles(_histogram(spark, sf_dir))


def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(intervals.merge(inputs.spans(spark, sf_dir), ["chrom"]))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = inputs.transcripts(spark, sf_dir).select("chrom", F.col("tx_start").alias("start"), F.col("tx_end").alias("end"))
    return cov.features(inputs.exons(spark, sf_dir), tx, inputs.chroms(spark, sf_dir))


def features_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_features(spark, sf_dir))


def subtract_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of reads' spans outside every exon."""
    return _named(intervals.subtract(inputs.spans(spark, sf_dir), inputs.exons(spark, sf_dir), ["chrom"]))


def feature_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).groupBy("kind").agg(F.sum(F.col("end") - F.col("start")).alias("size"), F.count("*").alias("n"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.depth_in_features(_segments(spark, sf_dir), _features(spark, sf_dir), JOIN_TILE)


def depth_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_pieces(spark, sf_dir))


def feature_depth_cumfrac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.feature_depth(_pieces(spark, sf_dir), feature_sizes(spark, sf_dir).select("kind", "size"))


def overlap_join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of an alignment and an exon that overlap, with the size of the overlap."""
    right = inputs.exons(spark, sf_dir).select("tx", "exon_no", "chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    pairs = intervals.overlap_join(inputs.spans(spark, sf_dir).select("aln_id", "chrom", "start", "end"), right, ["chrom"], JOIN_TILE)
    return pairs.select("aln_id", "tx", "exon_no", intervals.overlap_size().alias("overlap"))


def _best_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = reads.best_alignment(inputs.alignments(spark, sf_dir, "qname", "flag", "chrom", "t_start", "t_end", "aligned_bases"))
    return best.select("qname", "chrom", F.col("t_start").alias("start"), F.col("t_end").alias("end"))


def read_feature_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = _features(spark, sf_dir).withColumnsRenamed({"start": "r_start", "end": "r_end"})
    return cov.overlap_of(_best_spans(spark, sf_dir), "qname", right, "kind", JOIN_TILE)


def read_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _best_spans(spark, sf_dir).select("qname", (F.col("end") - F.col("start")).alias("length"))
    return reads.assign_feature(read_feature_overlap(spark, sf_dir), sizes)


def read_feature_hist_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_features(spark, sf_dir).groupBy(bins.length_bin("length").alias("bin"), "feature").agg(F.count("*").alias("n"))


def weighted_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = inputs.annotations(spark, sf_dir).filter("tx is not null").groupBy("tx").agg(F.count("*").alias("n"))
    exons = inputs.exons(spark, sf_dir).select(F.upper("tx").alias("tx"), "chrom", "start", "end")
    return _named(cov.weighted_depth(exons, counts))


QUERIES = (
    depth_segments, depth_hist_chrom, depth_hist_total, depth_line, depth_strata, chrom_aligned_fraction, depth_boxplot, merged_ranges, features_partition, subtract_introns,
    feature_sizes, depth_by_feature, feature_depth_cumfrac, overlap_join_pairs, read_feature_overlap, read_features, read_feature_hist_len, weighted_depth,
)

_SEG = f"{sql.ALN}, {sql.SPANS}, {sql.depth('seg', 'spans')}"
_HIST = f"{_SEG}, h AS (SELECT chrom, depth, CAST(sum(e - s) AS BIGINT) AS bases FROM seg GROUP BY ALL)"
_TOTAL = f"""{_HIST}, k AS (SELECT h.* FROM h SEMI JOIN chrlens USING (chrom)),
tot AS (SELECT depth, CAST(sum(bases) AS BIGINT) AS bases, (SELECT CAST(sum(bases) AS BIGINT) FROM k) AS covered, (SELECT CAST(sum(chrom_length) AS BIGINT) FROM chrlens) AS genome_length FROM k GROUP BY depth)"""
_PIECES = f"{_SEG}, {sql.FEATURES}, pc AS (SELECT seg.chrom, greatest(seg.s, feat.s) AS s, least(seg.e, feat.e) AS e, depth, kind FROM seg JOIN feat ON seg.chrom = feat.chrom AND seg.s < feat.e AND feat.s < seg.e)"
_OVER = f"""{sql.ALN}, {sql.BEST}, {sql.FEATURES}, ov AS (SELECT qname, kind, CAST(sum(least(t_end, e) - greatest(t_start, s)) AS BIGINT) AS overlap FROM best JOIN feat ON best.chrom = feat.chrom AND t_start < e AND s < t_end GROUP BY ALL)"""
_ASSIGN = f"""{_OVER}, pv AS (SELECT qname, CAST(coalesce(sum(overlap) FILTER (kind = 'exon'), 0) AS BIGINT) AS x, CAST(coalesce(sum(overlap) FILTER (kind = 'intron'), 0) AS BIGINT) AS i, CAST(coalesce(sum(overlap) FILTER (kind = 'intergenic'), 0) AS BIGINT) AS g FROM ov GROUP BY qname),
rf AS (SELECT qname, t_end - t_start AS length, x AS exon_bases, i AS intron_bases, g AS intergenic_bases, CASE WHEN 2 * x >= t_end - t_start THEN 'exon' WHEN 2 * i >= t_end - t_start THEN 'intron' WHEN 2 * g >= t_end - t_start THEN 'intergenic' WHEN x >= i AND x >= g THEN 'exon' WHEN i >= g THEN 'intron' ELSE 'intergenic' END AS feature
 FROM pv JOIN best USING (qname))"""

ORACLES = {
    "depth_segments": f"WITH {_SEG} SELECT chrom, s AS start_pos, e AS end_pos, depth FROM seg",
    "depth_hist_chrom": f"WITH {_HIST} SELECT chrom, depth, bases, CAST(sum(bases) OVER (PARTITION BY chrom) AS BIGINT) AS covered, chrom_length FROM h JOIN chrlens USING (chrom)",
    "depth_hist_total": f"WITH {_TOTAL} SELECT * FROM tot",
    "depth_line": f"WITH {_TOTAL}, p AS (SELECT depth, genome_length, bases, CAST(genome_length - covered + sum(bases) OVER (ORDER BY depth) AS BIGINT) AS hi FROM tot) SELECT depth, hi AS position, genome_length FROM p UNION ALL SELECT depth, hi - bases + 1, genome_length FROM p",
    "depth_strata": f"WITH {_TOTAL} SELECT depth, CAST(floor((sum(bases) OVER (ORDER BY depth DESC) - bases) / 100000) AS BIGINT) AS stratum FROM tot",
    "chrom_aligned_fraction": f"""WITH {_HIST}, c AS (SELECT chrom, CAST(coalesce(sum(bases), 0) AS BIGINT) AS covered, any_value(chrom_length) AS chrom_length FROM chrlens LEFT JOIN h USING (chrom) GROUP BY chrom),
a AS (SELECT * FROM c UNION ALL SELECT 'all', CAST(sum(covered) AS BIGINT), CAST(sum(chrom_length) AS BIGINT) FROM c) SELECT *, round(covered / chrom_length, 6) AS fraction, round(log2(greatest(covered / chrom_length, 1e-5)), 6) AS log2_fraction FROM a""",
    "depth_boxplot": f"WITH {_SEG}, p AS (SELECT chrom, depth FROM (SELECT chrom, depth, unnest(range(s, e)) FROM seg)) SELECT chrom, quantile_cont(depth, 0.25) AS q1, quantile_cont(depth, 0.5) AS median, quantile_cont(depth, 0.75) AS q3 FROM p GROUP BY chrom",
    "merged_ranges": f"WITH {sql.ALN}, {sql.SPANS}, {sql.merged('m', 'spans')} SELECT chrom, s AS start_pos, e AS end_pos FROM m",
    "features_partition": f"WITH {sql.FEATURES} SELECT chrom, s AS start_pos, e AS end_pos, kind FROM feat",
    "subtract_introns": f"WITH {sql.ALN}, {sql.SPANS}, {sql.EXONS}, {sql.merged('ms', 'spans')}, {sql.merged('mx', 'gx')}, {sql.subtracted('d', 'ms', 'mx')} SELECT chrom, s AS start_pos, e AS end_pos FROM d",
    "feature_sizes": f"WITH {sql.FEATURES} SELECT kind, CAST(sum(e - s) AS BIGINT) AS size, count(*) AS n FROM feat GROUP BY kind",
    "depth_by_feature": f"WITH {_PIECES} SELECT chrom, s AS start_pos, e AS end_pos, depth, kind FROM pc",
    "feature_depth_cumfrac": f"""WITH {_PIECES}, b AS (SELECT kind, depth, CAST(sum(e - s) AS BIGINT) AS bases FROM pc GROUP BY ALL), z AS (SELECT kind, CAST(sum(e - s) AS BIGINT) AS size FROM feat GROUP BY kind),
u AS (SELECT kind, depth, bases, CAST(size - sum(bases) OVER (PARTITION BY kind) + sum(bases) OVER (PARTITION BY kind ORDER BY depth) AS BIGINT) AS upto, size FROM b JOIN z USING (kind)) SELECT *, round(upto / size, 6) AS share FROM u""",
    "overlap_join_pairs": f"WITH {sql.ALN}, {sql.SPANS}, {sql.EXONS} SELECT aln_id, tx, CAST(exon_no AS INTEGER) AS exon_no, least(spans.e, gx.e) - greatest(spans.s, gx.s) AS overlap FROM spans JOIN gx ON spans.chrom = gx.chrom AND spans.s < gx.e AND gx.s < spans.e",
    "read_feature_overlap": f"WITH {_OVER} SELECT * FROM ov",
    "read_features": f"WITH {_ASSIGN} SELECT * FROM rf",
    "read_feature_hist_len": f"WITH {_ASSIGN} SELECT {sql.length_bin('length')} AS bin, feature, count(*) AS n FROM rf GROUP BY ALL",
    "weighted_depth": f"WITH a AS (SELECT DISTINCT * EXCLUDE (load_ts) REPLACE (upper(trim(gene, ' ' || chr(9))) AS gene, upper(trim(tx, ' ' || chr(9))) AS tx) FROM annotbest), {sql.EXONS}, wx AS (SELECT gx.chrom, s, e, n FROM gx JOIN (SELECT tx, count(*) AS n FROM a GROUP BY tx) AS c ON upper(gx.tx) = c.tx), {sql.depth('seg', 'wx', 'n')} SELECT chrom, s AS start_pos, e AS end_pos, depth FROM seg",
}
