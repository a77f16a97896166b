"""Queries on the alignments of each read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import paths, reads
from strandloom.plans import inputs, sql
from strandloom.session import table
from strandloom.sources import formats


def best_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.best_alignment(inputs.alignments(spark, sf_dir, "qname", "flag", "aligned_bases")).select("qname", "aln_id", "flag", "aligned_bases")


def primary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry counts of each read by kind: all, aligned, primary."""
    e = inputs.alignments(spark, sf_dir, "qname", "flag", "aligned_bases").filter("qname is not null")
    return e.groupBy("qname").agg(F.count("*").alias("n"), F.count_if(F.col("aligned_bases") > 0).alias("n_aligned"), F.count_if(F.col("flag").bitwiseAND(2304) == 0).alias("n_primary"))


def unaligned_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads without an aligned entry, with their longest length."""
    e = inputs.alignments(spark, sf_dir, "qname", "aligned_bases", "qlen").filter("qname is not null")
    return e.groupBy("qname").agg(F.count_if(F.col("aligned_bases") > 0).alias("n"), F.max("qlen").alias("qlen")).filter("n = 0").drop("n")


def read_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.resolve_paths(table(spark, sf_dir, "alndata"))


def path_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of every path with the read's type, as they go to the sink of that type."""
    p = read_paths(spark, sf_dir).select("qname", "read_type", F.posexplode("members").alias("place", "aln_id"))
    return p.join(inputs.alignments(spark, sf_dir, "chrom", "t_start", "t_end"), "aln_id")


def path_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_paths(spark, sf_dir).groupBy("read_type").agg(F.count("*").alias("n"), F.sum("total_bases").alias("bases"))


# The sets of alignments for a genome browser, with their colours.
BED_COLORS = {"best": "255,0,0", "chimera": "0,0,255", "gapped": "255,165,0", "self-chimera": "0,128,0", "self-chimera-atypical": "128,0,128"}


def bed12_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BED12 lines of the best alignments and of the members of paths by type, each set in its colour.

    The entries of the alignment table have one block each.
    """
    entries = inputs.alignments(spark, sf_dir, "qname", "flag", "aligned_bases", "chrom", "strand", "t_start", "t_end")
    members = read_paths(spark, sf_dir).filter(F.col("read_type").isin(*BED_COLORS)).select("read_type", F.explode("members").alias("aln_id"))
    both = reads.best_alignment(entries).withColumn("read_type", F.lit("best")).unionByName(entries.join(members, "aln_id"))
    rows = both.filter("t_start < t_end").select("read_type", F.col("qname").alias("gene"), F.col("qname").alias("tx"), "chrom", "strand", F.struct("t_start", "t_end").alias("x"))
    text = lambda c: F.concat(F.col(f"x.{c}").cast("string"), F.lit(","))
    lists = rows.select("*", F.col("x.t_start").alias("tx_start"), F.col("x.t_end").alias("tx_end"), F.col("x.t_start").alias("cds_start"), F.col("x.t_end").alias("cds_end"), F.lit(1).alias("exon_count"), text("t_start").alias("exon_starts"), text("t_end").alias("exon_ends"))
    color = F.element_at(F.create_map(*[F.lit(v) for kv in BED_COLORS.items() for v in kv]), F.col("read_type"))
    return formats.to_bed12(lists, color, ["read_type"])


QUERIES = (best_alignment, primary_entries, unaligned_reads, read_paths, path_members, path_type_counts, bed12_sets)

# Entries in order of their query end, each read's best sets of its first i entries as a list; all of a read's
# entries lie within the largest query gap in the given tables, so that the SQL needs no limit on it.
_PATHS = f"""RECURSIVE {sql.ALN}, {sql.BEST}, al AS (SELECT qname, count(*) AS n FROM aln WHERE aligned_bases > 0 GROUP BY qname), ql AS (SELECT qname, max(qlen) AS qlen FROM aln WHERE qname IS NOT NULL GROUP BY qname),
ft AS (SELECT a.*, a.q_end - a.q_start <= 10 AS short FROM aln a JOIN best b USING (qname) WHERE a.aln_id <> b.aln_id AND a.aligned_bases >= 50 AND b.aligned_bases >= 50 AND least(a.q_end, b.q_end) - greatest(a.q_start, b.q_start) <= 10),
lo AS (SELECT qname, q_start, q_end, max(aligned_bases) AS w, arg_max(aln_id, aligned_bases * 1000000000 - aln_id) AS id FROM ft WHERE NOT short GROUP BY ALL),
nu AS (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY q_end, q_start) AS i FROM lo),
pr AS (SELECT a.qname, a.i, a.w, a.id, (SELECT count(*) FROM nu b WHERE b.qname = a.qname AND b.q_end <= a.q_start + 10) AS j FROM nu a),
dp AS (SELECT qname, CAST(0 AS BIGINT) AS i, [{{'b': CAST(0 AS BIGINT), 'c': CAST(0 AS BIGINT), 'ids': CAST([] AS BIGINT[])}}] AS t FROM nu GROUP BY qname
 UNION ALL SELECT qname, dp.i + 1, list_append(t, least(t[dp.i + 1], {{'b': t[j + 1].b - w, 'c': t[j + 1].c + 1, 'ids': list_sort(list_append(t[j + 1].ids, id))}})) FROM dp JOIN pr USING (qname) WHERE pr.i = dp.i + 1),
ch AS (SELECT qname, unnest(t[i + 1].ids) AS aln_id FROM dp QUALIFY row_number() OVER (PARTITION BY qname ORDER BY i DESC) = 1),
pm AS (SELECT DISTINCT ft.* EXCLUDE (short) FROM ft LEFT JOIN ch USING (qname, aln_id) WHERE short OR ch.aln_id IS NOT NULL), me AS (SELECT * FROM pm UNION ALL SELECT * FROM best),
pp AS (SELECT x.qname, x.q_start AS xs, x.aln_id AS xi, y.q_start AS ys, y.aln_id AS yi, x.strand <> y.strand AS turned, x.chrom <> y.chrom AS away, least(x.t_end, y.t_end) - greatest(x.t_start, y.t_start) AS o FROM me x JOIN me y ON x.qname = y.qname AND (x.q_start, x.aln_id) < (y.q_start, y.aln_id)),
nf AS (SELECT qname, arg_min(turned, (xs, xi, ys, yi)) FILTER (NOT away AND o > 10) AS turned, bool_or(away) AS two, bool_or(away OR -o > 500000) AS far FROM pp GROUP BY qname),
sp AS (SELECT qname, sum(greatest(0, q_end - greatest(upto, q_start))) AS total, list(aln_id ORDER BY q_start, aln_id) AS members FROM (SELECT *, coalesce(max(q_end) OVER (PARTITION BY qname ORDER BY q_start, aln_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS upto FROM me) GROUP BY qname),
rp AS (SELECT qname, CASE WHEN al.n IS NULL THEN 'unaligned' WHEN nf.qname IS NULL THEN 'original' WHEN turned AND NOT two THEN 'self-chimera' WHEN turned IS NOT NULL THEN 'self-chimera-atypical' WHEN far THEN 'chimera' ELSE 'gapped' END AS read_type,
 CAST(CASE WHEN al.n IS NULL THEN 0 WHEN al.n = 1 THEN best.aligned_bases ELSE best.q_end - best.q_start END AS BIGINT) AS single_bases,
 CAST(CASE WHEN al.n IS NULL THEN 0 WHEN al.n = 1 THEN best.aligned_bases WHEN nf.qname IS NOT NULL THEN total ELSE best.q_end - best.q_start END AS BIGINT) AS total_bases, ql.qlen, CASE WHEN al.n IS NULL THEN CAST([] AS BIGINT[]) ELSE members END AS members
 FROM ql LEFT JOIN al USING (qname) LEFT JOIN best USING (qname) LEFT JOIN nf USING (qname) LEFT JOIN sp USING (qname))"""

ORACLES = {
    "read_paths": f"WITH {_PATHS} SELECT * FROM rp",
    "path_members": f"WITH {_PATHS}, mm AS (SELECT qname, read_type, unnest(members) AS aln_id, CAST(unnest(range(len(members))) AS INTEGER) AS place FROM rp) SELECT aln_id, mm.qname, read_type, place, chrom, t_start, t_end FROM mm JOIN aln USING (aln_id)",
    "path_type_counts": f"WITH {_PATHS} SELECT read_type, count(*) AS n, CAST(sum(total_bases) AS BIGINT) AS bases FROM rp GROUP BY read_type",
    "bed12_sets": f"""WITH {_PATHS}, mm AS (SELECT read_type, unnest(members) AS aln_id FROM rp WHERE read_type NOT IN ('unaligned', 'original')), bs AS (SELECT 'best' AS read_type, aln_id, qname, chrom, strand, t_start, t_end FROM best UNION ALL
SELECT read_type, aln_id, qname, chrom, strand, t_start, t_end FROM mm JOIN aln USING (aln_id))
SELECT read_type, chrom, t_start AS start_pos, t_end AS end_pos, qname AS name, CAST(1000 AS INTEGER) AS score, strand, t_start AS thick_start, t_end AS thick_end, CASE read_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in BED_COLORS.items())} END AS color,
 CAST(1 AS INTEGER) AS block_count, (t_end - t_start) || ',' AS block_sizes, '0,' AS block_starts FROM bs WHERE t_start < t_end""",
    "best_alignment": f"WITH {sql.ALN}, {sql.BEST} SELECT qname, aln_id, flag, aligned_bases FROM best",
    "primary_entries": f"WITH {sql.ALN} SELECT qname, count(*) AS n, count(*) FILTER (aligned_bases > 0) AS n_aligned, count(*) FILTER ((flag & 2304) = 0) AS n_primary FROM aln WHERE qname IS NOT NULL GROUP BY qname",
    "unaligned_reads": f"WITH {sql.ALN} SELECT qname, max(qlen) AS qlen FROM aln WHERE qname IS NOT NULL GROUP BY qname HAVING count(*) FILTER (aligned_bases > 0) = 0",
}
