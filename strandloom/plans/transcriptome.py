"""Annotation of multi-exon reads, junctions, loci, bias and error profiles over the derived views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import annotate, bias, coverage, errors, intervals, junctions, loci, novel, reads, sampling, stats
from strandloom.plans import fixtures, sql
from strandloom.session import materialize
from strandloom.sources import formats

#: Tile of the exon joins: a few exons long on these coordinates.
TILE = 512
#: Tile of the join of read exons with features, which may be as long as a chromosome.
FEATURE_TILE = 1 << 14
MIN_DEPTH = 2
CONTEXT_SEEN = 5_000


def best_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.best_transcript(fixtures.read_exons(spark, sf_dir), fixtures.exons(spark, sf_dir), TILE)


def exon_read_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature of each multi-exon read by the share of its exons' bases."""
    exons, read_exons = fixtures.exons(spark, sf_dir), fixtures.read_exons(spark, sf_dir)
    tx = exons.groupBy("tx", "chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    ends = exons.select("chrom", "end").unionByName(read_exons.select("chrom", "end"))
    genome = ends.groupBy("chrom").agg(F.lit(0).cast("long").alias("start"), F.max("end").alias("end"))
    features = intervals.layers({"exon": exons, "intron": tx, "intergenic": genome}, ["chrom"]).withColumnsRenamed({"start": "r_start", "end": "r_end"})
    sizes = fixtures.reads(spark, sf_dir).select(F.col("read_name").alias("qname"), F.col("read_length").alias("length"), "exon_count")
    overlap = coverage.overlap_of(read_exons.select(F.col("read_name").alias("qname"), "chrom", "start", "end"), "qname", features, "kind", FEATURE_TILE)
    return reads.assign_feature(overlap, sizes.drop("exon_count")).join(sizes.select("qname", "exon_count"), "qname")


def read_feature_hist_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(exon_read_features(spark, sf_dir), "length", "exon_count", "feature")


def junction_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return junctions.distances(fixtures.read_exons(spark, sf_dir), fixtures.exons(spark, sf_dir))


def junvar_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return junctions.variance_rollup(junction_distances(spark, sf_dir))


def nr_isoforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return junctions.nonredundant(fixtures.read_exons(spark, sf_dir)).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


def _span_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads in the loci of their spans, as the reference clusters them before it drops any."""
    return loci.locus_reads(fixtures.reads(spark, sf_dir))


def _deep_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once, as clusters and components read them several times."""
    return materialize(loci.deep_reads(fixtures.reads(spark, sf_dir), "read_name"), "deep")


def _locus_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loci.locus_reads(_deep_reads(spark, sf_dir))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("locus", "chrom", "locus_start", "locus_end").agg(F.count("*").alias("n_reads"))


def locus_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _locus_reads(spark, sf_dir).select("read_name", "locus")


def loci_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_locus_reads(spark, sf_dir))


def novel_loci_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loci under names made of their number, read count and range."""
    return _counted(_span_reads(spark, sf_dir)).select(F.expr("concat('LOC', locus, '|', n_reads, '|', chrom, ':', locus_start, '-', locus_end)").alias("name"))


def locus_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loci.depth_statistics(fixtures.reads(spark, sf_dir), "read_name", MIN_DEPTH)


def locus_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each set of reads that exons link; a set is named by its smallest read."""
    kept = _deep_reads(spark, sf_dir).select("read_name")
    rows = loci.exon_components(fixtures.read_exons(spark, sf_dir).join(kept, "read_name", "left_semi"), "read_name")
    return rows.groupBy("component").agg(F.min("read_name").alias("first_read"), F.count("*").alias("n_reads")).drop("component")


def bias_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = best_annotation(spark, sf_dir)
    return bias.bias_bins(fixtures.read_exons(spark, sf_dir), fixtures.exons(spark, sf_dir), a)


def bias_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles over transcripts of each bin."""
    q = bias_bins(spark, sf_dir).groupBy("bin").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select("bin", *[F.round(F.col("q")[i], 5).alias(n) for i, n in enumerate(("q1", "median", "q3"))])


def bias_bins_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bias of reads within their transcript, without the transcripts' uncovered ends."""
    a = best_annotation(spark, sf_dir)
    return bias.bias_bins(fixtures.read_exons(spark, sf_dir), fixtures.exons(spark, sf_dir), a, covered_ends=True, overflow=False)


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select(F.expr("cast(substr(read_name, 2) as bigint)").alias("read"), "locus")


def rarefaction_locus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curve over all reads; those in no locus are draws that find nothing."""
    every = fixtures.reads(spark, sf_dir).select("read_name").join(locus_reads(spark, sf_dir), "read_name", "left")
    return sampling.rarefaction(materialize(_keyed(every), "draws"), "read", "locus", 10)


def locus_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 100 reads of each locus."""
    return sampling.downsample_groups(_keyed(_span_reads(spark, sf_dir)), ["locus"], "read", 100)


def context_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments in draw order until every target context has been seen 5,000 times; all, where one never is."""
    w = errors.contexts_per_alignment(fixtures.pairs(spark, sf_dir))
    return sampling.until_every_value(w, "aln_id", "context", "n", CONTEXT_SEEN)


def novel_isoforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh, _ = novel.novel_transcriptome(fixtures.read_exons(spark, sf_dir), fixtures.exons(spark, sf_dir), TILE)
    return fresh.withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


def novel_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = novel.novel_transcriptome(fixtures.read_exons(spark, sf_dir), fixtures.exons(spark, sf_dir), TILE)
    return found.withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


def error_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.error_matrix(fixtures.pairs(spark, sf_dir))


def error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.error_stats(fixtures.pairs(spark, sf_dir))


def error_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.error_ratios(error_stats(spark, sf_dir))


def context_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.context_errors(fixtures.pairs(spark, sf_dir))


def context_errors_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a base read between two others stands for."""
    return errors.context_errors(fixtures.pairs(spark, sf_dir), "query")


def least_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.least_context(errors.context_errors(fixtures.pairs(spark, sf_dir)))


def exon_merge_by_strand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged exons of the derived transcripts, kept apart by strand."""
    return intervals.merge(fixtures.exons(spark, sf_dir), ["chrom", "strand"], TILE).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


def bed12_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.to_bed12(formats.to_genepred(fixtures.read_exons(spark, sf_dir).withColumn("gene", F.col("read_name")), "read_name"))


def genepred_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.from_bed12(bed12_export(spark, sf_dir))


QUERIES = (
    best_annotation, exon_read_features, read_feature_hist_exons, junction_distances, junvar_rollup, nr_isoforms, locus_reads, loci_counts, novel_loci_named, locus_coverage, locus_components, bias_bins, bias_box, bias_bins_trimmed, rarefaction_locus, locus_downsample, context_sample, novel_isoforms, novel_loci, error_matrix, error_stats, error_ratios,
    context_errors, context_errors_query, least_context, exon_merge_by_strand, bed12_export, genepred_roundtrip,
)

_BOTH = f"{fixtures.EXONS}, {fixtures.READ_EXONS}"


def _best(reads: str, exons: str, p: str = "") -> str:
    """CTEs that end in ``p``ba: the best of the transcripts ``exons`` for each of the ``reads``."""
    return f"""{p}hit AS (SELECT r.read_name, x.gene, x.tx, x.exon_no, sum(least(r.e, x.e) - greatest(r.s, x.s)) AS ov FROM {reads} r JOIN {exons} x ON r.chrom = x.chrom AND r.s < x.e AND x.s < r.e AND r.s < r.e AND x.s < x.e GROUP BY ALL),
{p}run AS (SELECT read_name, gene, tx, count(*) AS n, sum(ov) AS ov FROM (SELECT *, exon_no - row_number() OVER (PARTITION BY read_name, tx ORDER BY exon_no) AS g FROM {p}hit) GROUP BY read_name, gene, tx, g),
{p}pr AS (SELECT read_name, gene, tx, CAST(sum(n) AS BIGINT) AS matching_exon_count, max(n) AS consecutive_exons, CAST(sum(ov) AS BIGINT) AS overlap_bases FROM {p}run GROUP BY ALL),
{p}ts AS (SELECT tx, count(*) AS tx_exons, CAST(sum(e - s) AS BIGINT) AS tx_length FROM {exons} GROUP BY tx), {p}rs AS (SELECT read_name, count(*) AS read_exons, CAST(sum(e - s) AS BIGINT) AS read_length FROM {reads} GROUP BY read_name),
{p}ba AS (SELECT *, CASE WHEN consecutive_exons = tx_exons THEN 'full' ELSE 'partial' END AS match_type FROM {p}pr JOIN {p}ts USING (tx) JOIN {p}rs USING (read_name)
 QUALIFY row_number() OVER (PARTITION BY read_name ORDER BY match_type, matching_exon_count DESC, overlap_bases DESC, tx_length, tx) = 1)"""


_BEST = f"{_BOTH}, {_best('v_read_exons', 'v_exons')}"


def _classed(reads: str, exons: str, p: str) -> str:
    """CTEs that end in ``p``cl: the class of each of the ``reads`` of two exons or more, and its gene."""
    return f"""{_best(reads, exons, p)}, {p}cl AS (SELECT read_name, gene, CASE WHEN match_type = 'full' THEN 'full' WHEN consecutive_exons = read_exons THEN 'subset' ELSE 'novel-isoform' END AS class FROM {p}ba WHERE read_exons >= 2
 UNION ALL SELECT read_name, NULL, 'novel-locus' FROM {p}rs WHERE read_exons >= 2 AND read_name NOT IN (SELECT read_name FROM {p}ba))"""


def _sides(name: str, source: str, key: str) -> str:
    return f"""{name}0 AS (SELECT {key} AS id, chrom, s, e, min(s) OVER w AS lo, max(e) OVER w AS hi FROM {source} WINDOW w AS (PARTITION BY {key})), {name} AS (SELECT id, chrom, 'start' AS side, s AS pos FROM {name}0 WHERE s > lo UNION ALL SELECT id, chrom, 'end', e FROM {name}0 WHERE e < hi)"""


_JUNC = f"""{_BOTH}, {_sides("rj", "v_read_exons", "read_name")}, {_sides("xj", "v_exons", "tx")}, site AS (SELECT DISTINCT chrom, side, pos AS site FROM xj),
nr AS (SELECT chrom, side, pos, arg_min(site, abs(pos - site) * 1000000000 + site) AS site FROM (SELECT DISTINCT chrom, side, pos FROM rj) JOIN site USING (chrom, side) WHERE abs(pos - site) <= 30 GROUP BY ALL),
jd AS (SELECT CASE WHEN side = 'start' THEN site - pos ELSE pos - site END AS distance, count(*) AS n FROM rj JOIN nr USING (chrom, side, pos) GROUP BY 1)"""


def _isoforms(reads: str, p: str = "") -> str:
    """CTEs that end in ``p``rc, the chains of the ``reads``, and ``p``nr, their isoforms."""
    return f"""{_sides(p + "rj", reads, "read_name")}, {p}ct AS (SELECT chrom, side, pos, count(*) AS n FROM {p}rj GROUP BY ALL),
{p}sn AS (SELECT a.chrom, a.side, a.pos, arg_max(b.pos, b.n * 1000000000 - b.pos) AS goal FROM {p}ct a JOIN {p}ct b ON a.chrom = b.chrom AND a.side = b.side AND abs(a.pos - b.pos) <= 10 GROUP BY ALL),
{p}ch AS (SELECT id AS read_name, string_agg(CAST(goal AS VARCHAR), ',' ORDER BY goal, side) AS chain FROM {p}rj JOIN {p}sn USING (chrom, side, pos) GROUP BY id),
{p}rc AS (SELECT read_name, chrom, strand, chain, s, e FROM (SELECT read_name, chrom, strand, min(s) AS s, max(e) AS e FROM {reads} GROUP BY ALL) JOIN {p}ch USING (read_name)),
{p}nr AS (SELECT chrom, strand, chain, list_sort(list(s))[2] AS s, list_reverse_sort(list(e))[2] AS e, count(*) AS n_reads FROM {p}rc GROUP BY ALL HAVING count(*) >= 2)"""


def _with_genes(p: str, genes: str) -> str:
    """CTEs that end in ``p``ng and ``p``nx: the isoforms with the gene of most of their reads, and their exons."""
    return f"""{p}gc AS (SELECT chrom, strand, chain, gene, count(*) AS n FROM {p}rc JOIN {genes} USING (read_name) WHERE gene IS NOT NULL GROUP BY ALL),
{p}ng AS (SELECT {p}nr.*, gene, concat_ws(':', chrom, strand, chain) AS tx FROM {p}nr LEFT JOIN (SELECT * FROM {p}gc QUALIFY row_number() OVER (PARTITION BY chrom, strand, chain ORDER BY n DESC, gene) = 1) USING (chrom, strand, chain)),
{p}nb AS (SELECT *, list_concat([s], list_transform(string_split(chain, ','), lambda x: CAST(x AS BIGINT)), [e]) AS b FROM {p}ng),
{p}nx AS (SELECT tx AS read_name, tx, gene, chrom, strand, i AS exon_no, b[2 * i + 1] AS s, b[2 * i + 2] AS e FROM (SELECT *, unnest(range(len(b) // 2)) AS i FROM {p}nb))"""


_NR = f"{fixtures.READ_EXONS}, {_isoforms('v_read_exons')}"
_NOVEL = f"""{_BOTH}, {_classed("v_read_exons", "v_exons", "a")}, ir AS (SELECT * FROM v_read_exons WHERE read_name IN (SELECT read_name FROM acl WHERE class = 'novel-isoform')), lr AS (SELECT * FROM v_read_exons WHERE read_name IN (SELECT read_name FROM acl WHERE class = 'novel-locus')),
{_isoforms("ir", "d")}, {_with_genes("d", "acl")}, {_classed("lr", "dnx", "b")}, mr AS (SELECT * FROM ir UNION ALL SELECT * FROM lr WHERE read_name IN (SELECT read_name FROM bcl WHERE class = 'novel-isoform')),
gn AS (SELECT read_name, gene FROM acl WHERE class = 'novel-isoform' UNION ALL SELECT read_name, gene FROM bcl WHERE class = 'novel-isoform'), {_isoforms("mr", "f")}, {_with_genes("f", "gn")}, {_classed("fnx", "v_exons", "k")},
lo AS (SELECT read_name, chrom, min(s) AS s, max(e) AS e FROM lr WHERE read_name IN (SELECT read_name FROM bcl WHERE class = 'novel-locus') GROUP BY ALL)"""
_VIEWS = f"{fixtures.READ_EXONS}, {fixtures.READS}"
#: The reads that loci are made of: two exons, and depth enough over their span.
_DEEP = f"""mr AS (SELECT * FROM v_reads WHERE exon_count >= 2), {sql.depth("seg", "mr")},
kr AS (SELECT * FROM mr WHERE read_name IN (SELECT read_name FROM (SELECT mr.read_name, mr.e - mr.s AS n, depth, least(mr.e, seg.e) - greatest(mr.s, seg.s) AS w FROM mr JOIN seg ON mr.chrom = seg.chrom AND mr.s < seg.e AND seg.s < mr.e)
 GROUP BY read_name HAVING sum(depth * w) / any_value(n) >= 1.5 AND coalesce(sum(w) FILTER (depth >= 1.5), 0) / any_value(n) >= 0.8))"""


def _loci(source: str) -> str:
    return f"""lg AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e, read_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM {source}),
li AS (SELECT *, sum(CASE WHEN pm >= s THEN 0 ELSE 1 END) OVER (ORDER BY chrom, s, e, read_name ROWS UNBOUNDED PRECEDING) AS locus FROM lg),
lc AS (SELECT CAST(locus AS BIGINT) AS locus, chrom, min(s) AS locus_start, max(e) AS locus_end, count(*) AS n_reads FROM li GROUP BY ALL)"""


_SPAN_LOCI, _DEEP_LOCI = f"{_VIEWS}, {_loci('v_reads')}", f"{_VIEWS}, {_DEEP}, {_loci('kr')}"
_COMPONENTS = f"""RECURSIVE {_VIEWS}, {_DEEP}, kx AS (SELECT read_name, chrom, s, e FROM v_read_exons WHERE read_name IN (SELECT read_name FROM kr)), {sql.merged("mi", "kx")},
mj AS (SELECT *, row_number() OVER (ORDER BY chrom, s) AS island FROM mi), lk AS (SELECT DISTINCT read_name, island FROM kx JOIN mj ON kx.chrom = mj.chrom AND kx.s >= mj.s AND kx.e <= mj.e),
ed AS (SELECT DISTINCT a.island AS a, b.island AS b FROM lk a JOIN lk b USING (read_name)), reach AS (SELECT a, b FROM ed UNION SELECT reach.a, ed.b FROM reach JOIN ed ON reach.b = ed.a),
co AS (SELECT a AS island, min(b) AS component FROM reach GROUP BY a), cr AS (SELECT DISTINCT read_name, component FROM lk JOIN co USING (island))"""
_BIAS = f"""{_BEST}, gd AS (SELECT read_name, tx FROM ba WHERE matching_exon_count >= 2 AND read_length >= 100), cn AS (SELECT tx, count(*) AS reads FROM gd GROUP BY tx HAVING count(*) >= 5),
px AS (SELECT tx, strand, s, e, sum(e - s) OVER (PARTITION BY tx ORDER BY s) - (e - s) AS off, sum(e - s) OVER (PARTITION BY tx) AS len FROM v_exons),
pb AS (SELECT px.tx, px.strand, len, off + unnest(range(greatest(r.s, px.s) - px.s, least(r.e, px.e) - px.s)) AS p FROM v_read_exons r JOIN gd USING (read_name) JOIN cn ON gd.tx = cn.tx JOIN px ON px.tx = gd.tx AND r.s < px.e AND px.s < r.e),
pd AS (SELECT tx, 1 + (100 * CASE WHEN strand = '-' THEN len - 1 - p ELSE p END) // len AS bin, count(*) AS n FROM pb GROUP BY ALL),
ev AS (SELECT tx, reads, len, unnest(range(1, 101)) AS bin FROM cn JOIN (SELECT DISTINCT tx, len FROM px) USING (tx)),
bb AS (SELECT tx, bin, round(coalesce(n / (((bin * len + 99) // 100 - ((bin - 1) * len + 99) // 100) * reads), 0), 6) AS value FROM ev LEFT JOIN pd USING (tx, bin))"""
_ERR = f"""{fixtures.PAIRS}, nb AS (SELECT *, lag(target) OVER w AS tb, lead(target) OVER w AS ta, lag(query) OVER w AS qb, lead(query) OVER w AS qa FROM v_pairs WINDOW w AS (PARTITION BY aln_id ORDER BY pos)),
er AS (SELECT count(DISTINCT aln_id) AS a, count(*) AS b, count(*) FILTER (target <> '-' AND query <> '-' AND target <> query) AS mm, count(*) FILTER (query = '-') AS d, count(*) FILTER (target = '-') AS i,
 count(*) FILTER (query = '-' AND (target = tb OR target = ta)) AS hd, count(*) FILTER (target = '-' AND (query = qb OR query = qa)) AS hi FROM nb),
cx AS (SELECT tb AS before, ta AS after, target AS reference, query, count(*) AS n FROM nb WHERE target <> '-' AND tb <> '-' AND ta <> '-' GROUP BY ALL)"""
_BED = f"""{fixtures.READ_EXONS}, bx AS (SELECT read_name, chrom, strand, min(s) AS lo, max(e) AS hi, count(*) AS c, string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) || ',' AS st, string_agg(CAST(e AS VARCHAR), ',' ORDER BY s) || ',' AS en FROM v_read_exons GROUP BY read_name, chrom, strand),
bo AS (SELECT v.read_name, string_agg(CAST(e - s AS VARCHAR), ',' ORDER BY s) || ',' AS sizes, string_agg(CAST(s - lo AS VARCHAR), ',' ORDER BY s) || ',' AS starts FROM v_read_exons v JOIN bx ON v.read_name = bx.read_name GROUP BY v.read_name)"""

_TRIM = f"""{_BEST}, rr AS (SELECT read_name, min(s) AS rs, max(e) AS re FROM v_read_exons GROUP BY read_name), tt AS (SELECT tx, min(s) AS ts, max(e) AS te FROM v_exons GROUP BY tx),
gd AS (SELECT read_name, tx FROM ba JOIN rr USING (read_name) JOIN tt USING (tx) WHERE matching_exon_count >= 2 AND read_length >= 100 AND rs >= ts AND re <= te), cn AS (SELECT tx, count(*) AS reads FROM gd GROUP BY tx HAVING count(*) >= 5),
px AS (SELECT tx, strand, s, e, sum(e - s) OVER (PARTITION BY tx ORDER BY s) - (e - s) AS off, sum(e - s) OVER (PARTITION BY tx) AS len FROM v_exons),
p0 AS (SELECT px.tx, px.strand, len, off + unnest(range(greatest(r.s, px.s) - px.s, least(r.e, px.e) - px.s)) AS p FROM v_read_exons r JOIN gd USING (read_name) JOIN cn ON gd.tx = cn.tx JOIN px ON px.tx = gd.tx AND r.s < px.e AND px.s < r.e),
p1 AS (SELECT tx, CASE WHEN strand = '-' THEN len - 1 - p ELSE p END AS p FROM p0), le AS (SELECT tx, min(p) AS lo, max(p) + 1 - min(p) AS len FROM p1 GROUP BY tx),
pd AS (SELECT tx, 1 + (100 * (p - lo)) // len AS bin, count(*) AS n FROM p1 JOIN le USING (tx) GROUP BY ALL), ev AS (SELECT tx, reads, len, unnest(range(1, 101)) AS bin FROM cn JOIN le USING (tx))
SELECT tx, bin, round(coalesce(n / nullif(((bin * len + 99) // 100 - ((bin - 1) * len + 99) // 100) * reads, 0), 0), 6) AS value FROM ev LEFT JOIN pd USING (tx, bin)"""

_XF = f"""{_BOTH}, {fixtures.READS}, vt AS (SELECT chrom, min(s) AS s, max(e) AS e FROM v_exons GROUP BY tx, chrom), ge AS (SELECT chrom, CAST(0 AS BIGINT) AS s, max(e) AS e FROM (SELECT chrom, e FROM v_exons UNION ALL SELECT chrom, e FROM v_read_exons) GROUP BY chrom),
{sql.merged("mx", "v_exons")}, {sql.merged("mt", "vt")}, {sql.subtracted("intr", "mt", "mx")}, {sql.subtracted("inter", "ge", "mt")}, feat AS (SELECT *, 'exon' AS kind FROM mx UNION ALL SELECT *, 'intron' FROM intr UNION ALL SELECT *, 'intergenic' FROM inter),
ov AS (SELECT read_name, kind, sum(least(r.e, f.e) - greatest(r.s, f.s)) AS o FROM v_read_exons r JOIN feat f ON r.chrom = f.chrom AND r.s < f.e AND f.s < r.e GROUP BY ALL),
pv AS (SELECT read_name, CAST(coalesce(sum(o) FILTER (kind = 'exon'), 0) AS BIGINT) AS x, CAST(coalesce(sum(o) FILTER (kind = 'intron'), 0) AS BIGINT) AS i, CAST(coalesce(sum(o) FILTER (kind = 'intergenic'), 0) AS BIGINT) AS g FROM ov GROUP BY read_name),
xf AS (SELECT read_name AS qname, read_length AS length, x AS exon_bases, i AS intron_bases, g AS intergenic_bases, CASE WHEN 2 * x >= read_length THEN 'exon' WHEN 2 * i >= read_length THEN 'intron' WHEN 2 * g >= read_length THEN 'intergenic'
 WHEN x >= i AND x >= g THEN 'exon' WHEN i >= g THEN 'intron' ELSE 'intergenic' END AS feature, exon_count FROM pv JOIN v_reads USING (read_name))"""

_KEYED = f"{_SPAN_LOCI}, kl AS (SELECT CAST(substr(read_name, 2) AS BIGINT) AS read, CAST(locus AS BIGINT) AS locus FROM li)"

ORACLES = {
    "exon_read_features": f"WITH {_XF} SELECT * FROM xf",
    "read_feature_hist_exons": f"""WITH {_XF} SELECT 'length' AS axis, {sql.length_bin('length')} AS bin, feature, count(*) AS n FROM xf GROUP BY ALL UNION ALL
SELECT 'exons', CASE WHEN exon_count > 20 THEN '>20' ELSE CAST(exon_count AS VARCHAR) END AS bin, feature, count(*) AS n FROM xf GROUP BY ALL""",
    "bias_bins_trimmed": f"WITH {_TRIM}",
    "locus_downsample": f"WITH {_KEYED} SELECT read, locus FROM kl QUALIFY row_number() OVER (PARTITION BY locus ORDER BY {sql.mix('read', '0')}, read) <= 100",
    "rarefaction_locus": f"WITH {_DEEP_LOCI}, kl AS (SELECT CAST(substr(read_name, 2) AS BIGINT) AS read, CAST(locus AS BIGINT) AS locus FROM v_reads LEFT JOIN (SELECT read_name, locus FROM li) USING (read_name)), {sql.rarefaction('kl', 'read', 'locus', 10, 1)}",
    "context_sample": f"""WITH {_ERR}, ca AS (SELECT aln_id, tb || target || ta AS context, count(*) AS n FROM nb WHERE target <> '-' AND tb <> '-' AND ta <> '-' GROUP BY ALL),
rk AS (SELECT aln_id, row_number() OVER (ORDER BY {sql.mix('aln_id', '0')}, aln_id) AS rank FROM (SELECT DISTINCT aln_id FROM ca)), cu AS (SELECT context, rank, sum(n) OVER (PARTITION BY context ORDER BY rank) AS upto FROM ca JOIN rk USING (aln_id)),
st AS (SELECT context, min(rank) FILTER (upto >= {CONTEXT_SEEN}) AS stop FROM cu GROUP BY context) SELECT aln_id, rank FROM rk WHERE rank <= (SELECT CASE WHEN count(*) = count(stop) THEN max(stop) ELSE 4611686018427387904 END FROM st)""",
    "best_annotation": f"WITH {_BEST} SELECT * FROM ba",
    "junction_distances": f"WITH {_JUNC} SELECT * FROM jd",
    "junvar_rollup": f"WITH {_JUNC} SELECT CAST(coalesce(sum(n) FILTER (distance < 0), 0) AS BIGINT) AS truncated, CAST(coalesce(sum(n) FILTER (distance = 0), 0) AS BIGINT) AS perfect, CAST(coalesce(sum(n) FILTER (distance > 0), 0) AS BIGINT) AS elongated FROM jd",
    "locus_components": f"WITH {_COMPONENTS} SELECT min(read_name) AS first_read, count(*) AS n_reads FROM cr GROUP BY component",
    "nr_isoforms": f"WITH {_NR} SELECT chrom, strand, chain, s AS start_pos, e AS end_pos, n_reads FROM nr",
    "novel_isoforms": f"WITH {_NOVEL} SELECT gene, chrom, strand, chain, s AS start_pos, e AS end_pos, n_reads FROM fng WHERE tx NOT IN (SELECT read_name FROM kcl WHERE class IN ('full', 'subset'))",
    "novel_loci": f"WITH {_NOVEL}, {_loci('lo')} SELECT 'LOC' || locus || '|' || n_reads || '|' || chrom || ':' || locus_start || '-' || locus_end AS name, chrom, locus_start AS start_pos, locus_end AS end_pos, n_reads FROM lc",
    "locus_reads": f"WITH {_DEEP_LOCI} SELECT read_name, CAST(locus AS BIGINT) AS locus FROM li",
    "loci_counts": f"WITH {_DEEP_LOCI} SELECT * FROM lc",
    "novel_loci_named": f"WITH {_SPAN_LOCI} SELECT 'LOC' || locus || '|' || n_reads || '|' || chrom || ':' || locus_start || '-' || locus_end AS name FROM lc",
    "locus_coverage": f"""WITH {fixtures.READ_EXONS}, {fixtures.READS}, {sql.depth("seg", "v_reads")}, o AS (SELECT read_name, depth, least(v_reads.e, seg.e) - greatest(v_reads.s, seg.s) AS w, v_reads.e - v_reads.s AS n FROM v_reads JOIN seg ON v_reads.chrom = seg.chrom AND v_reads.s < seg.e AND seg.s < v_reads.e)
SELECT read_name, round(sum(depth * w) / any_value(n), 6) AS average_depth, round(coalesce(sum(w) FILTER (depth >= {MIN_DEPTH}), 0) / any_value(n), 6) AS covered_share FROM o GROUP BY read_name""",
    "bias_bins": f"WITH {_BIAS} SELECT * FROM bb",
    "bias_box": f"WITH {_BIAS} SELECT bin, round(quantile_cont(value, 0.25), 5) AS q1, round(quantile_cont(value, 0.5), 5) AS median, round(quantile_cont(value, 0.75), 5) AS q3 FROM bb GROUP BY bin",
    "error_matrix": f"WITH {fixtures.PAIRS}, t AS (SELECT count(*) AS total FROM v_pairs) SELECT target, query, count(*) AS n, any_value(total) AS total, round(count(*) / any_value(total), 6) AS rate FROM v_pairs, t GROUP BY target, query",
    "error_stats": f"WITH {_ERR} SELECT a AS ALIGNMENT_COUNT, b AS ALIGNMENT_BASES, mm + d + i AS ANY_ERROR, mm AS MISMATCHES, d AS ANY_DELETION, d - hd AS COMPLETE_DELETION, hd AS HOMOPOLYMER_DELETION, i AS ANY_INSERTION, i - hi AS COMPLETE_INSERTION, hi AS HOMOPOLYMER_INSERTION FROM er",
    "error_ratios": f"WITH {_ERR} SELECT round((mm + d + i) / b, 6) AS any_error, round(mm / b, 6) AS mismatches, round(d / b, 6) AS deletions, round(hd / d, 6) AS homopolymer_deletions, round(i / b, 6) AS insertions, round(hi / i, 6) AS homopolymer_insertions FROM er",
    "context_errors": f"WITH {_ERR} SELECT before, after, reference, query, n, round(n / sum(n) OVER (PARTITION BY before, after, reference), 6) AS rate FROM cx",
    "context_errors_query": f"WITH {_ERR}, cq AS (SELECT qb AS before, qa AS after, query AS reference, target AS query, count(*) AS n FROM nb WHERE query <> '-' AND qb <> '-' AND qa <> '-' GROUP BY ALL) SELECT before, after, reference, query, n, round(n / sum(n) OVER (PARTITION BY before, after, reference), 6) AS rate FROM cq",
    "least_context": f"WITH {_ERR} SELECT count(*) AS contexts, CAST(min(n) AS BIGINT) AS least FROM (SELECT sum(n) AS n FROM cx GROUP BY before, after, reference)",
    "exon_merge_by_strand": f"WITH {fixtures.EXONS}, {sql.merged('m', 'v_exons', 'chrom, strand')} SELECT chrom, strand, s AS start_pos, e AS end_pos FROM m",
    "bed12_export": f"WITH {_BED} SELECT chrom, lo AS start_pos, hi AS end_pos, read_name AS name, CAST(1000 AS INTEGER) AS score, strand, lo AS thick_start, hi AS thick_end, '0,0,0' AS color, CAST(c AS INTEGER) AS block_count, sizes AS block_sizes, starts AS block_starts FROM bx JOIN bo USING (read_name)",
    "genepred_roundtrip": f"WITH {_BED} SELECT read_name AS gene, read_name AS tx, chrom, strand, lo AS tx_start, hi AS tx_end, lo AS cds_start, hi AS cds_end, CAST(c AS INTEGER) AS exon_count, st AS exon_starts, en AS exon_ends FROM bx",
}
