"""Length-table statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import stats
from strandloom.plans import inputs, sql


def alignment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.to_rows(stats.alignment_stats(inputs.lengths(spark, sf_dir), []), [], "stat", "value")


def read_type_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.type_histogram(inputs.lengths(spark, sf_dir))


def aligned_fraction_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.aligned_share_quartiles(inputs.lengths(spark, sf_dir))


def platform_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.platform_summary(inputs.lengths(spark, sf_dir))


def cell_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cell_summary(inputs.lengths(spark, sf_dir))


def cell_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cell_rollup(stats.cell_summary(inputs.lengths(spark, sf_dir)))


def cell_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cell_distribution(stats.cell_summary(inputs.lengths(spark, sf_dir)))


def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.length_statistics(inputs.lengths(spark, sf_dir), [], ["qlen", "total_bases"])


def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.compare_runs(inputs.lengths(spark, sf_dir), "run_no")


def name_feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.name_feature_counts(inputs.lengths(spark, sf_dir), "run_no")


def read_length_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read lengths of each run with their counts."""
    return inputs.lengths(spark, sf_dir).filter("qlen is not null").groupBy("run_no", "qlen").agg(F.count("*").alias("n"))


QUERIES = (read_length_table, alignment_stats, read_type_hist, aligned_fraction_box, platform_summary, cell_summary, cell_rollup, cell_distribution, length_stats, run_compare, name_feature_counts)

_L = "l AS (SELECT DISTINCT * EXCLUDE (load_ts) FROM lengths)"


def _stats(keys: str) -> str:
    kinds = {"SINGLE": "read_type = 'original'", "GAPPED": "read_type = 'gapped'", "CHIMERA": "contains(read_type, 'chimera')", "TRANSCHIMERA": "read_type = 'chimera'", "SELFCHIMERA": "read_type IN ('self-chimera', 'self-chimera-atypical')"}
    al = "read_type <> 'unaligned'"
    cols = ["count(*) AS TOTAL_READS", f"count(*) FILTER (NOT {al}) AS UNALIGNED_READS", f"count(*) FILTER ({al}) AS ALIGNED_READS"]
    cols += [f"count(*) FILTER ({c}) AS {k}_ALIGN_READS" for k, c in kinds.items()]
    sums = {"TOTAL_BASES": ("qlen", al), "UNALIGNED_BASES": ("qlen - total_bases", al), "ALIGNED_BASES": ("total_bases", al), "SINGLE_ALIGN_BASES": ("aligned_bases", al)}
    sums |= {f"{k}_ALIGN_BASES": ("total_bases - aligned_bases", c) for k, c in kinds.items() if k != "SINGLE"}
    cols += [f"CAST(coalesce(sum({e}) FILTER ({c}), 0) AS BIGINT) AS {k}" for k, (e, c) in sums.items()]
    return f"st AS (SELECT {keys}{', '.join(cols)} FROM l {'GROUP BY ' + keys.rstrip(', ') if keys else ''})"


def _lens(name: str, column: str, keys: str) -> str:
    part = f"PARTITION BY {keys.rstrip(', ')}" if keys else ""
    return f"""{name} AS (SELECT {keys}count(*) AS n, round(avg({column}), 6) AS average, quantile_cont({column}, 0.5) AS median, max({column}) FILTER (2 * upto >= total) AS n50, round(stddev_samp({column}), 3) AS stddev
FROM (SELECT {keys}{column}, sum({column}) OVER ({part} ORDER BY {column} DESC) AS upto, sum({column}) OVER ({part}) AS total FROM l WHERE {column} > 0) {'GROUP BY ' + keys.rstrip(', ') if keys else ''})"""


def _features() -> str:
    single = " UNION ALL ".join(f"SELECT run_no, '{k}' AS feature, count(*) FILTER (regexp_matches(qname, '{p}')) AS n FROM l GROUP BY run_no" for k, p in stats.NAME_FEATURES.items())
    other = "SELECT run_no, 'other', count(*) FILTER (" + " AND ".join(f"NOT regexp_matches(qname, '{p}')" for p in stats.NAME_FEATURES.values()) + ") FROM l GROUP BY run_no"
    sums = " UNION ALL ".join(f"SELECT run_no, '{k}', CAST(sum(n) AS BIGINT) FROM a WHERE feature IN ({', '.join(repr(x) for x in v)}) GROUP BY run_no" for k, v in stats.NAME_SUMS.items())
    return f"WITH {_L}, a AS ({single}), b AS (SELECT * FROM a UNION ALL {other} UNION ALL {sums}) SELECT feature, CAST(sum(n) AS BIGINT) AS total, quantile_cont(n, 0.5) AS median, round(avg(n), 6) AS average, round(stddev_samp(n), 3) AS stddev FROM b GROUP BY feature"


_CELLS = f"""{_L}, p AS (SELECT regexp_extract(qname, '{stats.PACBIO_NAME}', 1) AS cell, CAST(regexp_extract(qname, '{stats.PACBIO_NAME}', 2) AS BIGINT) AS m, read_type <> 'unaligned' AS al FROM l WHERE regexp_matches(qname, '{stats.PACBIO_NAME}')),
c AS (SELECT cell, count(*) AS reads, count(DISTINCT m) AS molecules, count(DISTINCT m) FILTER (al) AS molecules_aligned FROM p GROUP BY cell)"""
_ROLL = ", ".join(f"max({c}) AS max_{c}, round(avg({c}), 6) AS avg_{c}, min({c}) AS min_{c}" for c in ("reads", "molecules", "molecules_aligned"))

ORACLES = {
    "read_length_table": f"WITH {_L} SELECT run_no, qlen, count(*) AS n FROM l WHERE qlen IS NOT NULL GROUP BY ALL",
    "alignment_stats": f"WITH {_L}, {_stats('')} SELECT stat, value FROM (UNPIVOT st ON COLUMNS(*) INTO NAME stat VALUE value)",
    "read_type_hist": f"WITH {_L} SELECT {sql.length_bin('qlen')} AS bin, read_type, count(*) AS n FROM l WHERE qlen IS NOT NULL GROUP BY ALL",
    "aligned_fraction_box": f"WITH {_L}, x AS (SELECT {sql.length_bin('qlen')} AS bin, (total_bases * 10000) // qlen AS share FROM l WHERE qlen > 0 AND read_type <> 'unaligned' AND total_bases IS NOT NULL) SELECT bin, quantile_cont(share, 0.25) AS q1, quantile_cont(share, 0.5) AS median, quantile_cont(share, 0.75) AS q3 FROM x GROUP BY 1",
    "platform_summary": f"""WITH {_L}, p AS (SELECT CASE WHEN regexp_matches(qname, '{stats.ONT_NAME}') THEN 'ONT' WHEN regexp_matches(qname, '{stats.PACBIO_NAME}') THEN 'PacBio' ELSE 'Unclassified' END AS platform,
 CASE WHEN regexp_matches(qname, '{stats.ONT_NAME}') THEN regexp_extract(qname, '{stats.ONT_NAME}', 1) WHEN regexp_matches(qname, '{stats.PACBIO_NAME}') THEN CASE WHEN regexp_extract(qname, '{stats.PACBIO_NAME}', 3) = 'ccs' THEN 'ccs' ELSE 'subread' END ELSE '' END AS subtype, read_type <> 'unaligned' AS al FROM l)
SELECT platform, subtype, count(*) AS reads, count(*) FILTER (al) AS aligned, count(*) FILTER (NOT al) AS unaligned FROM p GROUP BY ALL""",
    "cell_summary": f"WITH {_CELLS} SELECT * FROM c",
    "cell_rollup": f"WITH {_CELLS} SELECT count(*) AS cells, CAST(sum(molecules) AS BIGINT) AS molecule_count, CAST(sum(molecules_aligned) AS BIGINT) AS aligned_molecule_count, {_ROLL} FROM c",
    "cell_distribution": f"""WITH {_CELLS}, d AS (SELECT measure, value, count(*) AS n FROM (UNPIVOT c ON reads, molecules, molecules_aligned INTO NAME measure VALUE value) GROUP BY ALL)
SELECT measure, value, n, CAST(sum(n) OVER (PARTITION BY measure ORDER BY value) AS BIGINT) AS rank FROM d""",
    "length_stats": f"WITH {_L}, {_lens('a', 'qlen', '')}, {_lens('b', 'total_bases', '')} SELECT *, 'qlen' AS metric FROM a UNION ALL SELECT *, 'total_bases' FROM b",
    "run_compare": f"""WITH {_L}, {_stats('run_no, ')}, {_lens('a', 'qlen', 'run_no, ')}, {_lens('b', 'total_bases', 'run_no, ')}
SELECT st.run_no, TOTAL_READS AS reads, a.average AS read_average, a.median AS read_median, a.n50 AS read_n50, a.stddev AS read_stddev, ALIGNED_READS AS aligned_reads, round(ALIGNED_READS / TOTAL_READS, 6) AS aligned_share,
 b.average AS aligned_average, b.median AS aligned_median, b.n50 AS aligned_n50, b.stddev AS aligned_stddev, round(CHIMERA_ALIGN_READS / nullif(ALIGNED_READS, 0), 6) AS chimera_share,
 round(TRANSCHIMERA_ALIGN_READS / nullif(CHIMERA_ALIGN_READS, 0), 6) AS transchimera_share, round(SELFCHIMERA_ALIGN_READS / nullif(CHIMERA_ALIGN_READS, 0), 6) AS selfchimera_share,
 TOTAL_BASES AS bases, round(ALIGNED_BASES / nullif(TOTAL_BASES, 0), 6) AS aligned_base_share FROM st LEFT JOIN a USING (run_no) LEFT JOIN b USING (run_no)""",
    "name_feature_counts": _features(),
}
