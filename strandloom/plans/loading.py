"""Problems 3 and 4: keys that hold most records, and lines that fail to parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import skew
from strandloom.session import table
from strandloom.sources import rejects

HEAVY_PERCENT = 2


def _clean(column: str) -> Column:
    return F.upper(F.btrim(F.col(column), F.lit(" \t")))


def _keys() -> dict[str, Column]:
    return {"gene": _clean("gene"), "tx": _clean("tx")}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.heavy_keys(table(spark, sf_dir, "annotbest"), _keys(), F.col("read_name"), HEAVY_PERCENT).select("key_field", "key_value")


def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "annotbest")
    identity = ["read_line"]
    out = skew.key_totals(rows, _keys(), F.col("read_name"), identity, F.col("match_type") == "full", F.col("overlap_bases"))
    return out.withColumnRenamed("n_members", "n_reads")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.genepred_lines(table(spark, sf_dir, "gpd_raw"), table(spark, sf_dir, "chrlens"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).filter("reason is not null").select("line_id", "reason")


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).filter("reason is null").drop("reason")


QUERIES = (p3_found, p3_totals, p4_found, p4_loaded)

_KEYED = """
k AS (SELECT 'gene' AS key_field, upper(trim(gene, ' ' || chr(9))) AS key_value, * FROM annotbest UNION ALL SELECT 'tx', upper(trim(tx, ' ' || chr(9))), * FROM annotbest)
"""

_LINES = r"""
r AS (SELECT line_id, CASE WHEN raw_line LIKE '%' || chr(13) THEN raw_line[:-2] ELSE raw_line END AS s FROM gpd_raw
  WHERE raw_line IS NOT NULL AND NOT regexp_full_match(raw_line, '[ \t\r\n]*') AND NOT starts_with(raw_line, '#')),
q AS (SELECT *, regexp_full_match(s, '(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*') AS ok, regexp_extract_all(chr(9) || s, '\t("(?:[^"]|"")*"|[^"\t]*)', 1) AS raw FROM r),
f AS (SELECT *, list_transform(raw, lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE trim(x, ' ') END) AS f FROM q),
t AS (SELECT *, f[1] AS gene, f[2] AS tx, f[3] AS chrom, f[4] AS strand, try_cast(f[5] AS BIGINT) AS tx_start, try_cast(f[6] AS BIGINT) AS tx_end, try_cast(f[7] AS BIGINT) AS cds_start, try_cast(f[8] AS BIGINT) AS cds_end, try_cast(f[9] AS INTEGER) AS exon_count,
  list_transform(string_split(rtrim(f[10], ','), ','), lambda x: try_cast(x AS BIGINT)) AS st, list_transform(string_split(rtrim(f[11], ','), ','), lambda x: try_cast(x AS BIGINT)) AS en FROM f),
v AS (SELECT *, CASE WHEN NOT ok THEN 'quoting' WHEN len(f) <> 11 THEN 'columns' WHEN NOT coalesce(regexp_full_match(tx, '[A-Za-z0-9_.:-]+') AND strand IN ('+', '-')
  AND regexp_full_match(f[5] || '|' || f[6] || '|' || f[7] || '|' || f[8] || '|' || f[9], '[0-9]+(\|[0-9]+){4}') AND regexp_full_match(f[10], '[0-9]+(,[0-9]+)*,?') AND regexp_full_match(f[11], '[0-9]+(,[0-9]+)*,?')
  AND tx_start < tx_end AND tx_end <= chrom_length AND tx_start <= cds_start AND cds_start <= cds_end AND cds_end <= tx_end
  AND exon_count >= 1 AND len(st) = exon_count AND len(en) = exon_count AND st[1] = tx_start AND en[-1] = tx_end
  AND list_bool_and(list_transform(range(1, len(st) + 1), lambda i: st[i] < en[i] AND (i = 1 OR st[i] >= en[i - 1]))), false) THEN 'value' END AS reason
  FROM t LEFT JOIN chrlens USING (chrom))
"""

ORACLES = {
    "p3_found": f"WITH {_KEYED} SELECT key_field, key_value FROM k WHERE key_value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT read_name) * 100 >= {HEAVY_PERCENT} * (SELECT count(DISTINCT read_name) FROM annotbest)",
    "p3_totals": f"""
WITH {_KEYED}, d AS (SELECT DISTINCT key_field, key_value, read_name, read_line, match_type = 'full' AS is_full, overlap_bases FROM k WHERE key_value IS NOT NULL AND read_name IS NOT NULL),
m AS (SELECT key_field, key_value, overlap_bases, count(*) AS w FROM d WHERE overlap_bases IS NOT NULL GROUP BY ALL)
SELECT d.key_field, d.key_value, count(DISTINCT read_name) AS n_reads, count(*) AS n_rows, CAST(count(*) FILTER (is_full) AS BIGINT) AS n_full, CAST(sum(coalesce(overlap_bases, 0)) AS BIGINT) AS amount_total, any_value(amount_mode) AS amount_mode
FROM d LEFT JOIN (SELECT key_field, key_value, overlap_bases AS amount_mode FROM m QUALIFY row_number() OVER (PARTITION BY key_field, key_value ORDER BY w DESC, overlap_bases) = 1) AS x ON d.key_field = x.key_field AND d.key_value = x.key_value
GROUP BY d.key_field, d.key_value
""",
    "p4_found": f"WITH {_LINES} SELECT line_id, reason FROM v WHERE reason IS NOT NULL",
    "p4_loaded": f"WITH {_LINES} SELECT line_id, gene, tx, chrom, strand, tx_start, tx_end, cds_start, cds_end, exon_count, array_to_string(st, ',') || ',' AS exon_starts, array_to_string(en, ',') || ',' AS exon_ends FROM v WHERE reason IS NULL",
}
