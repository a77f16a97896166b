"""Pieces of SQL shared by the checks."""

from __future__ import annotations

from strandloom.operators.sampling import DIGITS, GRID

ALN = """aln AS (SELECT DISTINCT aln_id, qname, flag, qlen, q_start, q_end, chrom, strand, t_start, t_end, aligned_bases FROM alndata)"""

SPANS = """spans AS (SELECT aln_id, qname, chrom, t_start AS s, t_end AS e FROM aln WHERE chrom IS NOT NULL AND t_start < t_end)"""

EXONS = """gx AS (SELECT gene, tx, chrom, strand, exon_count, unnest(range(1, exon_count + 1)) AS exon_no, unnest(list_transform(string_split(rtrim(exon_starts, ','), ','), lambda x: CAST(x AS BIGINT))) AS s,
  unnest(list_transform(string_split(rtrim(exon_ends, ','), ','), lambda x: CAST(x AS BIGINT))) AS e FROM gpd)"""


def depth(name: str, source: str, weight: str = "1", keys: str = "chrom") -> str:
    """CTEs that give ``name`` (keys, s, e, depth): constant-depth segments of ``source``."""
    return f"""{name}_ev AS (SELECT {keys}, p, CAST(sum(d) AS BIGINT) AS d FROM (SELECT {keys}, s AS p, {weight} AS d FROM {source} UNION ALL SELECT {keys}, e, -({weight}) FROM {source}) GROUP BY {keys}, p HAVING sum(d) <> 0),
{name} AS (SELECT * FROM (SELECT {keys}, p AS s, lead(p) OVER (PARTITION BY {keys} ORDER BY p) AS e, CAST(sum(d) OVER (PARTITION BY {keys} ORDER BY p) AS BIGINT) AS depth FROM {name}_ev) WHERE depth > 0)"""


def merged(name: str, source: str, keys: str = "chrom") -> str:
    """CTEs that give ``name`` (keys, s, e): the union of the intervals of ``source``."""
    return f"""{name}_g AS (SELECT {keys}, s, e, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM {source}),
{name}_i AS (SELECT {keys}, s, e, sum(CASE WHEN pm >= s THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM {name}_g),
{name} AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM {name}_i GROUP BY {keys}, g)"""


def subtracted(name: str, a: str, b: str) -> str:
    """CTEs that give ``name`` (chrom, s, e): what merged ``a`` covers and merged ``b`` doesn't."""
    return f"""{name}_ev AS (SELECT chrom, p, sum(da) AS da, sum(db) AS db FROM (SELECT chrom, s AS p, 1 AS da, 0 AS db FROM {a} UNION ALL SELECT chrom, e, -1, 0 FROM {a} UNION ALL SELECT chrom, s, 0, 1 FROM {b} UNION ALL SELECT chrom, e, 0, -1 FROM {b}) GROUP BY chrom, p),
{name} AS (SELECT chrom, s, e FROM (SELECT chrom, p AS s, lead(p) OVER w AS e, sum(da) OVER w AS ca, sum(db) OVER w AS cb FROM {name}_ev WINDOW w AS (PARTITION BY chrom ORDER BY p)) WHERE ca > 0 AND cb = 0 AND e IS NOT NULL)"""


FEATURES = f"""{EXONS}, tspan AS (SELECT chrom, tx_start AS s, tx_end AS e FROM gpd), genome AS (SELECT chrom, CAST(0 AS BIGINT) AS s, chrom_length AS e FROM chrlens),
{merged("mx", "gx")}, {merged("mt", "tspan")}, {subtracted("intr", "mt", "mx")}, {subtracted("inter", "genome", "mt")},
feat AS (SELECT *, 'exon' AS kind FROM mx UNION ALL SELECT *, 'intron' FROM intr UNION ALL SELECT *, 'intergenic' FROM inter)"""

BEST = """best AS (SELECT * FROM aln WHERE qname IS NOT NULL AND aligned_bases > 0 QUALIFY row_number() OVER (PARTITION BY qname ORDER BY CASE WHEN (flag & 2304) = 0 THEN 0 ELSE 1 END, aln_id) = 1)"""


def length_bin(column: str) -> str:
    return f"CASE WHEN {column} > 4000 THEN '>4000' ELSE CAST(CAST(ceil({column} / 500.0) * 500 AS BIGINT) AS VARCHAR) END"


def mix(key: str, sample: str) -> str:
    """The draw order of strandloom.operators.sampling."""
    return f"CAST('0x' || substr(md5({key} || ':' || {sample}), 1, {DIGITS}) AS BIGINT)"


def rarefaction(source: str, key: str, value: str, samples: int, depth: int) -> str:
    """CTEs and the query of a rarefaction curve over ``source``."""
    return f"""rr AS (SELECT s, {value} AS v, row_number() OVER (PARTITION BY s ORDER BY {mix(key, "s")}, {key}) AS rk FROM {source}, range({samples}) AS t(s)),
rf AS (SELECT s, rk FROM rr WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s, v ORDER BY rk) = {depth}),
rx AS (SELECT x FROM (SELECT unnest({GRID[:40]}) AS x UNION SELECT count(*) FROM {source}) WHERE x <= (SELECT count(*) FROM {source})),
rz AS (SELECT x, t.s, (SELECT count(*) FROM rf WHERE rf.s = t.s AND rk <= x) AS n FROM rx CROSS JOIN range({samples}) AS t(s))
SELECT x, list_sort(list(n))[{int(samples * 0.05) + 1}] AS lower, quantile_cont(n, 0.5) AS median, list_sort(list(n))[{int(samples * 0.95) + 1}] AS upper FROM rz GROUP BY x"""
