"""Run-level statistics over the length table (qname, read_type, aligned_bases, total_bases, qlen)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.bins import count_bin, length_bin, ratio

# Read name patterns of the sequencing platforms.
ONT_NAME = r"^[a-f0-9]{8}-[a-f0-9]{4}-4[a-f0-9]{3}-[89ab][a-f0-9]{3}-[a-f0-9]{12}_Basecall_2D_(.*)$"
PACBIO_NAME = r"^(m[^/]+)/(\d+)/(ccs|\d+_\d+)"
NAME_FEATURES = {
    "ccs": r"^m[^/]+/\d+/ccs$",
    "sub": r"^m[^/]+/\d+/\d+_\d+$",
    "ontpass2D": r"^\S+_pass_2D$",
    "ontpasstem": r"^\S+_pass_tem$",
    "ontpasscom": r"^\S+_pass_com$",
    "ontfail2D": r"^\S+_fail_2D$",
    "ontfailtem": r"^\S+_fail_tem$",
    "ontfailcom": r"^\S+_fail_com$",
}
NAME_SUMS = {
    "pacbio": ["ccs", "sub"],
    "ont": ["ontpass2D", "ontpasstem", "ontpasscom", "ontfail2D", "ontfailtem", "ontfailcom"],
    "ontpass": ["ontpass2D", "ontpasstem", "ontpasscom"],
    "ontfail": ["ontfail2D", "ontfailtem", "ontfailcom"],
    "ont2D": ["ontpass2D", "ontfail2D"],
    "ont1D": ["ontpasstem", "ontpasscom", "ontfailtem", "ontfailcom"],
}


def to_rows(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """The columns besides ``keys`` as rows (keys, name, value)."""
    columns = [c for c in df.columns if c not in keys]
    return df.unpivot(keys, columns, name, value) if keys else df.select(F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns])).alias("x")).select("x.*")


def _alignment_columns() -> dict[str, Column]:
    kind, single, both, qlen = F.col("read_type"), F.col("aligned_bases"), F.col("total_bases"), F.col("qlen")
    of = {
        "SINGLE": kind == "original",
        "GAPPED": kind == "gapped",
        "CHIMERA": kind.contains("chimera"),
        "TRANSCHIMERA": kind == "chimera",
        "SELFCHIMERA": kind.isin("self-chimera", "self-chimera-atypical"),
    }
    aligned = kind != "unaligned"
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, c)), F.lit(0)).cast("long")
    out = {"TOTAL_READS": F.count("*"), "UNALIGNED_READS": F.count_if(~aligned), "ALIGNED_READS": F.count_if(aligned)}
    out |= {f"{k}_ALIGN_READS": F.count_if(c) for k, c in of.items()}
    out |= {"TOTAL_BASES": total(qlen, aligned), "UNALIGNED_BASES": total(qlen - both, aligned), "ALIGNED_BASES": total(both, aligned), "SINGLE_ALIGN_BASES": total(single, aligned)}
    out |= {f"{k}_ALIGN_BASES": total(both - single, c) for k, c in of.items() if k != "SINGLE"}
    return out


def alignment_stats(lengths: DataFrame, keys: list[str]) -> DataFrame:
    """The 16 counts and sums of reads and bases by type, in one pass. Bases are those of aligned reads; a null adds nothing."""
    return lengths.groupBy(*keys).agg(*[c.alias(n) for n, c in _alignment_columns().items()])


def platform_summary(lengths: DataFrame) -> DataFrame:
    """(platform, subtype, reads, aligned, unaligned) from the form of read names."""
    name = F.col("qname")
    ont, pb = name.rlike(ONT_NAME), name.rlike(PACBIO_NAME)
    platform = F.when(ont, "ONT").when(pb, "PacBio").otherwise("Unclassified")
    kind = F.when(ont, F.regexp_extract(name, ONT_NAME, 1)).when(pb, F.when(F.regexp_extract(name, PACBIO_NAME, 3) == "ccs", "ccs").otherwise("subread")).otherwise("")
    aligned = F.count_if(F.col("read_type") != "unaligned")
    return lengths.groupBy(platform.alias("platform"), kind.alias("subtype")).agg(F.count("*").alias("reads"), aligned.alias("aligned"), (F.count("*") - aligned).alias("unaligned"))


def cell_summary(lengths: DataFrame) -> DataFrame:
    """(cell, reads, molecules, molecules_aligned) of PacBio reads; molecules are counted once.

    Grouped by molecule first, so that a cell with most reads is no single task's work.
    """
    p = lengths.filter(F.col("qname").rlike(PACBIO_NAME)).select(
        F.regexp_extract("qname", PACBIO_NAME, 1).alias("cell"), F.regexp_extract("qname", PACBIO_NAME, 2).cast("long").alias("molecule"), (F.col("read_type") != "unaligned").alias("aligned")
    )
    molecules = p.groupBy("cell", "molecule").agg(F.count("*").alias("reads"), F.max("aligned").alias("aligned"))
    return molecules.groupBy("cell").agg(F.sum("reads").alias("reads"), F.count("*").alias("molecules"), F.count_if("aligned").alias("molecules_aligned"))


def cell_rollup(cells: DataFrame) -> DataFrame:
    """One row over all cells: counts, and max, avg and min per cell."""
    out = [F.count("*").alias("cells"), F.sum("molecules").alias("molecule_count"), F.sum("molecules_aligned").alias("aligned_molecule_count")]
    for c in ("reads", "molecules", "molecules_aligned"):
        out += [F.max(c).alias(f"max_{c}"), F.round(F.avg(c), 6).alias(f"avg_{c}"), F.min(c).alias(f"min_{c}")]
    return cells.agg(*out)


def cell_distribution(cells: DataFrame) -> DataFrame:
    """(measure, value, n, rank): the numbers of each measure over all cells from the smallest up, as the plots take them.

    Equal numbers are counted first; ``rank`` is the last place of the number and ``n`` how many cells have it.
    """
    freq = to_rows(cells.select("cell", "reads", "molecules", "molecules_aligned"), ["cell"], "measure", "value").groupBy("measure", "value").agg(F.count("*").alias("n"))
    return freq.select("measure", "value", "n", F.sum("n").over(Window.partitionBy("measure").orderBy("value")).alias("rank"))


def length_statistics(lengths: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, metric, n, average, median, n50, stddev) of the positive values of each of the columns.

    Everything is taken from value frequencies, for all columns in one pass: the window
    for N50 runs over distinct lengths, not over reads. N50 is the length at which, from
    the longest down, half of all bases are reached.
    """
    by = [*keys, "metric"]
    stacked = to_rows(lengths.select(*keys, *columns), keys, "metric", "v").filter("v > 0")
    freq = stacked.groupBy(*by, "v").agg(F.count("*").alias("w"))
    down = Window.partitionBy(*by).orderBy(F.col("v").desc())
    bases = F.col("v") * F.col("w")
    run = freq.withColumn("upto", F.sum(bases).over(down)).withColumn("all", F.sum(bases).over(Window.partitionBy(*by)))
    n = F.sum("w")
    mean = F.sum(bases) / n
    spread = F.sum(F.col("w") * F.col("v").cast("double") * F.col("v")) - n * mean * mean
    return run.groupBy(*by).agg(
        n.alias("n"), F.round(mean, 6).alias("average"), F.percentile("v", 0.5, F.col("w")).alias("median"),
        F.max(F.when(2 * F.col("upto") >= F.col("all"), F.col("v"))).alias("n50"), F.round(F.sqrt(F.try_divide(spread, n - 1)), 3).alias("stddev"),
    )


def compare_runs(lengths: DataFrame, run: str) -> DataFrame:
    """One row per run with read counts, length statistics and ratios, for comparing runs side by side."""
    basic = alignment_stats(lengths, [run])
    names = {"qlen": "read", "total_bases": "aligned"}
    wide = [F.max(F.when(F.col("metric") == c, F.col(x))).alias(f"{n}_{x}") for c, n in names.items() for x in ("average", "median", "n50", "stddev")]
    sizes = length_statistics(lengths, [run], list(names)).groupBy(run).agg(*wide)
    return basic.join(sizes, run, "left").select(
        run, F.col("TOTAL_READS").alias("reads"), "read_average", "read_median", "read_n50", "read_stddev", F.col("ALIGNED_READS").alias("aligned_reads"), ratio("ALIGNED_READS", "TOTAL_READS").alias("aligned_share"),
        "aligned_average", "aligned_median", "aligned_n50", "aligned_stddev", ratio("CHIMERA_ALIGN_READS", "ALIGNED_READS").alias("chimera_share"),
        ratio("TRANSCHIMERA_ALIGN_READS", "CHIMERA_ALIGN_READS").alias("transchimera_share"), ratio("SELFCHIMERA_ALIGN_READS", "CHIMERA_ALIGN_READS").alias("selfchimera_share"),
        F.col("TOTAL_BASES").alias("bases"), ratio("ALIGNED_BASES", "TOTAL_BASES").alias("aligned_base_share"),
    )


def name_feature_counts(lengths: DataFrame, run: str) -> DataFrame:
    """Over runs, the sum, median, average and standard deviation of each count of name forms: (feature, total, median, average, stddev)."""
    hits = {k: F.col("qname").rlike(p) for k, p in NAME_FEATURES.items()}
    counts = {k: F.count_if(h) for k, h in hits.items()} | {k: sum((F.count_if(hits[x]) for x in parts[1:]), F.count_if(hits[parts[0]])) for k, parts in NAME_SUMS.items()}
    known = sum((h.cast("int") for h in list(hits.values())[1:]), hits["ccs"].cast("int"))
    counts["other"] = F.count_if(known == 0)
    per_run = lengths.groupBy(run).agg(*[c.alias(k) for k, c in counts.items()])
    return to_rows(per_run, [run], "feature", "n").groupBy("feature").agg(F.sum("n").alias("total"), F.median("n").alias("median"), F.round(F.avg("n"), 6).alias("average"), F.round(F.stddev("n"), 3).alias("stddev"))


def type_histogram(lengths: DataFrame) -> DataFrame:
    """(bin, read_type, n) over read lengths."""
    return lengths.filter("qlen is not null").groupBy(length_bin("qlen").alias("bin"), "read_type").agg(F.count("*").alias("n"))


def aligned_share_quartiles(lengths: DataFrame) -> DataFrame:
    """Quartiles of the aligned share of reads, in ten-thousandths, by length bin: (bin, q1, median, q3).

    The share is an integer, so the percentiles are taken from a bounded table of frequencies.
    """
    rows = lengths.filter("qlen > 0 and read_type <> 'unaligned' and total_bases is not null")
    freq = rows.groupBy(length_bin("qlen").alias("bin"), F.expr("(total_bases * 10000) div qlen").alias("share")).agg(F.count("*").alias("n"))
    q = freq.groupBy("bin").agg(F.percentile("share", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q"))
    return q.select("bin", *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])


def histogram(df: DataFrame, length: str, count: str, kind: str) -> DataFrame:
    """(axis, bin, kind, n): the pair of histograms by length bin and by exon count that the plots show."""
    axes = F.array(F.struct(F.lit("length").alias("axis"), length_bin(length).alias("bin")), F.struct(F.lit("exons").alias("axis"), count_bin(count).alias("bin")))
    return df.select(kind, F.explode(axes).alias("x")).filter("x.bin is not null").groupBy("x.axis", "x.bin", kind).agg(F.count("*").alias("n"))
