"""python -m strandloom analyze INPUT OUT | dump REPORT [NAME OUT] | compare REPORT... | summary REPORT FILE: reports over a folder of tables or an alignment file."""

from __future__ import annotations

import argparse
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import plans
from strandloom.operators import errors, stats
from strandloom.session import table
from strandloom.sources import report, tables

#: The tables of a report by section, by the names of their queries, and the inputs that the section needs.
SECTIONS = {
    "Alignments": (["alndata", "lengths", "chrlens"], ["alignment_stats", "read_type_hist", "aligned_fraction_box", "length_stats", "read_length_table", "read_paths", "bed12_sets"]),
    "Platform": (["lengths"], ["platform_summary", "cell_summary", "cell_rollup", "name_feature_counts"]),
    "Coverage": (["alndata", "chrlens"], ["depth_segments", "depth_hist_chrom", "depth_hist_total", "depth_line", "depth_strata", "chrom_aligned_fraction", "depth_boxplot"]),
    "Features": (["alndata", "gpd", "chrlens"], ["features_partition", "feature_depth_cumfrac", "read_features", "read_feature_hist_len", "exon_size_distro"]),
    "Annotation": (["annotbest", "lengths", "gpd"], ["annot_lengths", "annot_length_hist", "tx_length_hist", "ref_gene_counts", "ref_detected", "top_genes", "top_transcripts"]),
    "Rarefaction": (["annotbest", "lengths"], ["rarefaction_gene", "rarefaction_gene_full", "rarefaction_tx", "rarefaction_tx_full"]),
    "Errors": (["aligned_pairs"], ["error_counts", "error_kinds", "error_contexts"]),
    "Comparison": (["lengths"], ["comparison"]),
}
TABLES = [name for _, names in SECTIONS.values() for name in names]


def comparison(spark: SparkSession, folder: str) -> DataFrame:
    """One row: read counts, length statistics and shares of all reads, with the error ratios where base pairs are known."""
    whole = table(spark, folder, "lengths").drop("load_ts").distinct().withColumn("report", F.lit(folder))
    basic = stats.compare_runs(whole, "report")
    if "aligned_pairs" not in _inputs(spark, folder):
        return basic
    ratios = errors.error_ratios(errors.error_stats(table(spark, folder, "aligned_pairs")))
    return basic.join(ratios.withColumn("report", F.lit(folder)), "report")


def _error_tables() -> dict[str, object]:
    pairs = lambda spark, folder: table(spark, folder, "aligned_pairs")
    return {
        "error_counts": lambda s, d: stats.to_rows(errors.error_stats(pairs(s, d)), [], "stat", "value"), "error_kinds": lambda s, d: errors.error_matrix(pairs(s, d)),
        "error_contexts": lambda s, d: errors.context_errors(pairs(s, d)), "comparison": comparison,
    }


def _inputs(spark: SparkSession, folder: str) -> set[str]:
    """The names of the tables in a folder."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    return {f.getPath().getName().removesuffix(".parquet") for f in found}


def analyze(spark: SparkSession, source: str, out: str, names: list[str] | None = None, annotation: str | None = None, genome: str | None = None) -> None:
    """Write the report of a folder of tables, or of a SAM or BAM file, whose tables are made under ``out`` first.

    Sections whose inputs are missing are left out.
    """
    folder = source
    if source.removesuffix(".gz").endswith((".sam", ".bam")):
        folder = f"{out}/tables"
        tables.build_tables(spark, source, folder, annotation, genome)
    inputs, queries = _inputs(spark, folder), plans.queries() | _error_tables()
    possible = [n for needs, wanted in SECTIONS.values() if inputs.issuperset(needs) for n in wanted]
    report.write_report(spark, {n: partial(queries[n], spark, folder) for n in names or possible}, out, {"input": source, "annotation": annotation, "genome": genome})


def compare(spark: SparkSession, reports: list[str]) -> DataFrame:
    """One row per report: read counts, length statistics, shares and error ratios side by side."""
    rows = [report.read_table(spark, r, "comparison").withColumn("report", F.lit(r)) for r in reports]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def main() -> None:
    parser = argparse.ArgumentParser(prog="strandloom", description=__doc__)
    modes = parser.add_subparsers(dest="mode", required=True)
    for mode, args in (("analyze", ["source", "out"]), ("dump", ["report"]), ("compare", []), ("summary", ["report", "file"])):
        p = modes.add_parser(mode)
        for a in args:
            p.add_argument(a)
        if mode == "analyze":
            p.add_argument("--annotation", help="genePred or GTF")
            p.add_argument("--genome", help="FASTA")
        if mode == "dump":
            p.add_argument("name", nargs="?")
            p.add_argument("out", nargs="?")
            p.add_argument("--genepred", action="store_true", help="BED12 columns as genePred")
        if mode == "compare":
            p.add_argument("reports", nargs="+")
        if mode == "summary":
            p.add_argument("--no-links", action="store_true")
    a = parser.parse_args()
    spark = SparkSession.builder.appName("strandloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.mode == "analyze":
        analyze(spark, a.source, a.out, None, a.annotation, a.genome)
    elif a.mode == "compare":
        compare(spark, a.reports).show(1000, truncate=False)
    elif a.mode == "summary":
        report.write_summary(spark, a.report, a.file, not a.no_links, {title: names for title, (_, names) in SECTIONS.items()})
    elif a.name and a.out:
        report.extract_lines(spark, a.report, a.name, a.out, genepred=a.genepred)
    else:
        report.list_tables(spark, a.report).show(1000, truncate=False)


if __name__ == "__main__":
    main()
