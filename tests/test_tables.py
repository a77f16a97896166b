"""From SAM, BAM, FASTA and genePred files to depth, paths, features and error profiles."""

import random

import pytest
from bamfile import write_bam

from strandloom import plans
from strandloom.operators import errors
from strandloom.sources import formats, tables

GENOME = {"c1": "".join(random.Random(1).choices("ACGT", k=3000)), "c2": "".join(random.Random(2).choices("ACGT", k=2000))}
REVERSED = str.maketrans("ACGT", "TGCA")


def sam():
    g = GENOME["c1"]
    two = g[100:200] + g[400:500]
    wrong = g[1000:1050] + ("A" if g[1050] != "A" else "C") + g[1051:1100]
    entries = [
        ("spliced", 0, "c1", 101, "100M200N100M", two),
        ("again", 16, "c1", 101, "100M200N100M", two),
        ("mismatch", 0, "c1", 1001, "100M", wrong),
        ("insert", 0, "c1", 1001, "50M2I50M", g[1000:1050] + "GG" + g[1050:1100]),
        ("delete", 0, "c1", 1001, "5S50M3D47M", "TTTTT" + g[1000:1050] + g[1053:1100]),
        ("broken", 0, "c1", 2001, "100M60S", g[2000:2100] + GENOME["c2"][500:560]),
        ("broken", 2048, "c2", 501, "100H60M", GENOME["c2"][500:560]),
        ("lost", 4, "*", 0, "*", "ACGTACGT"),
    ]
    head = [f"@SQ\tSN:{n}\tLN:{len(s)}" for n, s in GENOME.items()]
    return head + [f"{q}\t{flag}\t{c}\t{p}\t60\t{cigar}\t*\t0\t0\t{seq}\t*" for q, flag, c, p, cigar, seq in entries]


@pytest.fixture(scope="module", params=["sam", "bam"])
def made(request, spark, tmp_path_factory):
    at = tmp_path_factory.mktemp(request.param)
    if request.param == "sam":
        (at / "a.sam").write_text("\n".join(sam()) + "\n")
    else:
        write_bam(at / "a.bam", sam(), 300)
    (at / "g.fa").write_text("".join(f">{n} x\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for n, s in GENOME.items()))
    (at / "a.gpd").write_text("G\tT1\tc1\t+\t90\t510\t90\t510\t2\t90,400,\t200,510,\nG\tT2\tc1\t+\t90\t900\t90\t900\t3\t90,400,800,\t200,500,900,\nH\tT3\tc2\t-\t0\t300\t0\t300\t1\t0,\t300,\n")
    names = tables.build_tables(spark, str(at / f"a.{request.param}"), str(at / "out"), str(at / "a.gpd"), str(at / "g.fa"))
    assert set(names) == {"aln_exons", "alndata", "chrlens", "lengths", "gpd", "annotbest", "aligned_pairs", "error_stats"}
    return str(at / "out")


def test_paths(spark, made):
    got = {r["qname"]: (r["read_type"], r["aligned_bases"], r["total_bases"], r["qlen"]) for r in spark.read.parquet(f"{made}/lengths.parquet").collect()}
    assert got["spliced"] == ("original", 200, 200, 200) and got["lost"] == ("unaligned", 0, 0, 8)
    assert got["broken"] == ("chimera", 100, 160, 160) and got["delete"] == ("original", 97, 97, 102)
    stats = {r["stat"]: r["value"] for r in plans.queries()["alignment_stats"](spark, made).collect()}
    assert (stats["TOTAL_READS"], stats["ALIGNED_READS"], stats["TRANSCHIMERA_ALIGN_READS"]) == (7, 6, 1)


def test_depth_and_features(spark, made):
    depth = {(r["chrom"], r["start_pos"], r["end_pos"]): r["depth"] for r in plans.queries()["depth_segments"](spark, made).collect()}
    assert depth == {("c1", 100, 500): 2, ("c1", 1000, 1100): 3, ("c1", 2000, 2100): 1, ("c2", 500, 560): 1}
    kinds = {r["qname"]: r["feature"] for r in plans.queries()["read_features"](spark, made).collect()}
    assert kinds["mismatch"] == "intergenic"


def test_annotation(spark, made):
    got = {r["read_name"]: (r["gene"], r["tx"], r["match_type"], r["matching_exon_count"], r["read_exons"], r["rng"]) for r in spark.read.parquet(f"{made}/annotbest.parquet").collect()}
    assert got["spliced"] == got["again"] == ("G", "T1", "full", 2, 2, "c1:101-500")
    assert got["mismatch"] == (None, None, None, None, 1, "c1:1001-1100") and "lost" not in got
    (counts,) = plans.queries()["gene_counts"](spark, made).collect()
    assert (counts["gene_any"], counts["tx_full"]) == (1, 1)


def test_error_profiles(spark, made):
    pairs = spark.read.parquet(f"{made}/aligned_pairs.parquet")
    by = {r["qname"]: (r["target"], r["query"]) for r in pairs.join(spark.read.parquet(f"{made}/alndata.parquet"), "aln_id").collect()}
    g = GENOME["c1"]
    assert by["spliced"] == (g[100:200] + g[400:500],) * 2
    assert by["insert"][0] == g[1000:1050] + "--" + g[1050:1100] and by["delete"][1] == g[1000:1050] + "---" + g[1053:1100]
    stats = spark.read.parquet(f"{made}/error_stats.parquet").first().asDict()
    assert (stats["ALIGNMENT_COUNT"], stats["MISMATCHES"], stats["ANY_INSERTION"], stats["ANY_DELETION"]) == (6, 1, 2, 3)
    assert stats["ALIGNMENT_BASES"] == 200 + 200 + 100 + 102 + 100 + 100
    brute = {}
    for t, q in by.values():
        for a, b in zip(t, q):
            brute[a, b] = brute.get((a, b), 0) + 1
    assert {(r["target"], r["query"]): r["n"] for r in errors.error_matrix(pairs).collect()} == brute


def test_exons_over_tiles_of_the_genome(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">c1\n" + GENOME["c1"] + "\n")
    tiles = formats.read_fasta_tiles(spark, str(tmp_path / "g.fa"), 70)
    assert tiles.count() == 43
    rows = formats.alignments(spark.createDataFrame([(1, "q", 0, "c1", 100, "100M100N50M", "A" * 150), (2, "q", 0, "c1", 2990, "20M", "A" * 20), (3, "q", 0, "cX", 1, "20M", "A" * 20), (4, "q", 0, "c1", 1, "20M", "*")], "aln_id long, qname string, flag int, chrom string, t long, cigar string, seq string"))
    got = formats.aligned_bases(rows, tiles, 70).collect()
    assert [tuple(r) for r in got] == [(1, GENOME["c1"][100:200] + GENOME["c1"][300:350], "A" * 150)]


def test_profiles_of_empty_and_odd_strings(spark):
    df = spark.createDataFrame([(1, "", ""), (2, None, None), (3, "AC-GT", "ACCGN"), (4, "A", "AA")], "aln_id long, target string, query string")
    row = errors.error_stats(df).first()
    assert (row["ALIGNMENT_COUNT"], row["ALIGNMENT_BASES"], row["MISMATCHES"], row["HOMOPOLYMER_INSERTION"]) == (1, 5, 1, 1)
    assert errors.error_stats(df.limit(0)).first()["ALIGNMENT_BASES"] == 0
    assert [tuple(r) for r in errors.contexts_per_alignment(df).collect()] == []


def test_reports_from_a_file_and_their_comparison(spark, tmp_path):
    from strandloom.__main__ import analyze, compare
    from strandloom.sources import report

    (tmp_path / "a.sam").write_text("\n".join(sam()) + "\n")
    (tmp_path / "g.fa").write_text("".join(f">{n}\n{s}\n" for n, s in GENOME.items()))
    plain, full = str(tmp_path / "plain"), str(tmp_path / "full")
    analyze(spark, str(tmp_path / "a.sam"), plain, ["alignment_stats", "depth_hist_chrom", "bed12_sets", "comparison"])
    analyze(spark, str(tmp_path / "a.sam"), full, ["comparison", "error_counts"], genome=str(tmp_path / "g.fa"))
    assert {r["name"] for r in report.list_tables(spark, plain).collect()} == {"alignment_stats", "depth_hist_chrom", "bed12_sets", "comparison"}
    rows = {r["report"]: r for r in compare(spark, [plain, full]).collect()}
    assert rows[plain]["reads"] == rows[full]["reads"] == 7 and rows[plain]["any_error"] is None
    assert rows[full]["mismatches"] == round(1 / 802, 6)
    assert {(r["read_type"], r["color"]) for r in report.read_table(spark, plain, "bed12_sets").collect()} == {("best", "255,0,0"), ("chimera", "0,0,255")}
