"""What the whole job of some queries includes."""

import pytest
from oracle import assert_same, connect
from pyspark.errors import PySparkException

from strandloom import plans
from strandloom.operators import junctions, loci, sampling
from strandloom.plans import annotate, transcriptome


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(annotate._CURVES))
def test_curves_draw_from_all_reads(spark, sf, con, name):
    ends = con.execute("SELECT count(DISTINCT qname) FROM lengths").fetchone()[0]
    assert plans.queries()[name](spark, sf).agg({"x": "max"}).first()[0] == ends == 615


def test_more_annotated_reads_than_reads_is_an_error(spark):
    found = spark.createDataFrame([("a", 1, "g"), ("b", 2, None)], "name string, k long, v string")
    reads = lambda n: spark.createDataFrame([(x,) for x in "abcd"[:n]], "name string")
    assert sorted(r["v"] or "" for r in sampling.with_null_draws(found, "name", "k", "v", reads(4)).collect()) == ["", "", "", "g"]
    with pytest.raises(PySparkException, match="more annotated reads"):
        sampling.with_null_draws(found, "name", "k", "v", reads(1)).collect()


def test_contexts_are_seen_5000_times(spark):
    sf = "/root/testdata/sf0.01"
    whole = transcriptome.ORACLES["context_sample"]
    assert "upto >= 5000)" in whole
    con = connect(sf)
    assert_same(spark, sf, con, transcriptome.context_sample, whole)
    assert 3000 < len(con.execute(whole).fetchall()) < 15000


def test_components_are_made_of_deep_reads(spark, sf, con):
    kept, every = (con.execute(f"WITH {transcriptome._DEEP_LOCI} SELECT count(*) FROM {t}").fetchone()[0] for t in ("kr", "v_reads"))
    assert 0 < kept < every
    assert transcriptome.locus_components(spark, sf).agg({"n_reads": "sum"}).first()[0] == kept


def test_deep_reads(spark):
    rows = [("a", 0, 100, 2), ("b", 0, 100, 3), ("one", 0, 100, 1), ("lone", 200, 300, 2), ("c", 400, 500, 2), ("d", 400, 480, 2), ("e", 600, 700, 2), ("f", 600, 679, 2), ("g", 600, 679, 2), ("beside", 900, 990, 2), ("single", 900, 990, 1)]
    reads = spark.createDataFrame([(n, "c", s, e, x) for n, s, e, x in rows], "read_name string, chrom string, start long, end long, exon_count int")
    names = lambda **k: sorted(r["read_name"] for r in loci.deep_reads(reads, "read_name", tile=64, **k).collect())
    assert names() == ["a", "b", "c", "d", "f", "g"]
    assert names(min_depth=1) == ["a", "b", "beside", "c", "d", "e", "f", "g", "lone"]


def test_isoform_ends_are_reached_by_two_reads(spark):
    sf = "/root/testdata/sf0.01"  # sf0.001 has no isoform
    assert_same(spark, sf, connect(sf), transcriptome.nr_isoforms, transcriptome.ORACLES["nr_isoforms"])


def test_one_outlying_read_does_not_stretch_an_isoform(spark):
    spans = [(0, 900), (40, 510), (40, 500), (45, 505), (50, 510)]
    rows = [(f"r{i}", "c", "+", k, *x) for i, (s, e) in enumerate(spans) for k, x in enumerate([(s, 100), (400, e)])]
    reads = spark.createDataFrame(rows, "read_name string, chrom string, strand string, exon_no int, start long, end long")
    ends = lambda **k: [(r["start"], r["end"], r["n_reads"]) for r in junctions.nonredundant(reads, **k).collect()]
    assert ends() == [(40, 510, 5)]
    assert ends(end_support=1) == [(0, 900, 5)]
    assert ends(end_support=4) == [(45, 505, 5)]
