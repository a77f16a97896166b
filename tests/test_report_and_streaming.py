import datetime

import pytest

from strandloom.sources import report
from strandloom.streaming import ingest


def test_report_folder_and_summary(spark, tmp_path):
    path = str(tmp_path / "run")
    small = spark.createDataFrame([("a", 1), ("<b>", None)], "k string, n long")
    report.write_report(spark, {"counts": lambda: small, "ids": lambda: spark.range(report.INLINE_ROWS + 1)}, path, {"seed": 1})
    assert [r["name"] for r in report.list_tables(spark, path).collect()] == ["counts", "ids"]
    assert sorted(map(tuple, report.read_table(spark, path, "counts").collect()), key=str) == [("<b>", None), ("a", 1)]
    with pytest.raises(KeyError):
        report.read_table(spark, path, "other")
    report.extract_lines(spark, path, "counts", str(tmp_path / "lines"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["<b>\t", "a\t1"]
    report.write_summary(spark, path, str(tmp_path / "s.xhtml"))
    got = report.summary_tables(spark, str(tmp_path / "s.xhtml")).collect()
    assert sorted(map(tuple, got)) == [("counts.txt.gz", "<b>\t"), ("counts.txt.gz", "a\t1")]
    report.write_summary(spark, path, str(tmp_path / "p.xhtml"), links=False)
    assert report.summary_tables(spark, str(tmp_path / "p.xhtml")).collect() == []


def test_sinks_by_type(spark, tmp_path):
    df = spark.createDataFrame([("r1", "gapped"), ("r2", "chimera"), ("r3", "gapped")], "q string, read_type string")
    report.write_partitioned(df, str(tmp_path / "paths"), "read_type")
    assert sorted(r["q"] for r in spark.read.parquet(str(tmp_path / "paths/read_type=gapped")).collect()) == ["r1", "r3"]


def test_arrivals_are_counted_once(spark, tmp_path):
    day = datetime.datetime(2024, 3, 4)
    later = day + datetime.timedelta(hours=5)
    first = spark.createDataFrame([("a", "original", 10, day, day), ("b", "gapped", 5, day, day)], "qname string, read_type string, qlen long, run_day timestamp, load_ts timestamp")
    second = spark.createDataFrame([("a", "original", 10, day, later), ("c", "gapped", 7, day, later)], first.schema)
    path = str(tmp_path / "in")
    first.coalesce(1).write.parquet(path)
    second.coalesce(1).write.mode("append").parquet(path)
    stream = ingest.type_counts(ingest.read_arrivals(spark, path, first.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert sorted((r["read_type"], r["reads"], r["bases"]) for r in spark.table("arrivals").collect()) == [("gapped", 2, 12), ("original", 1, 10)]
    finally:
        q.stop()


def test_sessions_agree_with_islands(spark):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    df = spark.createDataFrame([(u, at(m)) for u, m in [(1, 0), (1, 29), (1, 70), (2, 5), (2, 5)]], "u long, ts timestamp")
    a = sorted((r["u"], r["session_start"], r["n"]) for r in ingest.sessions(df, "u", "ts").collect())
    b = sorted((r["u"], r["session_start"], r["n"]) for r in ingest.islands_in_time(df, "u", "ts", 30).collect())
    assert a == b == [(1, at(0), 2), (1, at(70), 1), (2, at(5), 2)]


def test_analyze_and_compare(spark, sf, tmp_path):
    from strandloom.__main__ import analyze, compare

    out = str(tmp_path / "r")
    analyze(spark, sf, out, ["alignment_stats", "top_genes", "comparison"])
    (row,) = compare(spark, [out]).collect()
    stats = {r["stat"]: r["value"] for r in report.read_table(spark, out, "alignment_stats").collect()}
    assert row["report"] == out and (row["reads"], row["aligned_reads"], row["bases"]) == (stats["TOTAL_READS"], stats["ALIGNED_READS"], stats["TOTAL_BASES"])
    assert row["read_n50"] >= row["read_median"] > 0 and 0 < row["aligned_share"] < 1


def test_summary_keeps_whole_tables_by_section(spark, tmp_path):
    path = str(tmp_path / "run")
    many = report.INLINE_ROWS
    report.write_report(spark, {"whole": lambda: spark.range(many).repartition(3), "large": lambda: spark.range(many + 1), "other": lambda: spark.range(2)}, path)
    report.write_summary(spark, path, str(tmp_path / "s.xhtml"), sections={"First": ["whole", "absent"], "None": ["absent"]})
    text = open(tmp_path / "s.xhtml").read()
    assert text.count("<tr>") == many + 1 + 3 and f"{many + 1} rows" in text
    assert text.index("First") < text.index("Tables") and "None" not in text
    lines = [r["line"] for r in report.summary_tables(spark, str(tmp_path / "s.xhtml")).filter("name = 'whole.txt.gz'").collect()]
    assert lines == [str(i) for i in range(many)]


def test_bed12_table_as_genepred_lines(spark, tmp_path):
    from strandloom.sources import formats

    t = spark.createDataFrame([("G", "T", "c", "+", 5, 40, 5, 40, 2, "5,30,", "10,40,")], "gene string, tx string, chrom string, strand string, tx_start long, tx_end long, cds_start long, cds_end long, exon_count int, exon_starts string, exon_ends string")
    report.write_report(spark, {"bed": lambda: formats.to_bed12(t)}, str(tmp_path / "run"))
    report.extract_lines(spark, str(tmp_path / "run"), "bed", str(tmp_path / "out"), genepred=True)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["T\tT\tc\t+\t5\t40\t5\t40\t2\t5,30,\t10,40,"]


def test_a_scope_drops_what_was_written_in_it(spark):
    import os

    from strandloom import session

    kept = session.materialize(spark.range(3), "kept")
    with session.scope():
        gone = session.materialize(spark.range(4), "gone")
        with session.scope():
            inner = session.materialize(spark.range(5), "inner")
        assert not os.path.exists(inner._strandloom_path) and gone.count() == 4
    assert not os.path.exists(gone._strandloom_path) and kept.count() == 3
    session.discard(kept)
    assert not os.path.exists(kept._strandloom_path)
