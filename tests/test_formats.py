import gzip

from strandloom.sources import formats


def write(path, text):
    (gzip.open if str(path).endswith("gz") else open)(path, "wt").write(text)
    return str(path)


def test_sam_cigars(spark, tmp_path):
    lines = [
        "@HD\tVN:1.0", "@SQ\tSN:chr1\tLN:5000", "@SQ\tSN:chr2\tLN:70\tM5:x",
        "plain\t0\tchr1\t101\t60\t10S50M5I20M100N30M5H\t*\t0\t0\t*\t*",
        "reverse\t16\tchr1\t101\t60\t10S50M4S\t*\t0\t0\t*\t*",
        "smooth\t0\tchr1\t1\t60\t10M67D10M68D10M\t*\t0\t0\t*\t*",
        "none\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*",
    ]
    path = write(tmp_path / "a.sam", "\n".join(lines) + "\n")
    got = {r["qname"]: r for r in formats.read_sam(spark, path).collect()}
    exons = lambda q: [tuple(x) for x in got[q]["exons"]]
    assert exons("plain") == [(100, 170), (270, 300)] and got["plain"]["aligned_bases"] == 100
    assert (got["plain"]["qlen"], got["plain"]["q_start"], got["plain"]["q_end"]) == (120, 10, 115)
    assert (got["reverse"]["q_start"], got["reverse"]["q_end"], got["reverse"]["strand"]) == (4, 54, "-")
    assert exons("smooth") == [(0, 87), (155, 165)]
    assert got["none"]["exons"] is None and got["none"]["aligned_bases"] == 0
    assert sorted(map(tuple, formats.read_sam_header(spark, path).collect())) == [("chr1", 5000), ("chr2", 70)]


def test_fasta_bed_gtf_genepred(spark, tmp_path):
    fasta = write(tmp_path / "a.fa.gz", ">chr1 first\nACGT\nacg\n>chr2\nTT\n")
    assert sorted(map(tuple, formats.read_fasta(spark, fasta).collect())) == [("chr1", "ACGTACG"), ("chr2", "TT")]
    bed = write(tmp_path / "a.bed", "track name=x\nchr1\t5\t9\tn\t3\nchr1\t1\t2\n")
    assert sorted(map(tuple, formats.read_bed(spark, bed).collect())) == [("chr1", 1, 2, []), ("chr1", 5, 9, ["n", "3"])]
    gtf = write(tmp_path / "a.gtf.gz", '#!x\nchr1\ts\texon\t11\t20\t.\t+\t.\tgene_id "G"; transcript_id "T";\nchr1\ts\texon\t1\t5\t.\t+\t.\tgene_id "G"; transcript_id "T";\nchr1\ts\tgene\t1\t20\t.\t+\t.\tgene_id "G";\n')
    (t,) = formats.read_gtf(spark, gtf).collect()
    assert (t["gene"], t["tx"], t["tx_start"], t["tx_end"], [tuple(x) for x in t["exons"]]) == ("G", "T", 0, 20, [(0, 5), (10, 20)])
    gpd = write(tmp_path / "a.gpd", "G\tT\tchr1\t-\t0\t20\t0\t20\t2\t0,10,\t5,20,\n")
    (g,) = formats.read_genepred(spark, gpd).collect()
    assert (g["exon_count"], [tuple(x) for x in g["exons"]]) == (2, [(0, 5), (10, 20)])


def test_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, n long, t string")
    formats.write_lines(df, str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a\t1\t", "b\t2\tx"]
