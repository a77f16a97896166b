import hashlib

import numpy as np

from strandloom.operators import annotate, novel, sampling

EXONS = "tx string, gene string, chrom string, strand string, exon_no int, start long, end long"
READS = "read_name string, chrom string, strand string, exon_no int, start long, end long"


def exons(name, chrom, spans, *more):
    return [(name, *more, chrom, "+", i, s, e) for i, (s, e) in enumerate(spans)]


def test_classes_isoforms_and_loci(spark):
    reference = spark.createDataFrame(exons("T", "c", [(0, 100), (200, 300), (400, 500)], "G"), EXONS)
    skip = [(0, 100), (400, 500)]
    rows = (
        exons("full", "c", [(10, 100), (200, 300), (400, 480)])
        + exons("subset", "c", [(200, 300), (400, 480)])
        + exons("n1", "c", skip) + exons("n2", "c", [(5, 103), (400, 500)])  # the middle exon is skipped
        + exons("far1", "d", [(0, 50), (90, 120)]) + exons("far2", "d", [(40, 60), (90, 130)]) + exons("single", "d", [(0, 50)])
    )
    reads = spark.createDataFrame(rows, READS)
    best = annotate.best_transcript(reads, reference, 64)
    got = {r["read_name"]: (r["match_type"], r["matching_exon_count"], r["consecutive_exons"]) for r in best.collect()}
    assert got == {"full": ("full", 3, 3), "subset": ("partial", 2, 2), "n1": ("partial", 2, 1), "n2": ("partial", 2, 1)}
    fresh, found = novel.novel_transcriptome(reads, reference, 64)
    assert [(r["chain"], r["start"], r["end"], r["n_reads"]) for r in fresh.collect()] == [("100,400", 5, 500, 2)]  # two reads reach 5, one reaches 0
    assert [r["gene"] for r in fresh.collect()] == ["G"]
    assert [r["name"] for r in found.collect()] == ["LOC1|2|d:0-130"]


def test_curves_and_draws(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"g{i % 7}") for i in range(60)] + [(100 + i, None) for i in range(10)], "k long, v string")
    curve = sampling.rarefaction(df, "k", "v", 6, buckets=4).orderBy("x").collect()
    assert [r["x"] for r in curve] == [1, 2, 3, 4, 5, 10, 20, 30, 40, 50, 70]
    assert curve[-1]["lower"] == curve[-1]["upper"] == 8 and all(a["median"] <= b["median"] for a, b in zip(curve, curve[1:]))
    ranks = sampling.draw_ranks(df, "k", 3, 5).groupBy("sample").agg({"rank": "max"}).collect()
    assert {tuple(r) for r in ranks} == {(0, 70), (1, 70), (2, 70)}
    assert sampling.downsample_groups(df.dropna(), ["v"], "k", 2).groupBy("v").count().filter("count > 2").count() == 0
    kept = sampling.within_budget(df.selectExpr("k", "1 as n"), "k", "n", 25, buckets=7)
    assert kept.count() == 25
    seen = sampling.until_every_value(df.dropna().selectExpr("k", "v", "1 as n"), "k", "v", "n", 1).collect()
    assert len(seen) == max(r["rank"] for r in seen) < 60
    assert sampling.rarefaction(df.limit(0), "k", "v", 3).collect() == []


def test_downsample_takes_exactly_the_first_rows(spark):
    df = spark.createDataFrame([(i, "x") for i in range(200)], "k long, _one string")
    got = {r["k"] for r in sampling.downsample(df.select("k"), "k", 37).collect()}
    place = lambda k: (hashlib.md5(f"{k}:0".encode()).hexdigest()[:15], k)
    assert got == set(sorted(range(200), key=place)[:37])
    assert sampling.downsample(df.select("k"), "k", 500).count() == 200


def test_samples_are_independent_shuffles(spark):
    n, samples, first, marked = 400, 200, 100, 120
    rows = sampling.draw_ranks(spark.range(n).withColumnRenamed("id", "k"), "k", samples).select("sample", "rank", "k").orderBy("sample", "rank").toPandas()
    orders = rows["k"].to_numpy().reshape(samples, n)
    assert all(sorted(o) == list(range(n)) for o in orders[:5])
    # In a rotation, or any fixed rearrangement of neighbours, most keys keep their successor.
    after = [dict(zip(o, o[1:])) for o in orders]
    assert max(sum(after[0].get(k) == v for k, v in a.items()) for a in after[1:]) < 10
    # How many marked keys are among the first draws is hypergeometric.
    hits = (orders[:, :first] < marked).sum(axis=1)
    mean, share = first * marked / n, marked / n
    variance = first * share * (1 - share) * (n - first) / (n - 1)
    assert abs(hits.mean() - mean) < 4 * (variance / samples) ** 0.5
    assert 0.65 < hits.var(ddof=1) / variance < 1.45
