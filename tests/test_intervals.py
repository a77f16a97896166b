import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.operators import intervals, loci

SCHEMA = "id long, chrom string, start long, end long, depth string"


def data(n, seed, span=300):
    rng = random.Random(seed)
    rows = [(i, rng.choice("aab"), s := rng.randrange(span), s + rng.choice([0, 1, 5, 40, 150]), "x") for i in range(n)]
    return rows + rows[: n // 4] + [(None, None, 1, 2, "x"), (-1, "a", None, 5, "x"), (-2, "a", 9, 4, "x")]


def good(rows):
    return [r for r in rows if None not in r[1:4] and r[2] < r[3]]


def cover(rows):
    return Counter((c, p) for _, c, s, e, _ in good(rows) for p in range(s, e))


def runs(points):
    """Maximal runs of (chrom, pos) -> value as (chrom, start, end, value)."""
    out = []
    for (c, p), v in sorted(points.items()):
        if out and out[-1][0] == c and out[-1][2] == p and out[-1][3] == v:
            out[-1][2] = p + 1
        else:
            out.append([c, p, p + 1, v])
    return sorted(map(tuple, out))


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("tile", [7, 64, 1 << 18])
def test_depth_merge_subtract_against_positions(spark, tile):
    a, b = data(60, tile), data(25, tile + 1)
    da, db = (spark.createDataFrame(x, SCHEMA) for x in (a, b))
    assert rows_of(intervals.depth(da, ["chrom"], tile=tile), "chrom", "start", "end", "depth") == runs(cover(a))
    assert rows_of(intervals.merge(da, ["chrom"], tile), "chrom", "start", "end") == [r[:3] for r in runs(dict.fromkeys(cover(a), 1))]
    left = {k: 1 for k in cover(a) if k not in cover(b)}
    assert rows_of(intervals.subtract(da, db, ["chrom"], tile), "chrom", "start", "end") == [r[:3] for r in runs(left)]


@pytest.mark.parametrize("tile", [7, 64])
def test_layers_against_positions(spark, tile):
    a, b, c = data(20, 11, 200), data(15, 12), [(0, "a", 0, 400, ""), (1, "b", 10, 20, "")]
    got = intervals.layers({k: spark.createDataFrame(v, SCHEMA) for k, v in (("x", a), ("y", b), ("z", c))}, ["chrom"], tile)
    want = {p: "z" for p in cover(c)} | {p: "y" for p in cover(b)} | {p: "x" for p in cover(a)}
    assert rows_of(got, "chrom", "start", "end", "kind") == runs(want)


def test_weighted_depth_equals_copies(spark):
    rows = good(data(40, 3))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("w", F.col("id") % 3 + 1)
    points = Counter()
    for i, c, s, e, _ in rows:
        for p in range(s, e):
            points[c, p] += i % 3 + 1
    assert rows_of(intervals.depth(df, ["chrom"], F.col("w"), 16), "chrom", "start", "end", "depth") == runs(points)


@pytest.mark.parametrize("tile", [5, 50, 1000])
def test_overlap_join_equals_all_pairs(spark, tile):
    a, b = data(50, 5), data(30, 6)
    right = spark.createDataFrame(b, SCHEMA).select("chrom", F.col("id").alias("rid"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    got = intervals.overlap_join(spark.createDataFrame(a, SCHEMA), right, ["chrom"], tile).withColumn("n", intervals.overlap_size())
    want = sorted((x[0], y[0], min(x[3], y[3]) - max(x[2], y[2])) for x in good(a) for y in good(b) if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    assert rows_of(got, "id", "rid", "n") == want


def test_nearest_with_ties_and_window(spark):
    rng = random.Random(8)
    points = [("a", rng.randrange(500)) for _ in range(80)] + [("a", 100), (None, 1)]
    sites = [("a", rng.randrange(0, 500, 10)) for _ in range(20)] + [("a", 97), ("a", 103), ("b", 1)]
    got = intervals.nearest(spark.createDataFrame(points, "chrom string, pos long"), spark.createDataFrame(sites, "chrom string, site long"), ["chrom"], 12)
    want = set()
    for c, p in points:
        near = [(abs(p - s), s) for d, s in sites if d == c and abs(p - s) <= 12]
        if near:
            want.add((c, p, min(near)[1]))
    assert rows_of(got, "chrom", "pos", "site") == sorted(want)


def test_clusters_loci_depth_and_components(spark):
    rows = [(f"r{i}", c, s, e) for i, (_, c, s, e, _) in enumerate(good(data(70, 9, 3000)))]
    df = spark.createDataFrame(rows, "read_name string, chrom string, start long, end long")
    points = cover([(0, c, s, e, 0) for _, c, s, e in rows])
    merged = [r[:3] for r in runs(dict.fromkeys(points, 1))]
    where = {n: next(k for k, m in enumerate(merged) if m[0] == c and m[1] <= s < m[2]) + 1 for n, c, s, e in rows}
    assert dict(rows_of(loci.locus_reads(df, 32), "read_name", "locus")) == where
    stats = {r["read_name"]: (r["average_depth"], r["covered_share"]) for r in loci.depth_statistics(df, "read_name", 2, 32).collect()}
    for n, c, s, e in rows:
        d = [points[c, p] for p in range(s, e)]
        assert stats[n] == pytest.approx((sum(d) / len(d), sum(x >= 2 for x in d) / len(d)), abs=2e-6)
    exons = [(f"q{i // 3}", c, s, e) for i, (_, c, s, e) in enumerate(rows)]
    got = loci.exon_components(spark.createDataFrame(exons, "read_name string, chrom string, start long, end long"), "read_name", 32)
    parts = {}
    for n, k in rows_of(got, "read_name", "component"):
        parts.setdefault(k, set()).add(n)
    label = {n: n for n, *_ in exons}
    for _ in exons:
        for n, c, s, e in exons:
            for m, d, t, f in exons:
                if c == d and s <= f and t <= e:
                    label[n] = label[m] = min(label[n], label[m])
    want = {}
    for n, k in label.items():
        want.setdefault(k, set()).add(n)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want.values()))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert intervals.merge(df, ["chrom"]).collect() == intervals.depth(df, ["chrom"]).collect() == intervals.subtract(df, df, ["chrom"]).collect() == []
