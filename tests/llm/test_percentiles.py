import datetime
import random

import pyarrow as pa
from pyspark.sql import functions as F

from strandloom.llm import percentiles


def brute(values, p):
    values = sorted(values)
    return values[max(1, -(-p * len(values) // 100)) - 1]


def test_against_brute_force_with_many_rounds(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        day = datetime.datetime(2024, 1, 1 + rng.randrange(3)) if rng.random() > 0.01 else None
        kind = rng.choice(["a", "a", "a", "b", None])
        row = (f"q{i}", kind, rng.choice([None, -5, 0, 7, rng.randrange(10**9), rng.randrange(50)]), day, "extra")
        rows += [row] * rng.choice([1, 2])
    df = spark.createDataFrame(rows, "q string, kind string, v long, day timestamp, value string").repartition(5)
    unions = {"day": F.date_format("day", "yyyy-MM-dd"), "all": F.lit("all")}
    got = percentiles.day_and_union_percentiles(df, ["q", "kind", "v", "day"], "day", "kind", ["v"], [1, 50, 100], unions).collect()
    groups = {}
    for q, kind, v, day, _ in set(rows):
        if v is not None and v >= 0:
            for key in (("day", day and day.strftime("%Y-%m-%d"), kind), ("all", "all", kind)):
                groups.setdefault(key, []).append(v)
    assert {(r["scope"], r["period"], r["kind"]): (r["n"], r["p1"], r["p50"], r["p100"]) for r in got} == {k: (len(v), brute(v, 1), brute(v, 50), brute(v, 100)) for k, v in groups.items()}


def test_one_value_and_empty(spark):
    df = spark.createDataFrame([("a", 3)] * 50, "g string, v long")
    got = percentiles.multi_select(percentiles.weighted_values(df, ["g"], ["v"]), ["g"], [50, 99]).collect()
    assert {(r["pct"], r["value"], r["n"]) for r in got} == {(50, 3, 50), (99, 3, 50)}
    assert percentiles.multi_select(percentiles.weighted_values(df.limit(0), ["g"], ["v"]), ["g"], [50]).collect() == []


def test_days_combine_to_the_percentiles_of_their_union(spark):
    rows = [(d, (i * 7919) % 1000) for d in range(4) for i in range(100 * (d + 1))]
    df = spark.createDataFrame(rows, "d int, v long")
    days = [percentiles.weighted_values(df.filter(F.col("d") == d), [], ["v"]) for d in range(4)]
    both = percentiles.combine(days[1].unionByName(days[3]), [])
    got = percentiles.multi_select(both, [], [50, 90]).collect()
    values = [v for d, v in rows if d in (1, 3)]
    assert {r["pct"]: r["value"] for r in got} == {50: brute(values, 50), 90: brute(values, 90)}


def test_tasks_propose_medians_a_chunk_at_a_time(monkeypatch):
    monkeypatch.setattr(percentiles, "CHUNK_ROWS", 6)
    batch = lambda *rows: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["gid", "lo", "value", "weight"])
    parts = [batch((1, -1, 9, 1), (1, -1, 5, 1), (2, 7, 8, 5)), batch((1, -1, 1, 1), (2, -1, 4, 2), (2, -1, 6, 3)), batch((1, -1, 3, 9))]
    got = [tuple(r.values()) for b in percentiles._local_medians(iter(parts)) for r in b.to_pylist()]
    assert got == [(1, -1, 5, 3), (2, -1, 6, 5), (2, 7, 8, 5), (1, -1, 3, 9)]


def test_every_value_is_found_through_pivots(spark):
    """Few and many values alike; a percentile ends on a pivot, which the rounds write."""
    written = []
    keep, percentiles.materialize = percentiles.materialize, lambda df, label: written.append((label, keep(df, label))) or written[-1][1]
    try:
        df = spark.createDataFrame([("few", v % 3) for v in range(30)] + [("many", (v * 7919) % 5000) for v in range(5000)], "g string, v long")
        got = percentiles.multi_select(percentiles.weighted_values(df, ["g"], ["v"]), ["g"], [1, 50, 99]).collect()
    finally:
        percentiles.materialize = keep
    assert {(r["g"], r["pct"]): r["value"] for r in got} == {("few", 1): 0, ("few", 50): 1, ("few", 99): 2, ("many", 1): 49, ("many", 50): 2499, ("many", 99): 4949}
    rounds = [t.filter("side = 0").count() for label, t in written if label == "pivots"]
    assert sum(rounds) == 6 and 5 < len(rounds) < 40
