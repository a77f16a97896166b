import random

from strandloom.llm import topn

SCHEMA = "g string, i long, a long, b long, rank long, _g string"


def brute(rows, n):
    best = {}
    for g, i, a, b, *_ in rows:
        if None not in (g, i, a, b):
            best[g, i] = max(best.get((g, i), (a, b)), (a, b))
    out = set()
    for g in {g for g, _ in best}:
        items = sorted((-a, -b, i) for (h, i), (a, b) in best.items() if h == g)
        out |= {(g, i, r + 1) for r, (_, _, i) in enumerate(items[:n])}
    return out


def run(spark, rows, n=3, parts=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return {tuple(r) for r in topn.top_n(df, "g", "i", ["a", "b"], n).collect()}


def test_against_brute_force_with_hot_group_ties_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(topn, "BUFFER_ROWS", 50)
    rng = random.Random(3)
    pick = lambda p, v: None if rng.random() < p else v
    rows = []
    for i in range(1500):
        g = "hot" if rng.random() < 0.4 else f"g{rng.randrange(150)}"
        row = (pick(0.02, g), pick(0.02, i), pick(0.02, rng.randrange(6)), rng.randrange(2), 7, "x")
        rows += [row] * rng.choice([1, 1, 2, 5])
    assert run(spark, rows) == brute(rows, 3)
    assert run(spark, rows, 1, 9) == brute(rows, 1)


def test_an_item_with_several_values_counts_once_with_the_best(spark):
    rows = [("g", 1, 5, 0, 0, ""), ("g", 1, 9, 0, 0, ""), ("g", 2, 7, 0, 0, ""), ("g", 3, 7, 1, 0, "")]
    assert run(spark, rows, 2) == {("g", 1, 1), ("g", 3, 2)}


def test_small_groups_and_empty_table(spark):
    assert run(spark, [("a", 1, 1, 1, 0, "")]) == {("a", 1, 1)}
    assert run(spark, []) == set()
