import random

from pyspark.sql import functions as F

from strandloom.operators import skew

SCHEMA = "line long, name string, gene string, tx string, full boolean, bases long, key_value string, weight long"


def keys():
    return {c: F.upper(F.btrim(c, F.lit(" \t"))) for c in ("gene", "tx")}


def rows():
    rng = random.Random(1)
    out = []
    for i in range(900):
        gene = "hot" if rng.random() < 0.5 else rng.choice(["a", " A\t", "b", None, "c d"])
        row = (i, rng.choice([f"r{i}", f"r{i}", f"r{i % 50}", None]), gene, gene and gene.strip() + str(rng.randrange(3)), rng.choice([True, False, None]), rng.choice([None, 1, 2, 2, 5]), "x", 9)
        out += [row] * rng.choice([1, 1, 4])
    return out


def brute(data):
    out = {}
    for line, name, gene, tx, full, bases, *_ in set(data):
        for field, key in (("gene", gene), ("tx", tx)):
            if name is not None and key is not None:
                out.setdefault((field, key.strip(" \t").upper()), []).append((name, full, bases))
    return out


def test_totals_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    got = {(r["key_field"], r["key_value"]): tuple(r)[2:] for r in skew.key_totals(df, keys(), F.col("name"), ["line"], F.col("full"), F.col("bases")).collect()}
    want = {}
    for key, v in brute(data).items():
        amounts = [b for _, _, b in v if b is not None]
        mode = min(amounts, key=lambda b: (-amounts.count(b), b)) if amounts else None
        want[key] = (len({n for n, _, _ in v}), len(v), sum(f is True for _, f, _ in v), sum(amounts), mode)
    assert got == want


def test_heavy_keys_count_reads_without_a_key_in_the_total(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    total = len({r[1] for r in data if r[1] is not None})
    want = {k: len({n for n, _, _ in v}) for k, v in brute(data).items()}
    for percent in (1, 20, 30):
        got = {(r["key_field"], r["key_value"]): r["n_members"] for r in skew.heavy_keys(df, keys(), F.col("name"), percent).collect()}
        assert got == {k: n for k, n in want.items() if n * 100 >= total * percent}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert skew.heavy_keys(df, keys(), F.col("name"), 2).collect() == []
    assert skew.key_totals(df, keys(), F.col("name"), ["line"], F.col("full"), F.col("bases")).collect() == []
