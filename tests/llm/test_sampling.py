from collections import Counter

import pyarrow as pa

from strandloom.llm import sampling


def draw(spark, rows, k, seed, parts=3, shuffle=None):
    df = spark.createDataFrame(rows, "q string, batch int, item string")
    if shuffle:
        df = df.repartition(shuffle, "item")
    return sorted(r["q"] for r in sampling.uniform_sample(df, "q", "batch", k, seed, parts).collect())


def test_size_distinct_and_repeatable(spark):
    rows = [(f"r{i % 300}", i % 7, str(i)) for i in range(900)] + [("hot", 1, "x")] * 400 + [(None, 1, "n")] * 9 + [("nobatch", None, "y")]
    got = draw(spark, rows, 40, 5)
    assert len(got) == len(set(got)) == 40 and None not in got
    assert got == draw(spark, rows[::-1], 40, 5, shuffle=6)
    assert got != draw(spark, rows, 40, 6)


def test_all_if_fewer_and_empty(spark):
    assert draw(spark, [("a", 1, ""), ("b", 2, ""), ("a", 3, ""), (None, 1, "")], 10, 0) == ["a", "b"]
    assert draw(spark, [], 10, 0) == []


def test_reservoir_is_uniform():
    counts = Counter()
    for seed in range(4000):
        r = sampling._Reservoir(5, seed, "t")
        for begin in range(0, 40, 8):
            r.add(pa.array([str(i) for i in range(begin, begin + 8)]))
        assert r.seen == 40 and len(set(r.items)) == 5
        counts.update(r.items)
    expected = 4000 * 5 / 40
    chi2 = sum((counts[str(i)] - expected) ** 2 / expected for i in range(40))
    assert chi2 < 80  # 39 degrees of freedom, below 1e-4


def test_merged_sample_is_uniform_over_unequal_pieces(spark):
    """Pieces of 3 and 57 keys: many seeds at once, through one merge group each."""
    rows = [(s, p, n, i, f"{p}-{i}") for s in range(600) for p, n in ((0, 3), (1, 57)) for i in range(min(n, 6))]
    found = spark.createDataFrame(rows, "piece int, part int, population long, pos int, item string")
    merged = sampling.merge_reservoirs(found, ["piece"], 6, seed=9).collect()
    assert Counter(r["piece"] for r in merged) == Counter({s: 6 for s in range(600)})
    small = sum(r["item"].startswith("0-") for r in merged)
    assert abs(small - 600 * 6 * 3 / 60) < 60  # mean 180, standard deviation about 13
    assert {r["population"] for r in merged} == {60}


def test_pieces_keep_their_populations_through_many_parts(spark):
    rows = [(f"r{i}", i % 3 if i % 50 else None, "x") for i in range(2000)] + [(f"r{i}", 9, "again") for i in range(2000)]
    df = spark.createDataFrame(rows, "q string, batch int, item string")
    got = sampling.piece_reservoirs(df, "q", "batch", 40, 1, parts=700).collect()
    first = {p: {q for q, b, _ in rows[:2000] if b == p} | ({q for q, b, _ in rows[:2000] if b is None} if p == -1 else set()) for p in (-1, 0, 1, 2)}
    for p, members in first.items():
        here = [r for r in got if r["piece"] == p]
        assert {r["population"] for r in here} == {len(members)} and len(here) == len({r["item"] for r in here}) == min(40, len(members)) and {r["item"] for r in here} <= members
    assert {r["piece"] for r in got} == set(first)


def test_parts_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(sampling, "PART_ROWS", 10)
    assert [sampling.parts_of(spark.range(n)) for n in (0, 1, 10, 11, 20, 21, 41, 1000)] == [1, 1, 1, 2, 2, 4, 8, 128]


def test_a_task_sends_a_hot_key_once_a_buffer(monkeypatch):
    monkeypatch.setattr(sampling, "BUFFER_ROWS", 8)
    batch = lambda keys, piece: pa.RecordBatch.from_arrays([pa.array(keys), pa.array([piece] * len(keys), pa.int32())], ["item", "piece"])
    got = [tuple(r.values()) for b in sampling._first_pieces(iter([batch(["hot"] * 6, 4), batch(["hot", "a"], 2), batch(["hot"], 1)])) for r in b.to_pylist()]
    assert sorted(got) == [("a", 2), ("hot", 1), ("hot", 2)]
