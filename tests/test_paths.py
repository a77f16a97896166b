import itertools
import random

import pytest

from strandloom.operators.paths import PathOptions, resolve_paths

SCHEMA = "aln_id long, qname string, flag int, qlen long, q_start long, q_end long, chrom string, strand string, t_start long, t_end long, aligned_bases long"


def brute(rows, o):
    rows = [r for r in sorted(rows) if (r[10] or 0) > 0]
    if not rows:
        return "unaligned", 0, []
    best = min(rows, key=lambda r: (0 if r[2] is not None and r[2] & 2304 == 0 else 1, r[0]))
    top, found = best[10], None
    for size in range(2, len(rows) + 1):
        for path in itertools.combinations(rows, size):
            if best not in path or any(r[10] < o.min_aligned_bases for r in path):
                continue
            path = sorted(path, key=lambda r: (r[4], r[0]))
            pairs = list(itertools.combinations(path, 2))
            if any(min(x[5], y[5]) - max(x[4], y[4]) > o.max_query_overlap or max(x[4], y[4]) - min(x[5], y[5]) > o.max_query_gap for x, y in pairs):
                continue
            bases = sum(r[10] for r in path)
            if bases > top:
                top, found = bases, (path, pairs)
    if not found:
        return "original", top, [best[0]]
    path, pairs = found
    ids = [r[0] for r in path]
    near = [(x, y) for x, y in pairs if x[6] == y[6] and min(x[9], y[9]) - max(x[8], y[8]) > o.max_target_overlap]
    if near:
        x, y = near[0]
        return "self-chimera" if x[7] != y[7] and len({r[6] for r in path}) == 1 else "self-chimera-atypical", top, ids
    far = any(x[6] != y[6] or max(x[8], y[8]) - min(x[9], y[9]) > o.max_target_gap for x, y in pairs)
    return "chimera" if far else "gapped", top, ids


def reads(count, most, seed, stretch=1, values=400):
    """Reads of 1 to ``most`` entries; a large ``stretch`` puts gaps between them, few ``values`` make ties."""
    rng = random.Random(seed)
    out, i = [], 0
    for q in range(count):
        for _ in range(rng.randrange(1, most + 1)):
            s, n = rng.randrange(0, 1500) * rng.choice([1, stretch]), rng.choice([5, 10, rng.randrange(20, 400)])
            t, w = rng.randrange(0, 3000), rng.randrange(60, 60 + values)
            out.append((i, f"q{q}", rng.choice([0, 16, 256, 2048, None]), 2000, s, s + n, rng.choice(["a", "a", "b"]), rng.choice("+-"), t, t + n, w if rng.random() > 0.1 else rng.choice([0, 20])))
            i += 1
    return out


def run(spark, rows, o):
    got = {r["qname"]: r for r in resolve_paths(spark.createDataFrame(rows, SCHEMA), o).collect()}
    bases = {r[0]: r[10] for r in rows}
    return {q: (r["read_type"], sum(bases[m] for m in r["members"]), r["members"]) for q, r in got.items()}


@pytest.mark.parametrize("o, stretch, values", [(PathOptions(max_target_gap=1000), 1, 400), (PathOptions(max_query_gap=700), 1, 3), (PathOptions(max_query_gap=1_500), 40, 2), (PathOptions(max_query_gap=0, max_query_overlap=30), 1, 1)])
def test_paths_equal_brute_force(spark, o, stretch, values):
    rows = reads(60, 12, 1, stretch, values)
    by = {q: [r for r in rows if r[1] == q] for q in {r[1] for r in rows}}
    want = {q: brute(v, o) for q, v in by.items()}
    assert run(spark, rows + rows[:50], o) == want
    assert len({w[0] for w in want.values()}) > 2


def test_a_gap_between_members_on_two_sides(spark):
    """Each fits the best entry, but not one another: the same path whatever the number of entries."""
    ends = [(0, "q", 0, 1_000_000, 500_000, 500_100, "a", "+", 0, 100, 1000), (1, "q", 0, 1_000_000, 10_000, 11_000, "a", "+", 5000, 6000, 900), (2, "q", 0, 1_000_000, 900_000, 901_000, "a", "+", 9000, 9900, 200)]
    assert run(spark, ends, PathOptions())["q"] == ("gapped", 1900, [1, 0])
    more = [(3 + i, "q", 0, 1_000_000, 900_000, 901_000, "a", "+", 9000, 9900, 200) for i in range(1500)]
    assert run(spark, ends + more, PathOptions())["q"] == ("gapped", 1900, [1, 0])


def test_many_entries(spark):
    rng = random.Random(3)
    rows = [(i, "hot", 0, 50_000, s, s + 200 + i % 7, "a", "+", 10 * s, 10 * s + 200, 200 + i % 7) for i, s in enumerate(rng.randrange(0, 50_000) for _ in range(20_000))]
    kind, bases, members = run(spark, rows, PathOptions())["hot"]
    place = {r[0]: (r[4], r[5]) for r in rows}
    assert 0 in members and bases > 40_000 and all(place[y][0] >= place[x][1] - 10 for x, y in zip(members, members[1:]))
    assert run(spark, [(r[0], "hot", *r[2:]) for r in rows[:1]] * 30, PathOptions())["hot"] == ("original", 200, [0])


def entry(i, q="q", flag=0, s=0, n=100, chrom="a", strand="+", t=0):
    return (i, q, flag, 1000, s, s + n, chrom, strand, t, t + n, n)


def test_limits(spark):
    o = PathOptions(max_target_gap=1000)
    cases = {
        "gap at the limit": ([entry(0), entry(1, s=200, t=1100)], "gapped"),
        "gap beyond": ([entry(0), entry(1, s=200, t=1101)], "chimera"),
        "query overlap at the limit": ([entry(0), entry(1, s=90, t=300)], "gapped"),
        "query overlap beyond": ([entry(0), entry(1, s=89, t=300)], "original"),
        "opposite strands": ([entry(0), entry(1, s=200, t=50, strand="-")], "self-chimera"),
        "same strand": ([entry(0), entry(1, s=200, t=50)], "self-chimera-atypical"),
        "unaligned first": ([(0, "q", 4, 1000, None, None, None, None, None, None, 0), entry(1)], "original"),
        "nothing aligned": ([(0, "q", 4, 1000, None, None, None, None, None, None, None)], "unaligned"),
        "secondary only": ([entry(0, flag=256, n=60), entry(1, flag=256, s=30, n=100)], "original"),
    }
    rows = [(100 * k + r[0], name, *r[2:]) for k, (name, (v, _)) in enumerate(cases.items()) for r in v]
    assert {q: v[0] for q, v in run(spark, rows, o).items()} == {name: v[1] for name, v in cases.items()}
    assert run(spark, [], o) == {}
