"""Error profiles over aligned bases (aln_id, target, query): two strings of one length per alignment, '-' for a gap.

Each position is looked at in its own alignment's row and counted in the same task, so
what is shuffled are counts of kinds of pairs, not bases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.bins import ratio

SIDES = {"target": "query", "query": "target"}
#: Bases of each side that a task looks at in one go.
BLOCK_BASES = 4_000_000
#: What is counted of a position: the bases of both sides there and beside it.
_PLACES = ["t", "q", "t_before", "q_before", "t_after", "q_after"]


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Alignments of a batch a block at a time: the first row, where each alignment begins and ends, and the bytes of both sides.

    A zero byte stands before, between and after the alignments.
    """
    sides = [batch.column(c).cast(pa.large_binary()) for c in ("target", "query")]
    rows, first = list(zip(*(s.to_pylist() for s in sides))), 0
    while first < len(rows):
        stop, size = first, 0
        while stop < len(rows) and (stop == first or size + len(rows[stop][0]) <= BLOCK_BASES):
            size += len(rows[stop][0])
            stop += 1
        joined = [np.frombuffer(b"\0" + b"\0".join(r[k] for r in rows[first:stop]) + b"\0", np.uint8) for k in (0, 1)]
        lengths = np.array([len(r[0]) for r in rows[first:stop]])
        begin = np.append(0, np.cumsum(lengths + 1))[:-1] + 1
        yield first, begin, begin + lengths, *joined
        first = stop


def _counted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of byte columns, and how often each comes."""
    letters = np.flatnonzero(np.bincount(np.concatenate(columns), minlength=256))
    number = np.zeros(256, np.int64)
    number[letters] = np.arange(len(letters))
    key = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        key = key * len(letters) + number[c]
    if len(letters) ** len(columns) <= 1 << 22:
        n = np.bincount(key)
        found = np.flatnonzero(n)
        n = n[found]
    else:
        found, n = np.unique(key, return_counts=True)
    out = []
    for _ in columns:
        out.append(letters[found % len(letters)])
        found = found // len(letters)
    return out[::-1], n


def _text(codes: np.ndarray) -> pa.Array:
    """Bytes as strings of one character; a zero byte as the empty string."""
    names = np.array(["", *map(chr, range(1, 256))], dtype=object)
    return pa.array(names[codes], pa.string())


def _positions(pairs: DataFrame) -> DataFrame:
    """Kinds of positions with their number ``n``: the bases of both sides there and beside it, '' beyond the ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, t, q in _blocks(batch):
                at = np.flatnonzero(t)
                kinds, n = _counted([x[at + shift] for shift in (0, -1, 1) for x in (t, q)])
                yield pa.RecordBatch.from_arrays([*map(_text, kinds), pa.array(n, pa.int64())], [*_PLACES, "n"])

    rows = pairs.select("target", "query").filter("length(target) > 0 and length(target) = length(query)")
    counts = rows.mapInArrow(count, ", ".join(f"{c} string" for c in _PLACES) + ", n long")
    return counts.groupBy(*_PLACES).agg(F.sum("n").alias("n"))


def error_matrix(pairs: DataFrame) -> DataFrame:
    """(target, query, n, total, rate) of the 5 x 5 kinds of pairs."""
    counts = _positions(pairs).groupBy(F.col("t").alias("target"), F.col("q").alias("query")).agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.withColumn("total", total.scalar()).withColumn("rate", ratio("n", "total"))


def _repeats(side: str) -> Column:
    """The base is that of a neighbour: an insertion or deletion within a homopolymer."""
    return (F.col(side) == F.col(f"{side}_before")) | (F.col(side) == F.col(f"{side}_after"))


def error_stats(pairs: DataFrame) -> DataFrame:
    """The ten counts of alignments, bases, mismatches, insertions and deletions, as one row."""
    deletion, insertion = F.col("q") == "-", F.col("t") == "-"
    part = lambda kind: F.coalesce(F.sum(F.when(kind, F.col("n"))), F.lit(0))
    found = _positions(pairs).agg(
        part(F.lit(True)).alias("bases"), part(~deletion & ~insertion & (F.col("t") != F.col("q"))).alias("mm"), part(deletion).alias("del"), part(insertion).alias("ins"),
        part(deletion & _repeats("t")).alias("hdel"), part(insertion & _repeats("q")).alias("hins"),
    )
    alignments = pairs.filter("length(target) > 0 and length(target) = length(query)").agg(F.count("*").alias("n"))
    s = {c: F.col(c) for c in ("bases", "mm", "del", "ins", "hdel", "hins")}
    out = {
        "ALIGNMENT_COUNT": alignments.scalar(), "ALIGNMENT_BASES": s["bases"], "ANY_ERROR": s["mm"] + s["del"] + s["ins"], "MISMATCHES": s["mm"], "ANY_DELETION": s["del"], "COMPLETE_DELETION": s["del"] - s["hdel"],
        "HOMOPOLYMER_DELETION": s["hdel"], "ANY_INSERTION": s["ins"], "COMPLETE_INSERTION": s["ins"] - s["hins"], "HOMOPOLYMER_INSERTION": s["hins"],
    }
    return found.select(*[c.alias(n) for n, c in out.items()])


def error_ratios(stats: DataFrame) -> DataFrame:
    """The six error columns of a run comparison."""
    bases = "ALIGNMENT_BASES"
    return stats.select(
        ratio("ANY_ERROR", bases).alias("any_error"), ratio("MISMATCHES", bases).alias("mismatches"), ratio("ANY_DELETION", bases).alias("deletions"), ratio("HOMOPOLYMER_DELETION", "ANY_DELETION").alias("homopolymer_deletions"),
        ratio("ANY_INSERTION", bases).alias("insertions"), ratio("HOMOPOLYMER_INSERTION", "ANY_INSERTION").alias("homopolymer_insertions"),
    )


def _between(pairs: DataFrame, side: str) -> DataFrame:
    """Positions at which ``side`` has a base between two others."""
    c = side[0]
    known = [(F.col(x) != "-") & (F.col(x) != "") for x in (c, f"{c}_before", f"{c}_after")]
    return _positions(pairs).filter(known[0] & known[1] & known[2])


def context_errors(pairs: DataFrame, side: str = "target") -> DataFrame:
    """(before, after, reference, query, n, rate): what a base of ``side`` between two others is on the other side.

    ``side`` 'target' tells what the reference's bases are read as, 'query' what the bases read stand for.
    """
    c, other = side[0], SIDES[side][0]
    counts = _between(pairs, side).groupBy(F.col(f"{c}_before").alias("before"), F.col(f"{c}_after").alias("after"), F.col(c).alias("reference"), F.col(other).alias("query")).agg(F.sum("n").alias("n"))
    every = F.sum("n").over(Window.partitionBy("before", "after", "reference"))
    return counts.withColumn("all", every).select("before", "after", "reference", "query", "n", ratio("n", "all").alias("rate"))


def contexts_per_alignment(pairs: DataFrame) -> DataFrame:
    """(aln_id, context, n): how often each target base between two others comes in each alignment; no shuffle."""
    id_type = pairs.schema["aln_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, begin, _, t, _ in _blocks(batch):
                known = (t != 0) & (t != ord("-"))
                at = np.flatnonzero(known[1:-1] & known[:-2] & known[2:]) + 1
                owner = np.searchsorted(begin, at, side="right") - 1
                key = ((owner << 24) | (t[at - 1].astype(np.int64) << 16) | (t[at].astype(np.int64) << 8) | t[at + 1]).astype(np.int64)
                found, n = np.unique(key, return_counts=True)
                three = [_text((found >> shift) & 255) for shift in (16, 8, 0)]
                context = pc.binary_join_element_wise(*three, "")
                yield pa.RecordBatch.from_arrays([batch.column("aln_id").take(pa.array(first + (found >> 24))), context, pa.array(n, pa.int64())], ["aln_id", "context", "n"])

    rows = pairs.select("aln_id", "target", "query").filter("length(target) > 0 and length(target) = length(query)")
    return rows.mapInArrow(count, f"aln_id {id_type}, context string, n long")


def least_context(contexts: DataFrame) -> DataFrame:
    """One row: the number of contexts seen and the count of the rarest one."""
    seen = contexts.groupBy("before", "after", "reference").agg(F.sum("n").alias("n"))
    return seen.agg(F.count("*").alias("contexts"), F.min("n").alias("least"))
