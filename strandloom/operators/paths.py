"""Which alignments of a read form its path, and what kind of path it is."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import materialize


@dataclass(frozen=True)
class PathOptions:
    """Limits in force in the reference pipeline. A path is rejected beyond the query limits."""

    min_aligned_bases: int = 50
    max_query_overlap: int = 10
    max_query_gap: int = 500_000
    max_target_overlap: int = 10
    max_target_gap: int = 500_000


_COLUMNS = ["q_start", "aln_id", "q_end", "chrom", "strand", "t_start", "t_end", "aligned_bases"]


def _member(prefix: str = "") -> str:
    """An entry as a path member; in this order members sort by their place in the query."""
    return "struct(" + ", ".join(f"{prefix}{c} as {c}" for c in _COLUMNS) + ")"


def _fits(x: str, y: str, o: PathOptions) -> str:
    """Whether two entries may be in one path."""
    over = f"least({x}.q_end, {y}.q_end) - greatest({x}.q_start, {y}.q_start) <= {o.max_query_overlap}"
    return f"({over} and greatest({x}.q_start, {y}.q_start) - least({x}.q_end, {y}.q_end) <= {o.max_query_gap})"


def _classified(paths: DataFrame, o: PathOptions) -> DataFrame:
    """Adds read_type and total_bases to rows with ``members`` in query order.

    The first pair, in query order, whose targets overlap too far makes a self-chimera
    (opposite strands, one chromosome) or an atypical one; else a pair too far apart or on
    two chromosomes makes a chimera; else the path is gapped. Pairs are looked at one
    member at a time, so that a long path needs no list of them.
    """
    near = "{x}.chrom = y.chrom and least({x}.t_end, y.t_end) - greatest({x}.t_start, y.t_start) > " + str(o.max_target_overlap)
    far = "(members[i].chrom <> y.chrom or greatest(members[i].t_start, y.t_start) - least(members[i].t_end, y.t_end) > " + str(o.max_target_gap) + ")"
    later, each = "slice(members, {i} + 2, size(members))", "if(size(members) < 2, array(), sequence(0, size(members) - 2))"
    rows = paths.withColumn("_i", F.expr(f"get(filter({each}, i -> exists({later.format(i='i')}, y -> {near.format(x='members[i]')})), 0)"))
    rows = rows.withColumn("_x", F.expr("get(members, _i)")).withColumn("_y", F.expr(f"get(filter({later.format(i='_i')}, y -> {near.format(x='_x')}), 0)"))
    kind = F.expr(
        f"case when _i is not null and _x.strand <> _y.strand and size(array_distinct(transform(members, x -> x.chrom))) = 1 then 'self-chimera' "
        f"when _i is not null then 'self-chimera-atypical' when exists({each}, i -> exists({later.format(i='i')}, y -> {far})) then 'chimera' else 'gapped' end"
    )
    span = "aggregate(members, struct(cast(-1 as bigint) as e, cast(0 as bigint) as n), (a, x) -> struct(greatest(a.e, x.q_end) as e, a.n + greatest(0, x.q_end - greatest(a.e, x.q_start)) as n), a -> a.n)"
    return rows.withColumn("read_type", kind).withColumn("total_bases", F.expr(span)).drop("_i", "_x", "_y")


class _Chain:
    """A set of entries with its bases, its size and a link to the set without its last entry."""

    __slots__ = ("bases", "size", "entry", "rest")

    def __init__(self, bases: int, size: int, entry: int, rest: _Chain | None) -> None:
        self.bases, self.size, self.entry, self.rest = bases, size, entry, rest

    def entries(self) -> list[int]:
        out, at = [], self
        while at.rest:
            out.append(at.entry)
            at = at.rest
        return out

    def beats(self, other: _Chain, ids: np.ndarray) -> bool:
        """More aligned bases, then fewer entries, then the set whose sorted ids come first."""
        if self.bases != other.bases:
            return self.bases > other.bases
        if self.size != other.size:
            return self.size < other.size
        return sorted(ids[self.entries()]) < sorted(ids[other.entries()])


def _heaviest(rows: np.ndarray, start: np.ndarray, end: np.ndarray, bases: np.ndarray, ids: np.ndarray, slack: int, chain: _Chain) -> _Chain:
    """``chain`` with the best compatible entries among ``rows``, each longer than ``slack``.

    Of such entries, all pairs of a set are compatible if neighbours are.
    """
    rows = rows[np.lexsort((ids[rows], start[rows], end[rows]))]
    before = np.searchsorted(end[rows], start[rows] + slack, side="right").tolist()
    weight = bases[rows].tolist()
    upto = [chain]
    for i, (entry, j) in enumerate(zip(rows.tolist(), before)):
        last = upto[j]
        here = _Chain(last.bases + weight[i], last.size + 1, entry, last)
        upto.append(here if here.beats(upto[i], ids) else upto[i])
    return upto[-1]


def best_path(best: tuple[int, int], start: np.ndarray, end: np.ndarray, bases: np.ndarray, ids: np.ndarray, o: PathOptions) -> list[int]:
    """Row numbers of the entries that make the best path with the entry of query range ``best``; each of them fits it.

    A set keeps within the largest gap if its last start is at most that gap beyond its
    first end; so every end at which a path may begin is tried, where not all fit into one.
    Entries no longer than the allowed overlap fit any other one.
    """
    slack, gap = o.max_query_overlap, o.max_query_gap
    bound = max(int(start.max()), best[0]) - gap
    ends = np.unique(np.append(end, best[1]))
    ends = ends[(ends <= best[1]) & (ends >= best[0] - gap)]
    ends = np.append(ends[ends < bound], ends[ends >= bound][:1])
    short = end - start <= slack
    found = None
    for least in ends.tolist():
        inside = (end >= least) & (start <= least + gap)
        chain = _Chain(0, 0, -1, None)
        for i in np.flatnonzero(inside & short).tolist():
            chain = _Chain(chain.bases + int(bases[i]), chain.size + 1, i, chain)
        chain = _heaviest(np.flatnonzero(inside & ~short), start, end, bases, ids, slack, chain)
        if found is None or chain.beats(found, ids):
            found = chain
    return found.entries() if found else []


def _chosen(fitting: DataFrame, o: PathOptions) -> DataFrame:
    """(qname, best, chosen) of rows (qname, best, fitting): of the entries that fit the best one those on its path."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, lists = b.column("best"), b.column("fitting")
            values = lists.flatten()
            start, end, bases, ids = (values.field(c).to_numpy(zero_copy_only=False) for c in ("q_start", "q_end", "aligned_bases", "aln_id"))
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            heads = zip(best.field("q_start").to_pylist(), best.field("q_end").to_pylist())
            taken = [lo + np.array(best_path(head, start[lo:hi], end[lo:hi], bases[lo:hi], ids[lo:hi], o), np.int64) for head, lo, hi in zip(heads, offsets[:-1], offsets[1:])]
            sizes = np.append(0, np.cumsum([len(t) for t in taken])).astype(np.int32)
            chosen = values.take(pa.array(np.concatenate([*taken, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column("qname"), best, pa.ListArray.from_arrays(pa.array(sizes), chosen)], ["qname", "best", "chosen"])

    entry = fitting.schema["best"].dataType.simpleString()
    return fitting.select("qname", "best", "fitting").mapInArrow(solve, f"qname string, best {entry}, chosen array<{entry}>")


def resolve_paths(entries: DataFrame, options: PathOptions | None = None) -> DataFrame:
    """(qname, read_type, single_bases, total_bases, qlen, members) of every read.

    ``members`` are the aln_ids of the path in query order: the best entry with the
    compatible entries of most aligned bases; fewer members win a tie, then the set
    whose ids come first. A read without aligned entries is 'unaligned'; one whose best
    entry nothing fits is 'original'. Of a read with one aligned entry, both lengths are
    its aligned bases; else the query span of the best entry and the union of the query
    spans of the path. qlen is the longest one.

    Equal rows count once; a null qname takes no part; entries without query positions
    fit nothing; an empty table gives no rows; further columns are ignored.

    The best entry is found by partial minima. Rows are joined with it, which AQE may
    split for a read of very many, and only those that fit it go on; of one query range
    only the heaviest (then the first) can be on the path, so a read is gathered as its
    distinct fitting ranges, whose number its length bounds.
    """
    o = options or PathOptions()
    rows = entries.select("qname", "flag", "qlen", *_COLUMNS).filter("qname is not null")
    aligned = F.col("aligned_bases") > 0
    primary = F.when(F.col("flag").bitwiseAND(2304) == 0, 0).otherwise(1)
    first = F.min(F.when(aligned, F.struct(primary.alias("s"), "aln_id", F.expr(_member()).alias("m"))))
    ids = F.when(aligned, F.col("aln_id"))
    summary = rows.groupBy("qname").agg(first.alias("b"), (F.min(ids) == F.max(ids)).alias("one"), F.max("qlen").alias("qlen")).select("qname", F.col("b.m").alias("best"), "one", "qlen")
    summary = materialize(summary, "reads")

    heads = summary.filter(f"not one and best.aligned_bases >= {o.min_aligned_bases}").select("qname", "best")
    long_enough = rows.filter(F.col("aligned_bases") >= o.min_aligned_bases).select("qname", F.expr(_member()).alias("x"))
    near = long_enough.join(heads, "qname").filter(f"x.aln_id <> best.aln_id and {_fits('x', 'best', o)}").select("qname", "best", "x", F.expr("x.q_start as s"), F.expr("x.q_end as e"))
    # Spread by range, so that neither the join nor this grouping gathers a read's rows in one task.
    short = f"e - s <= {o.max_query_overlap}"
    ranges = near.repartition("qname", "s", "e").groupBy("qname", "s", "e").agg(
        F.first("best").alias("best"), F.max(F.when(~F.expr(short), F.struct("x.aligned_bases", (-F.col("x.aln_id")).alias("i"), "x"))).alias("heaviest"), F.collect_set(F.when(F.expr(short), F.col("x"))).alias("short")
    )
    fitting = ranges.groupBy("qname").agg(F.first("best").alias("best"), F.flatten(F.collect_list(F.when(F.expr(short), F.col("short")).otherwise(F.array("heaviest.x")))).alias("fitting"))
    solved = _chosen(fitting, o).select("qname", F.array_sort(F.concat(F.array("best"), "chosen")).alias("path"))

    reads = summary.join(solved, "qname", "left").withColumn("members", F.coalesce("path", F.array("best")))
    typed = _classified(reads, o)
    span, zero, path = F.col("best.q_end") - F.col("best.q_start"), F.lit(0).cast("long"), F.col("path").isNotNull()
    nothing = F.col("best").isNull()
    return typed.select(
        "qname",
        F.when(nothing, "unaligned").when(path, F.col("read_type")).otherwise("original").alias("read_type"),
        F.when(nothing, zero).when(F.col("one"), F.col("best.aligned_bases")).otherwise(span).alias("single_bases"),
        F.when(nothing, zero).when(F.col("one"), F.col("best.aligned_bases")).when(path, F.col("total_bases")).otherwise(span).alias("total_bases"),
        "qlen",
        F.when(nothing, F.array().cast("array<bigint>")).otherwise(F.transform("members", lambda m: m["aln_id"])).alias("members"),
    )
