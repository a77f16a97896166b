"""Exact percentiles of very large groups by distributed multi-select."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import discard, materialize

#: Candidates of which a task proposes medians at once; it bounds what a task holds.
CHUNK_ROWS = 1 << 18


def weighted_values(df: DataFrame, groups: list[str], metrics: list[str]) -> DataFrame:
    """Value frequencies (groups, metric, value, weight): the result of one day or partition.

    These tables combine by adding the weights of equal values. Nulls and values
    below 0 are left out; a null in a group column is a group of its own.
    """
    stacked = df.select(*groups, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("value")) for m in metrics])).alias("_m"))
    return stacked.select(*groups, "_m.metric", "_m.value").filter("value >= 0").groupBy(*groups, "metric", "value").agg(F.count("*").alias("weight"))


def combine(weighted: DataFrame, by: list[str | Column]) -> DataFrame:
    """Add up the weights of equal values over the new groups ``by``."""
    return weighted.groupBy(*by, "metric", "value").agg(F.sum("weight").alias("weight"))


def _null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> Column:
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def _medians(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The weighted median of each range (gid, lo) among these candidates, with their weight."""
    t = pa.Table.from_batches(held)
    gid, lo, value, weight = (t[c].to_numpy() for c in ("gid", "lo", "value", "weight"))
    order = np.lexsort((value, lo, gid))
    gid, lo, value, weight = gid[order], lo[order], value[order], weight[order]
    first = np.flatnonzero(np.append(True, (gid[1:] != gid[:-1]) | (lo[1:] != lo[:-1])))
    upto = np.cumsum(weight)
    before = np.append(0, upto)[first]
    total = np.add.reduceat(weight, first)
    at = np.searchsorted(upto, before + (total + 1) // 2)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (gid[first], lo[first], value[at], total)], ["gid", "lo", "value", "weight"])


def _local_medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proposals of a task: the medians of its candidates, CHUNK_ROWS at a time."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= CHUNK_ROWS:
            yield _medians(held)
            held, size = [], 0
    if held:
        yield _medians(held)


def multi_select(weighted: DataFrame, groups: list[str], percents: list[int]) -> DataFrame:
    """The exact percentiles of every group of a :func:`weighted_values` table.

    Percentile p of n values is the value of rank ceil(p * n / 100), at least 1.
    Returns (groups, metric, n, pct, value).

    A range of a group's candidate values, named by the value below it, holds the ranks
    of one or more percentiles. In each round every task proposes the weighted medians of
    its candidates of each range; the weighted median of the proposals is the range's
    pivot; the weights below and at it are counted; a percentile whose rank falls on the
    pivot is found, the others go on in the range below or above it, and ranges that hold
    no rank are discarded. At least a quarter of a range's weight is at or beyond the
    pivot on either side, so a range shrinks to half as a rule. The rounds end when all
    ranks are found; the rank error is 0.
    """
    keys = [*groups, "metric"]
    named = materialize(weighted.groupBy(*keys).agg(F.sum("weight").alias("n")).withColumn("gid", F.monotonically_increasing_id()), "groups")
    lowest = F.lit(-(2**63)).cast("long").alias("lo")
    candidates = materialize(weighted.join(named, _null_safe(weighted, named, keys)).select(named["gid"], lowest, weighted["value"], weighted["weight"]), "candidates")
    targets = named.select("gid", lowest, F.explode(F.array(*[F.lit(p) for p in percents])).alias("pct"), "n")
    targets = targets.select("gid", "lo", "pct", F.greatest(F.lit(1), F.expr("(n * pct + 99) div 100")).alias("rank"))
    of = ["gid", "lo"]
    w = Window.partitionBy(*of)
    found: list[DataFrame] = []
    while True:
        proposals = candidates.mapInArrow(_local_medians, "gid long, lo long, value long, weight long")
        upto, total = F.sum("weight").over(w.orderBy("value")), F.sum("weight").over(w)
        pivots = proposals.withColumn("upto", upto).withColumn("all", total).filter("2 * upto >= all").groupBy(*of).agg(F.min("value").alias("pivot"))
        below, above = F.col("value") < F.col("pivot"), F.col("value") > F.col("pivot")
        counts = candidates.join(pivots, of).groupBy(*of, "pivot").agg(
            F.sum(F.when(below, F.col("weight")).otherwise(0)).alias("w_below"), F.sum(F.when(~above, F.col("weight")).otherwise(0)).alias("w_upto")
        )
        side = F.when(F.col("rank") <= F.col("w_below"), -1).when(F.col("rank") > F.col("w_upto"), 1).otherwise(0)
        decided = materialize(targets.join(counts, of).withColumn("side", side), "pivots")
        found.append(decided.filter("side = 0").select("gid", "pct", F.col("pivot").alias("value")))
        on = decided.filter("side <> 0")
        if on.isEmpty():
            break
        after = F.when(F.col("side") < 0, F.col("lo")).otherwise(F.col("pivot")).alias("lo")
        targets = on.select("gid", after, "pct", F.when(F.col("side") < 0, F.col("rank")).otherwise(F.col("rank") - F.col("w_upto")).alias("rank"))
        ranges = on.groupBy(*of, "pivot").agg(F.max(F.col("side") < 0).alias("goes_below"), F.max(F.col("side") > 0).alias("goes_above"))
        rest = candidates.join(ranges, of).filter((F.col("goes_below") & below) | (F.col("goes_above") & above))
        before, candidates = candidates, materialize(rest.select("gid", F.when(below, F.col("lo")).otherwise(F.col("pivot")).alias("lo"), "value", "weight"), "candidates")
        discard(before)
    discard(candidates)
    return reduce(DataFrame.unionByName, found).join(named, "gid").select(*keys, "n", "pct", "value")


def day_and_union_percentiles(df: DataFrame, identity: list[str], day: str, by: str, metrics: list[str], percents: list[int], unions: dict[str, Column]) -> DataFrame:
    """Percentiles of each (union, ``by``) from day tables that are computed apart.

    ``identity`` names the columns that make a row the same one when it arrives again;
    it then counts once. ``unions`` maps a scope's name to the expression that gives
    the union of a day. Returns (scope, period, by, metric, n, p<percent>...).
    A null day or ``by`` is a group of its own; an empty table gives no rows; further
    columns are ignored.
    """
    rows = df.select(*identity).dropDuplicates()
    days = materialize(weighted_values(rows, [day, by], metrics), "days")
    scoped = days.select(F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), e.cast("string").alias("period")) for s, e in unions.items()])).alias("_u"), by, "metric", "value", "weight")
    united = combine(scoped.select("_u.scope", "_u.period", by, "metric", "value", "weight"), ["scope", "period", by])
    picked = multi_select(united, ["scope", "period", by], percents)
    discard(days)  # the result is read from the groups and pivots
    return picked.groupBy("scope", "period", by, "metric", "n").agg(*[F.max(F.when(F.col("pct") == p, F.col("value"))).alias(f"p{p}") for p in percents])
