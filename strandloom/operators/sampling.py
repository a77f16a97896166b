"""Deterministic draws: rarefaction curves, downsampling and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The grid 1, 2, 3, 4, 5, 10, 20, 30, 40, 50, 100, ... up to 10**17.
GRID = [1] + [m * 10**e for e in range(17) for m in (2, 3, 4, 5, 10)]

#: Hexadecimal digits of a row's place in a draw order, and the number of places.
DIGITS = 15
PLACES = 16**DIGITS
BUCKETS = 1024


def mix(key: Column, sample: Column) -> Column:
    """Pseudo-random place of a row in a sample's order, 0 to PLACES - 1.

    The first digits of the MD5 of "key:sample", so that samples are independent of one
    another and another engine can replay them.
    """
    digest = F.md5(F.concat_ws(":", key.cast("string"), sample.cast("string")))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def draw_ranks(df: DataFrame, key: str, samples: int, buckets: int = BUCKETS) -> DataFrame:
    """``samples`` shuffles of the rows: each row's ``rank`` from 1 within each ``sample``.

    A shuffle is ranked in ``buckets`` ranges of its order: the counts of the ranges
    before (at most ``buckets`` numbers per sample) plus the rank within the range, so
    no task sorts a whole sample.
    """
    rows = df.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("_at", mix(F.col(key), F.col("sample")))
    rows = rows.withColumn("_bucket", F.expr(f"_at div {PLACES // buckets + 1}"))
    sizes = rows.groupBy("sample", "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select("sample", "_bucket", (F.sum("_n").over(Window.partitionBy("sample").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("sample", "_bucket").orderBy("_at", key))
    ranked = rows.withColumn("_inside", inside).join(before, ["sample", "_bucket"])
    return ranked.withColumn("rank", F.col("_before") + F.col("_inside")).drop("_at", "_bucket", "_before", "_inside")


def with_null_draws(df: DataFrame, name: str, key: str, value: str, reads: DataFrame) -> DataFrame:
    """(key, value): the rows of ``df`` and a null draw of each read of ``reads`` (``name``, each once) that ``df`` lacks.

    A null draw's key is made of its name, so that it has its place in the draw order without
    a count over the reads. More rows than reads are an error.
    """
    counts = [x.agg(F.count("*").alias("n")) for x in (df, reads)]
    fits = F.when(counts[0].scalar() <= counts[1].scalar(), F.lit(True)).otherwise(F.raise_error(F.lit("more annotated reads than reads")).cast("boolean"))
    place = F.conv(F.substring(F.md5(F.coalesce(name, F.lit(""))), 1, 15), 16, 10).cast("long")
    missing = reads.join(df.select(name).distinct(), name, "left_anti").select(place.alias(key), F.lit(None).cast(df.schema[value].dataType).alias(value))
    return df.select(key, value).unionByName(missing).filter(fits)


def rarefaction(df: DataFrame, key: str, value: str, samples: int = 10, min_depth: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(x, lower, median, upper): distinct values with at least ``min_depth`` of the first x draws.

    Rows with a null value are draws that find nothing. One pass: a value counts from
    the rank of its ``min_depth``-th draw on; the counts of the grid points follow by a
    running sum over the grid.
    """
    total = df.agg(F.count("*").alias("n"))
    found = draw_ranks(df.select(key, value), key, samples, buckets).filter(F.col(value).isNotNull())
    if min_depth == 1:
        first = found.groupBy("sample", value).agg(F.min("rank").alias("rank"))
    else:
        nth = F.row_number().over(Window.partitionBy("sample", value).orderBy("rank"))
        first = found.withColumn("_nth", nth).filter(F.col("_nth") <= min_depth).filter(F.col("_nth") == min_depth)
    grid = F.array(*[F.lit(g).cast("long") for g in GRID])
    upto = F.array_min(F.filter(grid, lambda g: g >= F.col("rank")))
    reached = first.select("sample", F.least(upto, total.scalar()).alias("x")).groupBy("sample", "x").agg(F.count("*").alias("n"))
    axis = total.select(F.explode(F.array_union(F.filter(grid, lambda g: g < F.col("n")), F.array("n"))).alias("x"), F.sequence(F.lit(0), F.lit(samples - 1)).alias("s")).filter("x > 0")
    axis = axis.select("x", F.explode("s").alias("sample"))
    running = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("sample").orderBy("x"))
    counts = axis.join(reached, ["sample", "x"], "left").select("x", "sample", running.alias("n"))
    sorted_counts = counts.groupBy("x").agg(F.sort_array(F.collect_list("n")).alias("c"), F.median("n").alias("median"))
    return sorted_counts.select("x", F.col("c")[int(samples * 0.05)].alias("lower"), "median", F.col("c")[int(samples * 0.95)].alias("upper"))


def downsample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The first ``n`` rows of the draw order (all, if there are fewer), found by order ranges; no task holds all of them."""
    return within_budget(df.withColumn("_one", F.lit(1)), key, "_one", n, seed).drop("_one")


def downsample_groups(df: DataFrame, groups: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` rows of each group; a task sends at most ``n`` rows of a group into the shuffle."""
    w = Window.partitionBy(*groups).orderBy(mix(F.col(key), F.lit(seed)), key)
    return df.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= n).drop("_nth")


def until_every_value(df: DataFrame, key: str, value: str, count: str, n: int, buckets: int = BUCKETS) -> DataFrame:
    """Keys in draw order until every value has been seen ``n`` times: (key, rank).

    ``df`` has one row per key and value with its ``count``. A value's end is looked for in
    the order range in which its running sum reaches ``n``; a value that never does asks for
    all keys.
    """
    keys = draw_ranks(df.select(key).distinct(), key, 1, buckets).select(key, "rank")
    ranked = df.join(keys, key).withColumn("_range", F.expr("rank div 1024"))
    sums = ranked.groupBy(value, "_range").agg(F.sum(count).alias("_sum"))
    w = Window.partitionBy(value).orderBy("_range")
    ends = sums.withColumn("_upto", F.sum("_sum").over(w)).filter(F.col("_upto") >= n).groupBy(value).agg(F.min_by(F.struct("_range", (F.col("_upto") - F.col("_sum")).alias("before")), "_range").alias("end"))
    last = ranked.join(ends.select(value, F.col("end._range").alias("_range"), F.col("end.before").alias("_before")), [value, "_range"])
    inside = F.col("_before") + F.sum(count).over(Window.partitionBy(value).orderBy("rank"))
    stops = last.withColumn("_upto", inside).filter(F.col("_upto") >= n).groupBy(value).agg(F.min("rank").alias("stop"))
    every = df.select(value).distinct().join(stops, value, "left").agg(F.max("stop").alias("stop"), F.count_if(F.col("stop").isNull()).alias("open"))
    stop = every.select(F.when(F.col("open") == 0, F.col("stop")).otherwise(F.lit(2**62)).alias("stop"))
    return keys.filter(F.col("rank") <= stop.scalar())


def within_budget(df: DataFrame, key: str, size: str, budget: int, seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """Rows in draw order until the running sum of ``size`` reaches ``budget``; the row that reaches it is the last.

    Sums of order ranges first, so that only ranges that can hold the end are sorted.
    """
    rows = df.withColumn("_at", mix(F.col(key), F.lit(seed))).withColumn("_bucket", F.expr(f"_at div {PLACES // buckets + 1}"))
    sizes = rows.groupBy("_bucket").agg(F.sum(size).alias("_sum"))
    before = sizes.select("_bucket", F.coalesce(F.sum("_sum").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")).filter(F.col("_before") < budget)
    inside = F.coalesce(F.sum(size).over(Window.partitionBy("_bucket").orderBy("_at", key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(before, "_bucket").withColumn("_upto", F.col("_before") + inside).filter(F.col("_upto") < budget).drop("_at", "_bucket", "_before", "_upto")
