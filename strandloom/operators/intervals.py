"""Interval algebra on half-open intervals, in tiles of the coordinate axis.

Every sweep cuts its intervals at tile borders first and sorts within (keys, tile), so
that one chromosome, which may hold a third of all rows, is worked on by many tasks.
Pieces that touch a border are stitched afterwards; there are at most two per tile.
Rows with a null key or bound, and intervals that aren't at least 1 long, take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 1 << 18


def _clean(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    return df.dropna(subset=[*keys, start, end]).filter(F.col(start) < F.col(end))


def cut_at_tiles(df: DataFrame, tile: int = TILE) -> DataFrame:
    """Each interval once per tile it lies in, clipped to the tile (column ``_tile``)."""
    cut = df.withColumn("_tile", F.explode(F.sequence(F.expr(f"start div {tile}"), F.expr(f"(end - 1) div {tile}"))))
    return cut.withColumn("start", F.greatest("start", F.col("_tile") * tile)).withColumn("end", F.least("end", (F.col("_tile") + 1) * tile))


def stitch(pieces: DataFrame, keys: list[str], same: list[str], tile: int = TILE) -> DataFrame:
    """Join pieces of (keys, start, end, same...) that touch at a tile border and agree in ``same``."""
    at_border = (F.col("start") % tile == 0) | (F.col("end") % tile == 0)
    w = Window.partitionBy(*keys).orderBy("start", "end")
    joins = reduce(lambda a, b: a & b, [F.lag(c).over(w) == F.col(c) for c in same], F.lag("end").over(w) == F.col("start"))
    chained = pieces.filter(at_border).withColumn("_new", F.when(joins, 0).otherwise(1))
    chained = chained.withColumn("_chain", F.sum("_new").over(w))
    joined = chained.groupBy(*keys, "_chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), *[F.first(c).alias(c) for c in same])
    columns = [*keys, "start", "end", *same]
    return pieces.filter(~at_border).select(*columns).unionByName(joined.select(*columns))


def merge(df: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """Union of the intervals of each key, touching ones joined: (keys, start, end)."""
    cut = cut_at_tiles(_clean(df.select(*keys, "start", "end"), keys), tile).distinct()
    w = Window.partitionBy(*keys, "_tile").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = cut.withColumn("_new", F.when(before >= F.col("start"), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w))
    pieces = islands.groupBy(*keys, "_tile", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return stitch(pieces, keys, [], tile)


def _sweep(cut: DataFrame, keys: list[str], weights: dict[str, Column]) -> DataFrame:
    """Segments between neighbouring bounds of each tile with the running sum of each weight."""
    bounds = cut.select(*keys, "_tile", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("sign")))).alias("_b"), *[w.alias(n) for n, w in weights.items()])
    steps = bounds.groupBy(*keys, "_tile", F.col("_b.at").alias("start")).agg(*[F.sum(F.col(n) * F.col("_b.sign")).alias(n) for n in weights])
    changed = reduce(lambda a, b: a | b, [F.col(n) != 0 for n in weights])
    w = Window.partitionBy(*keys, "_tile").orderBy("start")
    return steps.filter(changed).select(*keys, "_tile", "start", F.lead("start").over(w).alias("end"), *[F.sum(n).over(w).alias(n) for n in weights]).filter("end is not null")


def depth(df: DataFrame, keys: list[str], weight: Column | None = None, tile: int = TILE) -> DataFrame:
    """Maximal segments of constant depth above 0: (keys, start, end, depth).

    ``weight`` counts an interval so many times. Equal intervals are added up before
    they are cut.
    """
    rows = _clean(df.select(*keys, "start", "end", (weight if weight is not None else F.lit(1)).cast("long").alias("_w")), keys)
    rows = rows.groupBy(*keys, "start", "end").agg(F.sum("_w").alias("_w"))
    segments = _sweep(cut_at_tiles(rows, tile), keys, {"depth": F.col("_w")})
    return stitch(segments.filter("depth > 0"), keys, ["depth"], tile)


def subtract(a: DataFrame, b: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """What the intervals of ``a`` cover and those of ``b`` don't: (keys, start, end), disjoint."""
    both = merge(a, keys, tile).withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0)).unionByName(merge(b, keys, tile).withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1)))
    segments = _sweep(cut_at_tiles(both, tile), keys, {"in_a": F.col("_a"), "in_b": F.col("_b")})
    return stitch(segments.filter("in_a > 0 and in_b = 0"), keys, [], tile)


def layers(sources: dict[str, DataFrame], keys: list[str], tile: int = TILE) -> DataFrame:
    """Disjoint pieces (keys, start, end, kind): each place belongs to the first source that covers it.

    One sweep over all sources; neighbouring pieces of one kind are joined.
    """
    names = list(sources)
    tagged = [_clean(d.select(*keys, "start", "end"), keys).withColumn("_of", F.lit(n)) for n, d in sources.items()]
    rows = reduce(DataFrame.unionByName, tagged).distinct()
    segments = _sweep(cut_at_tiles(rows, tile), keys, {f"_n{i}": (F.col("_of") == n).cast("int") for i, n in enumerate(names)})
    kind = F.coalesce(*[F.when(F.col(f"_n{i}") > 0, F.lit(n)) for i, n in enumerate(names)])
    pieces = segments.select(*keys, "_tile", "start", "end", kind.alias("kind")).filter("kind is not null")
    w = Window.partitionBy(*keys, "_tile").orderBy("start")
    goes_on = (F.lag("end").over(w) == F.col("start")) & (F.lag("kind").over(w) == F.col("kind"))
    runs = pieces.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    joined = runs.groupBy(*keys, "_tile", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("kind").alias("kind"))
    return stitch(joined, keys, ["kind"], tile)


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Pairs of overlapping intervals; ``right`` has its bounds as r_start and r_end.

    Both sides are joined on (keys, tile); a pair is kept in the tile where its
    intersection begins only, so that none comes twice. Choose ``tile`` about as long
    as a common interval of the larger side. A tile with very many rows of one side is
    split by AQE's skew join where a shuffle follows, as one does in all groupings here.
    """
    a = _clean(left, keys).withColumn("_tile", F.explode(F.sequence(F.expr(f"start div {tile}"), F.expr(f"(end - 1) div {tile}"))))
    b = _clean(right, keys, "r_start", "r_end").withColumn("_tile", F.explode(F.sequence(F.expr(f"r_start div {tile}"), F.expr(f"(r_end - 1) div {tile}"))))
    pairs = a.join(b, [*keys, "_tile"]).filter("start < r_end and r_start < end")
    return pairs.filter(F.expr(f"greatest(start, r_start) div {tile} = _tile")).drop("_tile")


def overlap_size() -> Column:
    """Length of the intersection of (start, end) and (r_start, r_end)."""
    return F.least("end", "r_end") - F.greatest("start", "r_start")


def nearest(points: DataFrame, sites: DataFrame, keys: list[str], window: int) -> DataFrame:
    """For every distinct (keys, pos) the site within ``window`` that is nearest, the smaller on ties.

    ``sites`` has (keys, site). Returns (keys, pos, site). A point looks into its own
    band and the two next to it, so that no site within the window is missed.
    """
    width = window + 1
    p = points.select(*keys, "pos").dropna().distinct().withColumn("_band", F.explode(F.expr(f"sequence(floor(pos / {width}) - 1, floor(pos / {width}) + 1)")))
    s = sites.select(*keys, "site").dropna().distinct().withColumn("_band", F.expr(f"floor(site / {width})"))
    near = p.join(s, [*keys, "_band"]).filter(F.abs(F.col("pos") - F.col("site")) <= window)
    return near.groupBy(*keys, "pos").agg(F.min_by("site", F.struct(F.abs(F.col("pos") - F.col("site")), F.col("site"))).alias("site"))


def clusters(df: DataFrame, keys: list[str], label: str = "cluster", tile: int = TILE) -> DataFrame:
    """Rows of ``df`` with the maximal run of overlapping or touching intervals each lies in.

    Adds ``label``_start and ``label``_end, which name the run within its keys.
    """
    runs = merge(df, keys, tile).withColumnsRenamed({"start": f"{label}_start", "end": f"{label}_end"})
    cut = cut_at_tiles(runs.withColumnsRenamed({f"{label}_start": "start", f"{label}_end": "end"}).withColumn("s", F.col("start")).withColumn("e", F.col("end")), tile)
    tiles = cut.select(*keys, "_tile", F.col("start").alias("_from"), F.col("s").alias(f"{label}_start"), F.col("e").alias(f"{label}_end"), F.col("end").alias("_to"))
    rows = _clean(df, keys).withColumn("_tile", F.expr(f"start div {tile}"))
    inside = rows.join(tiles, [*keys, "_tile"]).filter("start >= _from and start < _to")
    return inside.drop("_tile", "_from", "_to")
