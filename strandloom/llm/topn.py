"""Top N items within every group, by partition lower bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import materialize

#: Rows kept in a task between two local rankings.
BUFFER_ROWS = 400_000


def _local_best(group: pa.Array, best: np.ndarray, item: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the first ``n`` distinct items of each group, and their ranks from 0.

    ``best`` has one row per sort key, each to be sorted ascending.
    """
    code = pc.dictionary_encode(group).indices.to_numpy(zero_copy_only=False)
    once = np.lexsort((*best[::-1], item, code))
    keep = np.ones(len(once), bool)
    keep[1:] = (code[once][1:] != code[once][:-1]) | (item[once][1:] != item[once][:-1])
    rows = once[keep]
    rows = rows[np.lexsort((item[rows], *best[::-1, rows], code[rows]))]
    start = np.ones(len(rows), bool)
    start[1:] = code[rows][1:] != code[rows][:-1]
    first = np.flatnonzero(start)
    rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    return rows[rank < n], rank[rank < n]


def top_n(df: DataFrame, group: str, item: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` distinct ``item`` values of every ``group``.

    ``order`` names integer columns, each sorted descending; ties go to the smaller
    ``item``. Returns (group, item, rank from 1).

    Each task first ranks its own rows; the local N-th best is a lower bound for its
    group. The largest bound of each group is joined back, rows below it are dropped
    and only the rest is ranked. A hot group sends at most N rows per task into the
    shuffle and about N rows into the rank.

    Defined cases: rows with a null group, item or order column take no part; an item
    that arrives again counts once, with its best values; a group with fewer items
    gives all of them; an empty table gives no rows; further columns are ignored,
    whatever their names.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    rows = df.select(F.col(group).alias("_g"), F.col(item).cast("long").alias("_i"), *[F.col(c).cast("long").alias(k) for c, k in zip(order, keys)]).dropna()
    group_type = rows.schema["_g"].dataType

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def ranked() -> tuple[pa.Table, np.ndarray]:
            t = pa.concat_tables(held).combine_chunks()
            columns = [t[c].to_numpy() for c in ("_i", *keys)]
            kept, rank = _local_best(t["_g"].chunk(0), -np.stack(columns[1:]), columns[0], n)
            return t.take(pa.array(kept)), rank

        limit = BUFFER_ROWS
        for b in batches:
            if b.num_rows:
                held.append(pa.Table.from_batches([b]))
                size += b.num_rows
            if size > limit:
                held = [ranked()[0]]
                size = held[0].num_rows
                limit = size + BUFFER_ROWS
        if held:
            t, rank = ranked()
            yield from t.append_column("_nth", pa.array(rank == n - 1)).to_batches(max_chunksize=50_000)

    schema = T.StructType([T.StructField("_g", group_type), *[T.StructField(c, T.LongType()) for c in ("_i", *keys)], T.StructField("_nth", T.BooleanType())])
    # Written once: the bounds and the survivors are both taken from it.
    best = materialize(rows.mapInArrow(local, schema), "best").withColumn("_key", F.struct(*keys, (-F.col("_i")).alias("_neg")))
    bounds = best.filter("_nth").groupBy("_g").agg(F.max("_key").alias("_bound"))
    survivors = best.join(bounds, "_g", "left").filter(F.col("_bound").isNull() | (F.col("_key") >= F.col("_bound")))
    once = survivors.groupBy("_g", "_i").agg(F.max("_key").alias("_key"))
    w = Window.partitionBy("_g").orderBy(F.col("_key").desc())
    return (
        once.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= n)
        .select(F.col("_g").alias(group), F.col("_i").alias(item), "rank")
    )
