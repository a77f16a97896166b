"""Fixed-size uniform sample of data that arrives in pieces."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows for which there is one hash part; a reservoir has the keys of one part and arrival piece.
PART_ROWS = 1 << 17
#: Reservoirs merged in one group per level, as bits; four levels cover every int number of a piece or part.
FAN_IN_BITS = 8
#: Rows of which a task drops repeated keys before they are sent.
BUFFER_ROWS = 1 << 18


def _rng(*key: object) -> random.Random:
    return random.Random(hashlib.blake2b(repr(key).encode(), digest_size=16).digest())


class _Reservoir:
    """Skip-based reservoir: only the rows that enter it are looked at."""

    def __init__(self, k: int, *key: object) -> None:
        self.k, self.rng, self.seen, self.items, self.next, self.w = k, _rng(*key), 0, [], -1, 1.0

    def _skip(self) -> None:
        self.w *= math.exp(math.log(1.0 - self.rng.random()) / self.k)
        step = math.log(1.0 - self.rng.random()) / math.log1p(-self.w) if self.w < 1.0 else 0.0
        self.next += int(step) + 1

    def add(self, values: pa.Array) -> None:
        begin, end = self.seen, self.seen + len(values)
        fill = min(self.k - len(self.items), len(values))
        if fill > 0:
            self.items += values.slice(0, fill).to_pylist()
            if len(self.items) == self.k:
                self.next = begin + fill - 1
                self._skip()
        while len(self.items) == self.k and begin <= self.next < end:
            self.items[self.rng.randrange(self.k)] = values[self.next - begin].as_py()
            self._skip()
        self.seen = end

    def shuffled(self) -> list:
        self.rng.shuffle(self.items)
        return self.items


def parts_of(df: DataFrame) -> int:
    """Hash parts for a table: a power of 2 that grows with its rows, so that an arrival piece of any size is worked on by many tasks."""
    return 1 << max(0, (df.count() - 1) // PART_ROWS).bit_length()


def _first_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each key once, with its first piece, for BUFFER_ROWS rows at a time, so that a key with a third of all rows is sent a few times only."""

    def once(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        found = pa.Table.from_batches(held).group_by("item").aggregate([("piece", "min")]).rename_columns(["item", "piece"])
        return found.combine_chunks().to_batches()

    held, rows = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= BUFFER_ROWS:
            yield from once(held)
            held, rows = [], 0
    if held:
        yield from once(held)


def reservoirs(df: DataFrame, key: str, piece: str, k: int, seed: int = 0, parts: int | None = None) -> DataFrame:
    """One reservoir of at most ``k`` distinct keys per arrival piece and hash part.

    Returns (piece, part, population, pos, item): ``population`` is the number of
    distinct keys that the reservoir stands for, ``pos`` a random order within it.
    A key belongs to the first piece in which it came, so the pieces' populations are
    disjoint and reservoirs of later pieces can be made and merged later, given the
    keys seen before. Null keys take no part; a null piece counts as piece -1.

    One shuffle, by hash part: repeated keys are dropped in the tasks before it and again
    after it, and the reservoirs are filled in the same tasks.
    """
    parts = parts or parts_of(df)
    rows = df.select(F.col(key).cast("string").alias("item"), F.coalesce(F.col(piece).cast("int"), F.lit(-1)).alias("piece")).filter("item is not null")
    sent = rows.mapInArrow(_first_pieces, "item string, piece int").withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int"))
    keys = sent.repartition("part").groupBy("part", "item").agg(F.min("piece").alias("piece"))
    ordered = keys.sortWithinPartitions("piece", "part", "item").select("piece", "part", "item")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None

        def out() -> pa.RecordBatch:
            items, m = held.shuffled(), len(held.items)
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]] * m, pa.int32()), pa.array([at[1]] * m, pa.int32()), pa.array([held.seen] * m, pa.int64()), pa.array(range(m), pa.int32()), pa.array(items, pa.string())],
                ["piece", "part", "population", "pos", "item"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            piece_no, part_no = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(piece_no) != 0) | (np.diff(part_no) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
                here = (int(piece_no[i]), int(part_no[i]))
                if here != at:
                    if held:
                        yield out()
                    at, held = here, _Reservoir(k, seed, "fill", *here)
                held.add(b.column(2).slice(i, j - i))
        if held:
            yield out()

    return ordered.mapInArrow(draw, "piece int, part int, population long, pos int, item string")


def merge_reservoirs(found: DataFrame, into: list[str], k: int, seed: int = 0, level: str = "merge") -> DataFrame:
    """Merge the reservoirs that agree in the columns ``into``.

    How many items each reservoir gives is a multivariate hypergeometric draw in
    proportion to the populations: ``k`` distinct numbers out of the united
    population, counted by reservoir; the number columns besides ``into`` tell them apart. A group
    holds at most (its reservoirs) x ``k`` rows. Returns (into, population, pos, item).
    """
    others = [c for c in ("below", "piece", "part") if c in found.columns and c not in into]

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = _rng(seed, level, *(int(pdf[c].iloc[0]) for c in into))
        pdf = pdf.sort_values([*others, "pos"])
        ids = pdf.groupby(others, sort=True).ngroup().to_numpy()
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        sizes = pdf["population"].to_numpy()[first]
        total = int(sizes.sum())
        draws = np.array(rng.sample(range(total), min(k, total)), dtype=np.int64)
        take = np.bincount(np.searchsorted(np.cumsum(sizes), draws, side="right"), minlength=len(sizes))
        pos = np.arange(len(pdf)) - first[ids]
        items = pdf["item"].to_numpy()[pos < take[ids]].tolist()
        rng.shuffle(items)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in into}, "population": total, "pos": np.arange(len(items)), "item": items})

    schema = ", ".join([f"{c} int" for c in into] + ["population long", "pos int", "item string"])
    return found.groupBy(*into).applyInPandas(merge, schema)


def _merged_up(found: DataFrame, node: str, others: list[str], k: int, seed: int, bits: int) -> DataFrame:
    """Merge reservoirs by the number ``node``, FAN_IN_BITS of its ``bits`` at a time, until one is left per ``others``."""
    other = "part" if node == "piece" else "piece"
    for level in range(-(-bits // FAN_IN_BITS)):
        last = (level + 1) * FAN_IN_BITS >= bits
        up = found.withColumn("below", F.col(node)).withColumn(node, F.lit(0) if last else F.shiftright(node, FAN_IN_BITS))
        found = merge_reservoirs(up, [node, *others], k, seed, f"{node}{level}")
        if other not in others:
            found = found.withColumn(other, F.lit(0))
    return found


def piece_reservoirs(df: DataFrame, key: str, piece: str, k: int, seed: int = 0, parts: int | None = None) -> DataFrame:
    """One reservoir of at most ``k`` distinct keys per arrival piece: (piece, population, pos, item)."""
    parts = parts or parts_of(df)
    found = reservoirs(df, key, piece, k, seed, parts)
    return _merged_up(found, "part", ["piece"], k, seed, max(1, (parts - 1).bit_length())).select("piece", "population", "pos", "item")


def uniform_sample(df: DataFrame, key: str, piece: str, k: int, seed: int = 0, parts: int | None = None) -> DataFrame:
    """A uniform sample of ``k`` distinct keys (all, if there are fewer): (key, population).

    Every distinct non-null key is equally likely, however many rows or pieces it has.
    The result depends on the set of keys, their first pieces, ``seed`` and ``parts``
    only (by default a power of 2 in proportion to the rows), not on row order or
    partitioning. An empty table gives no rows; further columns are ignored.
    """
    level = piece_reservoirs(df, key, piece, k, seed, parts).withColumn("part", F.lit(0))
    return _merged_up(level, "piece", [], k, seed, 32).select(F.col("item").alias(key), "population")
