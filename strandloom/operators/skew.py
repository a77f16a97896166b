"""Per-key results where a few keys hold most records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compress(df: DataFrame, keys: list[Column | str], values: list[Column | str]) -> DataFrame:
    """Value frequencies: one row per (key, value) with its ``weight``.

    The shuffle is by key and value, so a key with a third of all rows is spread over
    all tasks, and rows that come again shrink to one before they are sent.
    """
    return df.groupBy(*keys, *values).agg(F.count("*").alias("weight"))


def key_totals(df: DataFrame, keys: dict[str, Column], member: Column, identity: list[str], full: Column, amount: Column) -> DataFrame:
    """(key_field, key_value, n_members, n_rows, n_full, amount_total, amount_mode) per key.

    ``keys`` maps a key field's name to its normalised value; each row counts under each
    of its non-null keys. ``identity`` names the columns that make a row the same one
    when it comes again; it then counts once. ``n_members`` is the exact count of
    distinct members, ``n_full`` the rows where ``full`` holds, ``amount_mode`` the
    commonest amount (the smallest of several).

    Rows that come again are dropped first, by row and not by key. Then two groupings, each
    with partial sums before its shuffle: by key and value, by key. Each of them sees a
    hot key from all tasks at once, and the last one only as one row per task.

    Defined cases: rows with a null member or without any key take no part; a null
    amount adds 0 and is no mode; an empty table gives no rows.
    """
    named = {f"_k{i}": k for i, k in enumerate(keys.values())}
    rows = df.select(*identity, member.alias("_member"), full.alias("_full"), amount.alias("_amount"), *[k.alias(n) for n, k in named.items()]).filter("_member is not null")
    entry = F.explode(F.array(*[F.struct(F.lit(f).alias("key_field"), F.col(n).alias("key_value")) for f, n in zip(keys, named)]))
    key = ["key_field", "key_value"]
    distinct = compress(rows, [], ["_member", "_full", "_amount", *named, *identity])
    once = distinct.select("_member", "_full", "_amount", entry.alias("_key")).select("_member", "_full", "_amount", "_key.*").filter("key_value is not null")
    by_member = once.groupBy(*key, "_member").agg(F.count("*").alias("n_rows"), F.sum(F.coalesce(F.col("_full"), F.lit(False)).cast("long")).alias("n_full"), F.sum(F.coalesce("_amount", F.lit(0))).alias("total"))
    totals = by_member.groupBy(*key).agg(F.count("*").alias("n_members"), F.sum("n_rows").alias("n_rows"), F.sum("n_full").alias("n_full"), F.sum("total").alias("amount_total"))
    by_value = once.groupBy(*key, "_amount").agg(F.count("*").alias("weight")).filter("_amount is not null")
    modes = by_value.groupBy(*key).agg(F.max_by("_amount", F.struct(F.col("weight"), -F.col("_amount"))).alias("amount_mode"))
    return totals.join(modes, key, "left")


def heavy_keys(df: DataFrame, keys: dict[str, Column], member: Column, percent: int) -> DataFrame:
    """(key_field, key_value, n_members): keys with at least ``percent`` % of all distinct members.

    Distinct members are counted by key and member before key; rows without a key count
    in the total.
    """
    entry = F.explode(F.array(*[F.struct(F.lit(f).alias("key_field"), k.alias("key_value")) for f, k in keys.items()]))
    rows = df.select(member.alias("_member"), entry.alias("_key")).filter("_member is not null")
    weighted = compress(rows.select("_key.key_field", "_key.key_value", "_member").filter("key_value is not null"), ["key_field", "key_value"], ["_member"])
    counts = weighted.groupBy("key_field", "key_value").agg(F.count("*").alias("n_members"))
    total = compress(df.select(member.alias("_member")).filter("_member is not null"), [], ["_member"]).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n_members") * 100 >= total.scalar() * percent)
