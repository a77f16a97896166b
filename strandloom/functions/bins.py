"""Histogram bins and other scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length_bin(column: str, width: int = 500, last: int = 4000) -> Column:
    """Upper end of the bin (n - width, n], or '>last'."""
    c = F.col(column)
    return F.when(c > last, F.lit(f">{last}")).otherwise((F.ceil(c / width) * width).cast("string"))


def count_bin(column: str, last: int = 20) -> Column:
    """Counts up to ``last`` by themselves, all larger ones as '>last'."""
    c = F.col(column)
    return F.when(c > last, F.lit(f">{last}")).otherwise(c.cast("string"))


def ratio(part: Column | str, whole: Column | str, digits: int = 6) -> Column:
    """Rounded quotient; null where the whole is 0."""
    return F.round(F.try_divide(F.col(part) if isinstance(part, str) else part, F.col(whole) if isinstance(whole, str) else whole), digits)


def percent_text(part: str, whole: str, digits: int = 0) -> Column:
    """'12%', or 'NA' where the whole is 0."""
    share = F.round(100 * F.col(part) / F.nullif(F.col(whole), F.lit(0)), digits)
    return F.coalesce(F.concat(F.format_number(share, digits), F.lit("%")), F.lit("NA"))


def with_commas(column: str) -> Column:
    return F.format_number(F.col(column), 0)


def log2_plus_one(column: str) -> Column:
    """log2(x) + 1, with 0 for 0: the scale of the exon and depth plots."""
    c = F.col(column)
    return F.when(c == 0, F.lit(0.0)).otherwise(F.log2(c) + 1)
