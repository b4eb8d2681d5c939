"""From positions that an index gives to the rows of a wide table that is sorted by position.

Positions become a bounded number of ranges, which are pushed into the scan: Parquet then reads the row groups
and pages that hold them. Ranges may hold more than what was asked for, so the caller's own predicate stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges that one scan is given at most.
RANGES = 128


def ranges_of(places: DataFrame, width: int = 1, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of positions, first and last, that hold all ``places`` (one column of whole numbers from 0, each standing
    for ``width`` positions). More places than ``most`` share ranges of equal steps; so the driver sees ``most`` rows."""
    at = F.col(places.columns[0])
    n, low, high = places.agg(F.count(at), F.min(at), F.max(at)).first()
    if not n:
        return []
    step = 1 if n <= most else -(-(high - low + 1) // most)
    found = places.select(F.expr(f"(`{places.columns[0]}` - {low}) div {step}").alias("at")).distinct().orderBy("at").collect()
    out: list[tuple[int, int]] = []
    for (k,) in found:
        begin, end = (low + k * step) * width, (low + (k + 1) * step) * width - 1
        if out and out[-1][1] + 1 >= begin:
            out[-1] = (out[-1][0], end)
        else:
            out.append((begin, end))
    return out


def within(position: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a position is in any of the ranges."""
    found = F.lit(False)
    for low, high in ranges:
        found = found | position.between(low, high)
    return found


def rows_at(table: DataFrame, places: DataFrame, width: int = 1, most: int = RANGES) -> DataFrame:
    """The rows of ``table`` (sorted by idx) in ranges that hold ``places``."""
    return table.where(within(F.col("idx"), ranges_of(places, width, most)))
