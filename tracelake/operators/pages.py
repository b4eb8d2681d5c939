"""Rows of long results by their numbers, without sorting or counting all that comes before them.

Two ways. Postings that are in order already (positions by mnemonic or module offset) have a directory of how
many lie in each chunk of positions; sums over it find the chunk of the n-th, and only that is read. A result in
any other order is written once, in ranges of that order, with each row's number inside its range; a page is
then read by its range and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import saved, scratch_folder

#: Positions of one chunk of a directory.
RANK_CHUNK = 1 << 16


def ranks(postings: DataFrame, key: str) -> DataFrame:
    """The tables ``offset_rank`` and ``mnemonic_rank``: how many postings of each key lie in each chunk of positions."""
    return postings.groupBy(key, F.expr(f"idx div {RANK_CHUNK}").alias("chunk")).agg(F.count("*").alias("n"))


def postings_between(postings: DataFrame, rank: DataFrame, keys: DataFrame, top: int, count: int) -> DataFrame:
    """(idx, number) of ``count`` postings from number ``top`` (from 0) on, of ``keys`` (key, place) in the order of place,
    then position. The driver sees one row for each chunk that holds some of them."""
    key = keys.columns[0]
    top, end = max(0, top), max(0, top) + max(0, count)
    # One row for each key and chunk: few, as keys are those of one search.
    own = rank.join(F.broadcast(keys), key)
    before = Window.orderBy("place", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    found = own.where((F.col("before") < end) & (F.col("before") + F.col("n") > top)).select(key, "chunk", "before").collect()
    parts = postings.select(key, "idx").limit(0)
    hit = F.lit(False)
    for r in found:
        low = r["chunk"] * RANK_CHUNK
        hit = hit | ((F.col(key) == r[key]) & F.col("idx").between(low, low + RANK_CHUNK - 1))
    if not found:
        return parts.select("idx", F.lit(0).cast("long").alias("number"))
    starts = postings.sparkSession.createDataFrame([(r[key], r["chunk"], r["before"]) for r in found], f"{key} {dict(postings.dtypes)[key]}, chunk long, before long")
    rows = postings.where(hit).select(key, "idx").withColumn("chunk", F.expr(f"idx div {RANK_CHUNK}")).join(F.broadcast(starts), [key, "chunk"])
    inside = Window.partitionBy(key, "chunk").orderBy("idx")
    return rows.select("idx", (F.col("before") + F.row_number().over(inside) - 1).alias("number")).where(F.col("number").between(top, end - 1))


class SavedResult:
    """A result in some order, written once, of which any page is read without the rows before it."""

    def __init__(self, matches: DataFrame, *order: Column | str):
        order = order or ("index",)
        parts = matches.repartitionByRange(*order).sortWithinPartitions(*order)
        # The number inside a partition follows from the order of its rows, which the sort gives.
        rows = parts.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
        self.columns = matches.columns
        self.rows = saved(rows, scratch_folder(matches.sparkSession, "result"))
        # One row for each part.
        self.parts = sorted(map(tuple, self.rows.groupBy("_part").agg(F.count("*")).collect()))

    def count(self) -> int:
        return sum(n for _, n in self.parts)

    def page(self, top: int, count: int) -> DataFrame:
        """``count`` rows from number ``top`` (from 0) on, in order."""
        before, hit, end = 0, F.lit(False), max(0, top) + max(0, count)
        for part, n in self.parts:
            low, high = max(0, top) - before, end - before
            if low < n and high > 0:
                hit = hit | ((F.col("_part") == part) & F.col("_at").between(max(0, low), min(n, high) - 1))
            before += n
        return self.rows.where(hit).orderBy("_part", "_at").select(*self.columns)
