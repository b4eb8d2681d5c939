"""From bytes of log files to the instructions that they belong to.

The table ``file_part`` says for each part of each file at which positions its first and last line are. So a byte's part
is found by equality, and its instruction is among those between: the last of them that begins at the byte or before
it, or else the one that the part's first line belongs to.

Defined cases: bytes beyond a file's end belong to its last instruction; those before the first instruction of a log, in
a file that isn't the log's, or at null belong to none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import saved
from ..sources.logs import PART_BITS
from .lookup import rows_at

#: Positions of one block, by which parts meet the instructions that begin in them.
BLOCK = 1 << 12


def instruction_at(instruction: DataFrame, parts: DataFrame, offset: int, path: str | None = None) -> DataFrame:
    """(idx) of the instruction at a byte of a file, the first one if no path is given; no row if there is none."""
    path = path or parts.agg(F.min("path")).first()[0]
    own = parts.where(F.col("path") == path)
    found = own.where(F.col("part") == offset >> PART_BITS).first() or own.orderBy(F.desc("part")).limit(1).first()
    low, high = (found["first_idx"], found["last_idx"]) if found and offset >= 0 else (-1, -1)
    inside = instruction.where((F.col("idx") > low) & (F.col("idx") <= high) & (F.col("file_offset") <= offset))
    return inside.agg(F.coalesce(F.max("idx"), F.lit(low).cast("long")).alias("idx")).where("idx >= 0")


def instructions_at(instruction: DataFrame, parts: DataFrame, asked: DataFrame) -> DataFrame:
    """(path, at, idx) for each different row of ``asked`` (path, at); idx is null where there is no instruction.

    Bytes and the instructions of their parts are merged in order of place; a part has at most as many of either as bytes."""
    # One row for each file of the log, all of which the store's manifest lists.
    ends = F.broadcast(parts.groupBy("path").agg(F.max("part").alias("end"), F.max("last_idx").alias("last")))
    asked = asked.select("path", F.col("at").cast("long").alias("at")).distinct().join(ends, "path", "left").withColumn("part", F.shiftright("at", PART_BITS))
    met = asked.join(parts, ["path", "part"], "left").withColumn("idx", F.when(F.col("part") > F.col("end"), F.col("last")).otherwise(F.col("first_idx")))
    met = saved(met.select("path", "part", "at", "idx", "first_idx", "last_idx", F.coalesce(F.col("last_idx") > F.col("first_idx"), F.lit(False)).alias("within")), "bytes")
    within = met.where("within")
    # A row for each part and block: a row for each position would be sent to all executors, as its size is taken for that of the parts.
    blocks = F.sequence(F.expr(f"(first_idx + 1) div {BLOCK}"), F.expr(f"last_idx div {BLOCK}"))
    parts = within.select("path", "part", "first_idx", "last_idx").distinct().withColumn("block", F.explode(blocks))
    near = rows_at(instruction, parts.select("block"), BLOCK).select(F.expr(f"idx div {BLOCK}").alias("block"), "idx", F.col("file_offset").alias("at"))
    begins = parts.join(near, "block").where("idx > first_idx and idx <= last_idx").select("path", "part", "at", "idx", F.lit(None).cast("long").alias("first"))
    both = begins.unionByName(within.select("path", "part", "at", F.lit(None).cast("long").alias("idx"), F.col("first_idx").alias("first")))
    before = Window.partitionBy("path", "part").orderBy("at", F.col("first").isNotNull())
    merged = both.withColumn("idx", F.last("idx", ignorenulls=True).over(before)).where("first is not null").select("path", "at", F.coalesce("idx", "first").alias("idx"))
    return met.where("not within").select("path", "at", "idx").unionByName(merged).withColumn("idx", F.when(F.col("idx") >= 0, F.col("idx")))
