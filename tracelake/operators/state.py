"""Register state as of a position, by aggregates instead of a replay.

A write to Xn sets 64 bits, one to Wn the lower 32 only. So the upper half of a register is that of
the last write to X, and the lower half that of the last write to either. A value that is no number
changes nothing. Registers never written are zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.registers import display_order, displayed_registers
from ..functions.u64 import LOW, to_hex
from .lookup import ranges_of, within
from .running import CHUNK, carried_last

HIGH = ~LOW
#: The place of a position that is asked for among the writes at it: behind all.
ASKED = (1 << 31) - 1


def _halves(value: Column, is_w: Column) -> tuple[Column, Column]:
    return F.when(~is_w, value.bitwiseAND(F.lit(HIGH))), value.bitwiseAND(F.lit(LOW))


def _joined(high: Column, low: Column) -> Column:
    zero = F.lit(0).cast("long")
    return F.coalesce(high, zero).bitwiseOR(F.coalesce(low, zero))


def state_at(writes: DataFrame, idx: int, checkpoints: DataFrame | None = None, interval: int = 0) -> DataFrame:
    """(register, value) of every register written at or before ``idx``.

    With ``checkpoints`` of an ``interval``, only the writes after the nearest one are read."""
    if idx < 0:
        return writes.select(F.col("state_reg").alias("register"), "value").limit(0)
    parts = writes.where(F.col("idx") <= idx)
    base = None
    if checkpoints is not None and interval:
        floor = idx // interval * interval
        parts = parts.where(F.col("idx") > floor)
        base = checkpoints.where(F.col("idx") == floor).select(F.lit(-1).cast("long").alias("idx"), F.lit(0).alias("ordinal"), F.col("register").alias("state_reg"), F.lit(False).alias("is_w"), "value")
    parts = parts.select("idx", "ordinal", "state_reg", "is_w", "value")
    parts = parts.unionByName(base) if base is not None else parts
    high, low = _halves(F.col("value"), F.col("is_w"))
    order = lambda half: F.when(half.isNotNull(), F.struct("idx", "ordinal"))
    found = parts.groupBy("state_reg").agg(F.max_by(high, order(high)).alias("high"), F.max_by(low, order(low)).alias("low"))
    return found.select(F.col("state_reg").alias("register"), _joined(F.col("high"), F.col("low")).alias("value"))


def states_at(writes: DataFrame, positions: DataFrame, checkpoints: DataFrame | None = None, interval: int = 0, chunk: int = CHUNK) -> DataFrame:
    """(idx, register, value): ``state_at`` for every position of ``positions`` (idx), each once.

    Positions, writes and checkpoints become one sequence for each register and span between checkpoints, along which
    values are carried; so work grows with the writes and positions of the spans asked for, and not with their pairs.
    Of ``writes`` and ``checkpoints`` only these spans are read."""
    wanted = positions.select("idx").where("idx >= 0").distinct()
    high, low = _halves(F.col("value"), F.col("is_w"))
    marks = writes.select("idx", "ordinal", F.col("state_reg").alias("register"), high.alias("high"), low.alias("low"))
    if checkpoints is not None and interval:
        wanted = wanted.withColumn("span", F.expr(f"idx div {interval}"))
        spans = wanted.select("span").distinct()
        ranges = ranges_of(spans, interval)
        # A write at a checkpoint's own position is in the checkpoint already.
        marks = marks.where(within(F.col("idx"), ranges)).withColumn("span", F.expr(f"idx div {interval}")).where(f"idx > span * {interval}").join(spans, "span", "left_semi")
        own = checkpoints.where(within(F.col("idx"), ranges)).withColumn("span", F.expr(f"idx div {interval}")).join(spans, "span", "left_semi")
        high, low = _halves(F.col("value"), F.lit(False))
        marks = marks.unionByName(own.select("span", "idx", F.lit(-1).alias("ordinal"), "register", high.alias("high"), low.alias("low")))
    else:
        wanted, marks = wanted.withColumn("span", F.lit(0).cast("long")), marks.withColumn("span", F.lit(0).cast("long"))
    none = F.lit(None).cast("long")
    asked = wanted.join(marks.select("span", "register").distinct(), "span").select("span", "idx", F.lit(ASKED).alias("ordinal"), "register", none.alias("high"), none.alias("low"))
    rows = marks.unionByName(asked)
    seen = {"h": F.col("high"), "l": F.col("low"), "seen": F.when(F.col("ordinal") != ASKED, 1)}
    found = carried_last(rows, ["span", "register"], "idx", ["idx", "ordinal"], seen, chunk=chunk).where((F.col("ordinal") == ASKED) & F.col("seen").isNotNull())
    return found.select("idx", "register", _joined(F.col("h"), F.col("l")).alias("value"))


def state_history(writes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``writes`` with ``state``: what the register holds after each write."""
    high, low = _halves(F.col("value"), F.col("is_w"))
    rows = carried_last(writes, ["state_reg"], "idx", ["idx", "ordinal"], {"high": high, "low": low}, chunk=chunk)
    return rows.withColumn("state", _joined(F.col("high"), F.col("low"))).drop("high", "low")


def checkpoints(writes: DataFrame, count: int, interval: int, chunk: int = CHUNK) -> DataFrame:
    """The table ``checkpoint``: the state after each position that ``interval`` divides, below ``count``, of the
    registers written by then.

    Writes between two checkpoints become one row for each register first; only those are carried on."""
    spark = writes.sparkSession
    high, low = _halves(F.col("value"), F.col("is_w"))
    mark = F.expr(f"(idx + {interval - 1}) div {interval}")
    order = lambda half: F.when(half.isNotNull(), F.struct("idx", "ordinal"))
    per = writes.withColumn("mark", mark).groupBy("state_reg", "mark").agg(F.max_by(high, order(high)).alias("h"), F.max_by(low, order(low)).alias("l"))
    marks = spark.range(-(-count // interval) if count > 0 else 0).select(F.col("id").alias("mark"))
    begin = per.groupBy("state_reg").agg(F.min("mark").alias("begin"))  # one row for each register
    grid = marks.join(F.broadcast(begin), F.col("mark") >= F.col("begin")).drop("begin")
    rows = grid.join(per, ["state_reg", "mark"], "left")
    rows = carried_last(rows, ["state_reg"], "mark", ["mark"], {"high": F.col("h"), "low": F.col("l")}, chunk=chunk)
    return rows.select((F.col("mark") * interval).alias("idx"), F.col("state_reg").alias("register"), _joined(F.col("high"), F.col("low")).alias("value"))


def x_view(value: Column) -> Column:
    return to_hex(value)


def w_view(value: Column) -> Column:
    return to_hex(value.bitwiseAND(F.lit(LOW)))


def state_for_display(writes: DataFrame, idx: int, **checkpointed) -> DataFrame:
    """(place, register, x_value, w_value, previous, changed, differs) of the 34 displayed registers.

    ``changed``: a write at ``idx`` names the register or its half; ``differs``: its value isn't that
    before ``idx``."""
    spark = writes.sparkSession
    now, before = state_at(writes, idx, **checkpointed), state_at(writes, idx - 1, **checkpointed)
    here = writes.where(F.col("idx") == idx).select(F.col("state_reg").alias("register")).distinct().withColumn("changed", F.lit(True))
    zero = F.lit(0).cast("long")
    rows = F.broadcast(displayed_registers(spark)).join(now, "register", "left").join(before.withColumnRenamed("value", "old"), "register", "left").join(here, "register", "left")
    rows = rows.withColumns({"value": F.coalesce("value", zero), "old": F.coalesce("old", zero)})
    return rows.select(
        display_order(F.col("register")).alias("place"), "register", x_view(F.col("value")).alias("x_value"), w_view(F.col("value")).alias("w_value"),
        x_view(F.col("old")).alias("previous"), F.coalesce("changed", F.lit(False)).alias("changed"), (F.col("value") != F.col("old")).alias("differs"),
    ).orderBy("place")
