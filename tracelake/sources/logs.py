"""Trace logs as tables: lines with byte offsets, then instructions with what belongs to them.

Lines are read by Spark's text source, split by split. The number of bytes and of instruction lines in
each run of a split's lines, one small row for each, is summed up over the runs in file order; that gives every
line its byte offset and every instruction its position without a global sort. A line that is no
instruction belongs to the last instruction before it, whichever split that is in.

Defined cases: lines before the first instruction are dropped; an empty log gives an empty table;
``Original SP`` and unrecognised lines belong to no instruction; bytes that aren't UTF-8 stay as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.patterns import INITIAL_SP
from ..functions.recipe import Recipe, applied
from ..functions.u64 import index_value, strip

#: A part of a file has so many bytes, two to this power; a run so many of a split's lines.
PART_BITS, RUN_BITS = 20, 17
#: Instructions of a range of positions, by which they are gathered and written: so many at least, unless they are
#: fewer, and so many at most, however many there are.
RANGE_ROWS, MOST_ROWS = 50_000, 250_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, split, at, size) of every line, in the order of (split, at); its size counts its end."""
    lines = spark.read.option("lineSep", "\n").text(path)
    split = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    return lines.select(F.col("value").alias("line"), split.alias("split"), F.monotonically_increasing_id().alias("at"), (F.octet_length("value").cast("long") + 1).alias("size"))


def classified(lines: DataFrame, effects: bool = True) -> DataFrame:
    """Adds what each line is (fields of an instruction, a stated operation, a dump line, a stack pointer), and, with
    ``effects``, the register changes and the memory operation that an instruction's line implies."""
    return applied(lines, _classify, effects)


def _classify(lines: Recipe, effects: bool) -> Recipe:
    lines = lines.withColumn("is_sp", F.startswith(strip(F.col("line")), F.lit("Original SP:")))
    lines = lines.withColumn("op", F.when(~F.col("is_sp"), parse.stated_operation(F.col("line"))))
    lines = lines.withColumn("dump", F.when(~F.col("is_sp") & F.col("op").isNull(), parse.dump_line(F.col("line"))))
    lines = parse.with_instruction_fields(lines, where=~F.col("is_sp") & F.col("op").isNull() & F.col("dump").isNull())
    if not effects:
        return lines
    head = F.col("fields").isNotNull()
    lines = lines.withColumns({"_head": F.when(head, F.col("line")), "mnemonic": F.col("fields.mnemonic"), "operands": F.col("fields.operands"), "address": F.col("fields.address")})
    return parse.with_effects(lines, "_head").drop("_head", "mnemonic", "operands", "address")


def tasks_of(lines: DataFrame, count: int | None = None) -> int | None:
    """Among how many tasks written lines are dealt so that none gets more as there are more; None if Spark's own number will do.
    ``count``: of lines, if it is known."""
    n = ((lines.count() if count is None else count) >> (RUN_BITS - 1)) + 1
    return n if n > int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def placed(lines: DataFrame, tasks: int | None = None) -> DataFrame:
    """Adds ``file_offset`` and ``idx``, the position of the instruction that a line is or belongs to (-1: none)."""
    head = F.when(F.col("fields").isNotNull(), 1).otherwise(0).cast("long")
    lines = lines.withColumn("_run", F.shiftright("at", RUN_BITS))
    # One row for each run of lines: its sums, then the sums of those before it. A file's offsets begin anew.
    sums = lines.groupBy("split", "_run").agg(F.sum("size").alias("_size"), F.sum(head).alias("_n"))
    before = Window.orderBy("split", "_run").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("split.path").orderBy("split.start", "_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("split").alias("_split"), F.col("_run").alias("_of"), F.coalesce(F.sum("_size").over(in_file), F.lit(0)).alias("_first"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if tasks:
        lines = lines.repartition(tasks, "split", "_run")
    inside = Window.partitionBy("split", "_run").orderBy("at")
    lines = lines.withColumn("_bytes", F.sum("size").over(inside) - F.col("size")).withColumn("_heads", F.sum(head).over(inside))
    joined = lines.join(sums, (lines["split"] == sums["_split"]) & (lines["_run"] == sums["_of"]))
    return joined.withColumns({"file_offset": F.col("_first") + F.col("_bytes"), "idx": F.col("_before") + F.col("_heads") - 1}).drop("_bytes", "_heads", "_split", "_of", "_run", "_first", "_before")


def file_parts(lines: DataFrame) -> DataFrame:
    """The table ``file_part`` of placed lines: for each PART bytes of each file, the positions of the instructions that
    the first and the last line there belong to (-1: to none). A line counts in every part that it has a byte in."""
    part = lambda at: F.shiftright(at, PART_BITS)
    parts = F.sequence(part(F.col("file_offset")), part(F.col("file_offset") + F.col("size") - 1))
    return lines.select(F.col("split.path").alias("path"), F.explode(parts).alias("part"), "idx").groupBy("path", "part").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def initial_sp(lines: DataFrame) -> DataFrame:
    """One row (initial_sp): what the last ``Original SP`` line says, or null."""
    return lines.agg(_last_sp())


def _last_sp() -> Column:
    said = F.when(F.col("line").contains("Original SP:"), F.when(F.startswith(strip(F.col("line")), F.lit("Original SP:")), F.nullif(F.regexp_extract("line", INITIAL_SP, 1), F.lit(""))))
    return F.max_by(said, F.when(said.isNotNull(), F.struct("split", "at"))).alias("initial_sp")


def counted(lines: DataFrame) -> Row:
    """How many lines and instructions there are, and what the last ``Original SP`` line says: (lines, instructions, initial_sp)."""
    return lines.agg(F.count("*").alias("lines"), F.count("fields").alias("instructions"), _last_sp()).first()


def _numbered(rows: Column, name: str) -> Column:
    """An array of structs with each one's place as its first field."""
    fields = {"ordinal": ("register", "old_value", "new_value"), "slot": ("type", "address", "instruction_address", "data_size", "data_value"), "dump": ("address", "data", "is_modified")}[name]
    one = lambda x, i: F.struct(i.alias("ordinal" if name == "ordinal" else "slot"), *[x[f].alias(f) for f in fields])
    return F.when(F.size(rows) == 1, F.array(one(F.get(rows, F.lit(0)), F.lit(0)))).otherwise(F.transform(rows, one))


def by_position(rows: DataFrame, count: int) -> DataFrame:
    """Rows whose ``idx`` is below ``count`` in equal ranges of it, which the column ``range`` numbers; so nothing is read
    first to find the ranges, and none grows with the trace."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(usual, -(-count // RANGE_ROWS)), -(-count // MOST_ROWS))
    return rows.withColumn("range", F.expr(f"cast(idx * {n} div {max(1, count)} as int)")).repartitionById(n, F.col("range"))


def instructions(lines: DataFrame, count: int | None = None, effects: bool = True) -> DataFrame:
    """The table ``instruction`` of placed lines, an instruction's own lines in the order of the log; without ``effects``
    the table ``listing``, which holds what lines state and nothing that follows from it.

    Operations that lines state count instead of the one that the operands imply. ``count``: of instructions; with it
    lines are dealt to ranges of positions and gathered there."""
    rows = lines.where(F.col("idx") >= 0)
    keys = ["idx"]
    if count is not None:
        rows, keys = by_position(rows, count), ["range", "idx"]
    # One aggregate for each column, so that what a query doesn't read isn't parsed for it.
    own = lambda c, name=None: F.first(F.when(F.col("fields").isNotNull(), F.col(c)), ignorenulls=True).alias(name or c)
    order = F.struct("split", "at")
    listed = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("x")))))
    blocks = rows.groupBy(*keys).agg(own("file_offset"), own("fields"), own("line", "raw_line"), *[own(c) for c in ("changes", "inferred") if effects], listed("op").alias("stated"), listed("dump").alias("dumped"), listed("line").alias("raw_lines"))
    of = lambda c: F.col(f"{c}.x").alias(c)
    blocks = blocks.select("idx", "file_offset", "fields.*", "raw_line", *[c for c in ("changes", "inferred") if effects], of("raw_lines"), of("stated"), of("dumped"))
    blocks = blocks.withColumns({"offset_val": index_value(F.col("offset")), "stated": _numbered(F.col("stated"), "slot"), "memory_dump": _numbered(F.col("dumped"), "dump")})
    return _as_instruction(blocks) if effects else blocks.select(*_STATED, "stated", "memory_dump", "raw_lines")


_STATED = ("idx", "file_offset", "address", "offset", "offset_val", "mnemonic", "operands", "comment", "raw_line")


def _as_instruction(rows: DataFrame) -> DataFrame:
    inferred = _numbered(F.array_compact(F.array("inferred")), "slot")
    operations = F.when(F.size("stated") > 0, F.col("stated")).otherwise(inferred)
    return rows.select(*_STATED, _numbered(F.col("changes"), "ordinal").alias("register_changes"), operations.alias("memory_ops"), "memory_dump", "raw_lines")


def completed(listing: DataFrame) -> DataFrame:
    """The table ``instruction`` of the table ``listing``."""
    return _as_instruction(applied(listing, parse.with_effects))


def parsed(spark: SparkSession, path: str, aside: str | None = None, effects: bool = True) -> DataFrame:
    """The classified lines of a log file or folder of log files.

    ``aside``: a folder that they are written to, as they are needed twice; without it they are parsed twice."""
    lines = classified(read_lines(spark, path), effects)
    if aside:
        lines.write.option("compression", "zstd").parquet(aside)
        lines = spark.read.schema(lines.schema).parquet(aside)
    return lines


def read_trace(spark: SparkSession, path: str, aside: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The table ``instruction`` and the one row (initial_sp) of a log file or folder of log files; see ``parsed``."""
    lines = parsed(spark, path, aside)
    tasks, count = (tasks_of(lines), lines.where("fields is not null").count()) if aside else (None, None)
    return instructions(placed(lines, tasks), count), initial_sp(lines)


def instruction_at_offset(instruction: DataFrame, offset: int) -> DataFrame:
    """(idx) of the instruction whose line, or what belongs to it, holds a byte of the log; no row before the first."""
    return instruction.where(F.col("file_offset") <= offset).agg(F.max_by("idx", "file_offset").alias("idx")).where("idx is not null")


def with_next_offset(instruction: DataFrame, size: int) -> DataFrame:
    """Adds ``next_file_offset``, where the next instruction begins (``size``, the log's, for the last)."""
    following = instruction.select((F.col("idx") - 1).alias("idx"), F.col("file_offset").alias("next_file_offset"))
    return instruction.join(following, "idx", "left").withColumn("next_file_offset", F.coalesce("next_file_offset", F.lit(size)))
