"""Queries over a trace that is written as a log of text files first and read back by the log reader.

Eight instructions at a time follow from the table ``events``: stores and loads that read them back in whole and in
part, a pair, a byte, a half, an index with a sign-extended shift, FP and LR, a string hint, operations and dump lines
of their own, and lines that say nothing. Where a file ends, an instruction's own lines open the next. The SQL
computes from the events' numbers what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lineage, search, tables
from ..sources.logs import read_trace
from ..sources.files import saved, scratch_folder
from .trace import Trace
from .twins import columns_of

Query = Callable[[SparkSession, str], DataFrame]

FILES = 5


def _whole(text: str, by: int) -> str:
    """A number over ``by``, rounded down."""
    return f"CAST(({text} - {text} % {by}) / {by} AS BIGINT)"


def _bytes(text: str, n: int) -> str:
    """The lowest ``n`` bytes of a number below 2^53 in digits, lowest first."""
    return "concat(" + ", ".join(f"lpad(lower(HEX({_whole(text, 256**j)} % 256)), 2, '0')" for j in range(n)) + ")"


def _by_kind(*values: str) -> str:
    """One expression for each of the eight instructions."""
    return "CASE r " + " ".join(f"WHEN {r} THEN {v}" for r, v in enumerate(values)) + " END"


#: The steps from events to instructions, in SQL that both engines have; HEX, CHR, LIST and N_EVENTS are replaced.
STEPS = (
    f"""event_id AS i, event_id % 8 AS r, {_whole("event_id", 8)} AS k, 4194304 + 4 * user_id AS off""",
    """*, 139637976727552 + 4096 * (k % 50) AS a, (k * 2654435761 + 12345) % 281474976710656 AS v, 140737488351232 + 4096 * (k % 20) AS s,
    CAST(ceil(N_EVENTS / 8.0) AS BIGINT) AS blocks""",
    f"""*, least({FILES - 1}, CAST(({FILES} * k - ({FILES} * k) % blocks) / blocks AS BIGINT)) AS here, least({FILES - 1}, CAST(({FILES} * (k + 1) - ({FILES} * (k + 1)) % blocks) / blocks AS BIGINT)) AS next,
    concat('0x', lower(HEX(off))) AS offset_text, concat('0x', lower(HEX(off + 481036337152))) AS address, concat('0x', lower(HEX(a))) AS at_a, concat('0x', lower(HEX(s))) AS at_s, concat('0x', lower(HEX(s - 16))) AS at_low,
    concat('0x', lower(HEX(v))) AS hv, concat('0x', lower(HEX(v + 1))) AS hw, concat('0x', lower(HEX((v + 1) % 4294967296))) AS hb, {_whole("(v + 1)", 65536)} % 65536 AS half""",
    f"""*, concat('0x', lower(HEX(half))) AS hh,
    {_by_kind("'str'", "'ldr'", "'add'", "'strb'", "'stp'", "'ldrh'", "'ldp'", "'ldr'")} AS mnemonic,
    {_by_kind("'x1, [x0, #16]'", "'x2, [x0, #16]'", "'x3, x2, #1'", "'w3, [x0, w4, sxtw #2]'", "'x3, x2, [sp, #-0x10]!'", "'w5, [sp, #2]'", "'fp, lr, [x0, x6, lsl #3]'", "'x7, [x8]'")} AS operands""",
    "*, " + _by_kind(
        "concat('x0=', at_a, ' x1=', hv, ' => x0=', at_a)", "concat('X0=', at_a, ', X2=0x0 -> ', hv)", "concat('x2=', hv, ' => x3=', hw)",
        "concat('x0=', at_a, ' w3=', hb, ' w4=0xffffffff => x0=', at_a)", "concat('x3=', hw, ' x2=', hv, ' sp=', at_s, ' => sp=', at_low)", "concat('SP=', at_low, ' W5=0xfffff -> ', hh)",
        "concat('x0=', at_a, ' x6=0x2 => fp=', hv, ' lr=0x0')", """concat('x8=0x', lower(HEX(a + 32)), ' x7=0x0 => x7=', hv, ' (string: "s', k % 10, '")')""",
    ) + " AS comment",
    f"""*, CASE WHEN r IN (1, 5) THEN concat(address, CHR(9), offset_text, CHR(9), mnemonic, ' ', operands, ' ; ', comment) ELSE concat('[twin ', offset_text, '] ', address, ': "', mnemonic, ' ', operands, '" ', comment) END AS line,
    CASE r WHEN 6 THEN LIST(concat('memory read at 0x', lower(HEX(a + 16)), ', instruction address = ', address, ', data size = 16, data value = ', {_bytes("v", 8)}, '0000000000000000'),
      concat('Memory Write at 0x', lower(HEX(a + 256)), ', instruction address = ', address, ', data size = 4, data value = 0a0b0c0d'))
    WHEN 7 THEN LIST(concat('*', lower(HEX(a + 32)), ' 41 42 ', lpad(lower(HEX(k % 256)), 2, '0'), ' |AB.|'), 'nothing of note', concat(lower(HEX(a + 48)), ' 00 01 |..|')) ELSE LIST() END AS more""",
)


def events_as_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = rows.count()
    for step in STEPS:
        text = step.replace("LIST()", "cast(array() as array<string>)").replace("LIST(", "array(").replace("N_EVENTS", str(n))
        rows = rows.selectExpr(*columns_of(text))
    return rows


def write_log(spark: SparkSession, sf_dir: str) -> str:
    """The log's folder: FILES text files, whose names are in the order of what they hold."""
    rows = events_as_instructions(spark, sf_dir)
    head = rows.select(F.when(F.col("r") == 7, F.col("next")).otherwise(F.col("here")).alias("file"), "i", F.lit(0).alias("n"), "line")
    more = rows.select(F.col("next").alias("file"), "i", F.posexplode("more").alias("n", "line")).withColumn("n", F.col("n") + 1)
    first = spark.createDataFrame([(0, -1, 0, "Original SP: 0x7fd0")], "file bigint, i bigint, n int, line string")
    folder = scratch_folder(spark, "log")
    every = head.unionByName(more).unionByName(first)
    every.repartitionById(FILES, F.col("file").cast("int")).sortWithinPartitions("file", "i", "n").select("line").write.text(folder)
    return folder


def log_trace(spark: SparkSession, sf_dir: str) -> Trace:
    """The trace of the written log."""
    instruction, _ = read_trace(spark, write_log(spark, sf_dir), scratch_folder(spark, "lines"))
    return Trace.of(saved(instruction, "instruction"))


def log_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the store has them."""
    counts = [F.size(c).alias(n) for c, n in (("raw_lines", "n_lines"), ("register_changes", "n_changes"), ("memory_ops", "n_ops"), ("memory_dump", "n_dumps"))]
    trace = Trace.open(spark, write_log(spark, sf_dir), scratch_folder(spark, "store"))
    return trace.instruction.select("idx", "file_offset", "address", "offset", "mnemonic", "operands", "comment", *counts)


def log_memory_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_trace(spark, sf_dir).memory_access.select("idx", "slot", "kind", "addr", "size", "data_value", "value_bytes")


def log_overlapping_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.previous_overlapping_writes(log_trace(spark, sf_dir).memory_access).select("idx", "slot", "write_idx", "write_slot")


def log_register_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each register is written as data flow sees it, and by which names."""
    writes = log_trace(spark, sf_dir).register_write
    names = writes.groupBy("analysis_reg").agg(F.array_join(F.array_sort(F.collect_set("register")), ",").alias("names"))  # a few names each
    return tables.write_counts(writes).join(names, "analysis_reg")


def log_find_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next match after the middle of the log, by address, module offset, memory address and text."""
    trace = log_trace(spark, sf_dir)
    half, first = trace.count() // 2, trace.at(0).first()
    found = None
    for term in (first["address"], first["offset"], "7f0000007010", first["offset"][2:5], "no such text"):
        rows = trace.find_next(term, half).select(F.lit(term).alias("term"), "idx", "how")
        found = rows if found is None else found.unionByName(rows)
    return found


def log_data_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_trace(spark, sf_dir).all_by_data("41 42")


def log_sorted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of ten of a result in the order of its memory addresses, highest first."""
    trace = log_trace(spark, sf_dir)
    found = search.sorted_by(trace.all_by_mnemonic("ldr*"), "memory_address", descending=True)
    return search.result_page(found, 10, 10).select("index", "memory_address")


def data_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the half that the last whole group of instructions loads, over the pair that was stored there."""
    trace = log_trace(spark, sf_dir)
    last = trace.count() // 8 - 1
    return trace.provenance("W5", 8 * last + 5)[0]


QUERIES: dict[str, Query] = {f.__name__: f for f in (log_instructions, log_memory_accesses, log_overlapping_writes, log_register_writes, log_find_first, log_data_search, log_sorted_page, data_provenance)}


def log_sql(body: str, recursive: bool = False) -> str:
    """DuckDB's SQL: ``t`` holds the instructions, ``m`` the memory accesses."""
    names = ["events", *(f"t{i}" for i in range(1, len(STEPS))), "t"]
    plain = lambda step: step.replace("LIST(", "list_value(").replace("HEX(", "to_hex(").replace("CHR(", "chr(").replace("N_EVENTS", "(SELECT count(*) FROM events)")
    steps = ",\n".join(f"{to} AS (SELECT {plain(step)} FROM {of})" for step, of, to in zip(STEPS, names, names[1:], strict=False))
    low = lambda text, n: _bytes(text, n).replace("HEX(", "to_hex(")
    return f"""WITH {'RECURSIVE ' * recursive}{steps},
m AS (
  SELECT i AS idx, 0 AS slot, CASE WHEN mnemonic[:2] = 'ld' THEN 'R' ELSE 'W' END AS kind,
         CASE r WHEN 3 THEN a - 4 WHEN 4 THEN s - 16 WHEN 5 THEN s - 14 WHEN 7 THEN a + 32 ELSE a + 16 END AS addr,
         CASE r WHEN 3 THEN 1 WHEN 4 THEN 16 WHEN 5 THEN 2 WHEN 6 THEN 16 ELSE 8 END AS size,
         CASE r WHEN 0 THEN 'X1=' || hv WHEN 1 THEN 'X2=' || hv WHEN 3 THEN 'W3=' || hb WHEN 4 THEN 'X3=' || hw || ', X2=' || hv WHEN 5 THEN 'W5=' || hh
           WHEN 6 THEN {low("v", 8)} || '0000000000000000' ELSE 'X7=' || hv || ' (string_hex: 73 3' || k % 10 || ')' END AS data_value,
         CASE r WHEN 0 THEN {low("v", 8)} WHEN 3 THEN {low("(v + 1)", 1)} WHEN 4 THEN {low("(v + 1)", 8)} || {low("v", 8)} END AS value_bytes
  FROM t WHERE r <> 2
  UNION ALL SELECT i, 1, 'W', a + 256, 4, '0a0b0c0d', '0a0b0c0d' FROM t WHERE r = 6
  UNION ALL SELECT i, 0, 'D*', a + 32, 3, '41 42 ' || lpad(lower(to_hex(k % 256)), 2, '0'), NULL FROM t WHERE r = 7
  UNION ALL SELECT i, 1, 'D', a + 48, 2, '00 01', NULL FROM t WHERE r = 7){body}"""


ORACLES: dict[str, str] = {
    "log_instructions": log_sql("""
, every AS (
  SELECT CASE WHEN r = 7 THEN next ELSE here END AS file, i, 0 AS n, line FROM t
  UNION ALL SELECT next, i, unnest(range(1, len(more) + 1)), unnest(more) FROM t WHERE len(more) > 0
  UNION ALL SELECT 0, -1, 0, 'Original SP: 0x7fd0'),
o AS (SELECT *, (sum(octet_length(encode(line)) + 1) OVER (PARTITION BY file ORDER BY i, n) - octet_length(encode(line)) - 1)::BIGINT AS file_offset FROM every)
SELECT t.i AS idx, o.file_offset, address, offset_text AS "offset", mnemonic, operands, comment, (1 + len(more))::INTEGER AS n_lines,
  (CASE WHEN r IN (0, 3) THEN 0 WHEN r = 6 THEN 2 ELSE 1 END)::INTEGER AS n_changes, (CASE r WHEN 2 THEN 0 WHEN 6 THEN 2 ELSE 1 END)::INTEGER AS n_ops, (CASE r WHEN 7 THEN 2 ELSE 0 END)::INTEGER AS n_dumps
FROM t JOIN o ON o.i = t.i AND o.n = 0"""),
    "log_memory_accesses": log_sql("SELECT * FROM m"),
    "log_overlapping_writes": log_sql("""
SELECT x.idx, x.slot, max(y.idx) AS write_idx, max_by(y.slot, (y.idx, y.slot)) AS write_slot
FROM m AS x LEFT JOIN m AS y ON y.kind = 'W' AND y.idx < x.idx AND y.addr < x.addr + x.size AND x.addr < y.addr + y.size WHERE x.kind = 'R' GROUP BY ALL"""),
    "log_register_writes": log_sql("""
SELECT analysis_reg, count(DISTINCT i) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names
FROM (SELECT i, unnest(CASE r WHEN 6 THEN ['FP', 'LR'] ELSE [CASE r WHEN 1 THEN 'X2' WHEN 2 THEN 'X3' WHEN 4 THEN 'SP' WHEN 5 THEN 'W5' ELSE 'X7' END] END) AS name,
        unnest(CASE r WHEN 6 THEN ['X29', 'X30'] ELSE [CASE r WHEN 1 THEN 'X2' WHEN 2 THEN 'X3' WHEN 4 THEN 'SP' WHEN 5 THEN 'X5' ELSE 'X7' END] END) AS analysis_reg FROM t WHERE r NOT IN (0, 3)) GROUP BY analysis_reg"""),
    "log_find_first": log_sql("""
, h AS (SELECT (SELECT count(*) FROM events) // 2 AS half, (SELECT address FROM t WHERE i = 0) AS address, (SELECT offset_text FROM t WHERE i = 0) AS off_text),
hits AS (
  SELECT h.address AS term, 'address' AS how, i FROM t, h WHERE t.address = h.address
  UNION ALL SELECT off_text, 'offset', i FROM t, h WHERE offset_text = off_text
  UNION ALL SELECT '7f0000007010', 'memory', idx FROM m WHERE starts_with(lower(to_hex(addr)), '7f0000007010')
  UNION ALL SELECT off_text[3:5], 'text', i FROM t, h WHERE contains(t.address, off_text[3:5]) OR contains(offset_text, off_text[3:5]))
SELECT term, coalesce(min(i) FILTER (WHERE i >= half), min(i)) AS idx, how FROM hits, h GROUP BY ALL"""),
    "log_data_search": log_sql("""
SELECT i AS index, i + 1 AS line, address AS instruction_address, offset_text AS "offset", mnemonic, mnemonic || ' ' || operands AS instruction_text, '内存Dump' AS match_scope,
  '0x' || lower(to_hex(a + 32)) AS memory_address, 'R:' || hv || ' (X7=' || hv || ' (string_hex: 73 3' || k % 10 || '))' AS data FROM t WHERE r = 7"""),
    "log_sorted_page": log_sql("""
SELECT idx AS index, '0x' || lower(to_hex(addr)) AS memory_address
FROM (SELECT idx, addr FROM m JOIN t ON t.i = m.idx WHERE starts_with(mnemonic, 'ldr') AND kind = 'R' ORDER BY addr DESC, idx LIMIT 10 OFFSET 10)"""),
    "data_provenance": log_sql("""
, g AS (SELECT (SELECT count(*) FROM events) // 8 - 1 AS last),
load AS (SELECT t.* FROM t, g WHERE i = 8 * last + 5), pair AS (SELECT t.* FROM t, g WHERE i = 8 * last + 4)
SELECT 0 AS place, 'load' AS kind, i AS index, address AS instruction_address, mnemonic || ' ' || operands AS instruction_text, '0x' || lower(to_hex(s - 14)) AS memory_address, 2 AS memory_size,
  upper(lpad(to_hex(half % 256), 2, '0')) || ' ' || upper(lpad(to_hex(half // 256), 2, '0')) AS value_hex, 'read into W5' AS detail FROM load
UNION ALL SELECT 1, 'write', i, address, mnemonic || ' ' || operands, '0x' || lower(to_hex(s - 16)), 16, (SELECT string_agg(upper(value_bytes[2 * x + 1:2 * x + 2]), ' ' ORDER BY x) FROM m, range(16) AS q(x) WHERE idx = i), 'exact byte match, stored from X3, X2' FROM pair
UNION ALL SELECT 2, 'calc', i, address, mnemonic || ' ' || operands, '-', 0, '-', 'writes X3, reads X2' FROM t, g WHERE i = 8 * last + 2
UNION ALL SELECT 3, 'calc', i, address, mnemonic || ' ' || operands, '-', 0, '-', 'writes X2, reads X0' FROM t, g WHERE i = 8 * last + 1"""),
}
