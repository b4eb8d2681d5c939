"""Queries over a trace that follows from the table ``events``, each with DuckDB's SQL for the same rows.

Every event becomes a log line, bracketed or tabbed in turn, which the real parser reads; the SQL
computes from the events' numbers what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lineage, search, state, tables
from ..sources.logs import classified, instructions
from ..sources.files import saved
from .trace import Trace

Query = Callable[[SparkSession, str], DataFrame]

#: The steps from events to lines, in SQL that both engines have; HEX and CHR are replaced.
STEPS = (
    """event_id AS idx, user_id % 31 AS reg, event_id % 3 = 0 AS is_w, (user_id % 31 + 1 + event_id % 29) % 31 AS src,
    CASE event_type WHEN 'click' THEN 'add' WHEN 'error' THEN 'cmp' WHEN 'purchase' THEN 'str' WHEN 'signup' THEN 'mov' ELSE 'ldr' END AS mnemonic,
    4194304 + 4 * user_id AS off, 140737488355328 + 8 * (event_id % 97) AS base, 8 * (event_id % 5) AS imm, (event_id * 2654435761 + 1) % 4611686018427387904 AS wide""",
    """*, CASE WHEN is_w THEN wide & 4294967295 ELSE wide END AS val, concat(CASE WHEN is_w THEN 'W' ELSE 'X' END, reg) AS name,
    mnemonic IN ('add', 'mov', 'ldr') AS writes, mnemonic IN ('ldr', 'str') AS touches, CASE WHEN is_w THEN 4 ELSE 8 END AS size, base + imm AS mem""",
    """*, concat('0x', lower(HEX(off))) AS offset_text, concat('0x', lower(HEX(off + 481036337152))) AS address, concat('0x', lower(HEX(val))) AS v,
    concat('X', src, '=0x', lower(HEX(base))) AS held, concat('0x', lower(HEX(mem))) AS mem_text,
    CASE WHEN touches THEN concat(lower(name), ', [x', src, ', #', imm, ']') WHEN mnemonic = 'add' THEN concat(lower(name), ', x', src, ', #1')
         WHEN mnemonic = 'mov' THEN concat(lower(name), ', x', src) ELSE concat('x', reg, ', x', src) END AS operands""",
    """*, CASE WHEN idx % 2 = 0 AND writes THEN concat(held, ' ', name, '=0x0 => ', name, '=', v) WHEN idx % 2 = 0 AND mnemonic = 'str' THEN concat(held, ' ', name, '=', v, ' => ', held)
         WHEN idx % 2 = 0 THEN concat(held, ' => ', held) WHEN writes THEN concat(held, ', ', name, '=0x0 -> ', v) WHEN mnemonic = 'str' THEN concat(held, ', ', name, '=', v) ELSE held END AS comment""",
    """*, CASE WHEN idx % 2 = 0 THEN concat('[twin ', offset_text, '] ', address, ': "', mnemonic, ' ', operands, '" ', comment)
         ELSE concat(address, CHR(9), offset_text, CHR(9), mnemonic, ' ', operands, ' ; ', comment) END AS line""",
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, file_offset, split, at, line)."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    # A table of few files is dealt out before its lines are parsed, which is most of the work.
    if rows.rdd.getNumPartitions() < (cores := spark.sparkContext.defaultParallelism):
        rows = rows.repartition(cores)
    for step in STEPS:
        rows = rows.selectExpr(*columns_of(step))
    return rows.select("idx", F.col("idx").alias("file_offset"), F.lit(0).alias("split"), F.col("idx").alias("at"), "line")


def columns_of(step: str) -> list[str]:
    """The expressions of a step: split at commas outside of brackets and quotes."""
    out, depth, quoted = [""], 0, False
    for c in step:
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return [e.strip() for e in out]


def twin(spark: SparkSession, sf_dir: str, kept: bool = False) -> Trace:
    """The trace; its instructions are written once (``kept``) for what reads them more than once."""
    rows = instructions(classified(lines(spark, sf_dir)))
    return Trace.of(saved(rows, "instruction") if kept else rows)


def _sql(body: str, recursive: bool = False) -> str:
    """DuckDB's SQL: ``t`` holds the events' numbers, ``w`` register writes and ``m`` memory accesses."""
    names = ["events", *(f"t{i}" for i in range(1, len(STEPS))), "t"]
    steps = ",\n".join(f"{to} AS (SELECT {step.replace('HEX(', 'to_hex(').replace('CHR(', 'chr(')} FROM {of})" for step, of, to in zip(STEPS, names, names[1:], strict=False))
    more = """,
w AS (SELECT idx, name, 'X' || reg AS state_reg, is_w, val FROM t WHERE writes),
m AS (SELECT idx, CASE mnemonic WHEN 'ldr' THEN 'R' ELSE 'W' END AS kind, mem, mem_text, size, name || '=' || v AS data_value FROM t WHERE touches),
uses AS (SELECT idx, 'X' || src AS reg FROM t UNION ALL SELECT idx, 'X' || reg FROM t WHERE mnemonic IN ('str', 'cmp'))"""
    return f"WITH {'RECURSIVE ' * recursive}{steps}{more}{body}"


_SHOWN = """idx AS index, idx + 1 AS line, address AS instruction_address, offset_text AS "offset", mnemonic, mnemonic || ' ' || operands AS instruction_text,
  CASE WHEN touches THEN mem_text ELSE '-' END AS memory_address,
  CASE WHEN touches THEN CASE mnemonic WHEN 'ldr' THEN 'R:' ELSE 'W:' END || v || ' (' || name || '=' || v || ')' ELSE comment END AS data"""
_STATE = """(coalesce(arg_max(val, idx) FILTER (WHERE NOT is_w), 0) & ~4294967295) | coalesce(arg_max(val & 4294967295, idx), 0)"""

REG, OFFSET, PREFIX, DATUM, SPACING, STEPS_SHOWN = "X7", "0x40001c", "0x8000000001", "0x800000000100", 500, 500
#: The last position, and the middle one, in SQL.
AT, MIDDLE = "(SELECT max(event_id) FROM events)", "(SELECT count(*) // 2 FROM events)"


def register_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the whole trace."""
    trace = twin(spark, sf_dir)
    return state.state_at(trace.register_write, trace.count() - 1)


def register_state_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the whole trace."""
    trace = twin(spark, sf_dir)
    return state.state_for_display(trace.register_write, trace.count() - 1).drop("place")


def state_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = twin(spark, sf_dir)
    return state.checkpoints(saved(trace.register_write, "register_write"), trace.count(), SPACING)


def state_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.state_history(saved(twin(spark, sf_dir).register_write, "register_write")).select("idx", "state_reg", "state")


def parsed_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twin(spark, sf_dir).instruction.select("idx", "address", "offset", "offset_val", "mnemonic", "operands", "comment", F.size("register_changes").alias("n_changes"), F.size("memory_ops").alias("n_ops"))


def register_write_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twin(spark, sf_dir).register_write.select("idx", "register", "state_reg", "analysis_reg", "is_w", "value")


def memory_access_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twin(spark, sf_dir).memory_access.select("idx", "slot", "kind", "addr", "addr_hex", "bucket", "size", "address", "data_value")


def mnemonic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twin(spark, sf_dir).mnemonic


def register_write_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.write_counts(twin(spark, sf_dir).register_write)


def previous_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = twin(spark, sf_dir)
    return lineage.previous_write(trace.register_write, REG, trace.count() - 1)


def definition_of_every_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twin(spark, sf_dir, kept=True).def_use


def previous_overlapping_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.previous_overlapping_writes(saved(twin(spark, sf_dir).memory_access, "memory_access")).select("idx", "addr", "size", "write_idx")


def backward_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = twin(spark, sf_dir, kept=True)
    rows = lineage.taint_slice(trace.instruction, trace.register_write, saved(trace.def_use, "def_use"), REG, trace.count() - 1, STEPS_SHOWN)
    lists = ("hit_writes", "read_regs", "taint_before", "taint_after")
    return rows.select("index", "address", "mnemonic", "operands", *[F.array_join(c, ",").alias(c) for c in lists])


def all_by_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twin(spark, sf_dir, kept=True).all_by_address(PREFIX)


def all_by_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twin(spark, sf_dir, kept=True).all_by_offset(OFFSET)


def all_by_mnemonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twin(spark, sf_dir, kept=True).all_by_mnemonic("m*")


def count_by_mnemonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.count_by_mnemonic(twin(spark, sf_dir).mnemonic, "m*")


def all_by_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twin(spark, sf_dir, kept=True).all_by_data(DATUM)


def next_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next match by offset and by memory address from the middle on."""
    trace = twin(spark, sf_dir)
    start = trace.count() // 2
    by_offset = search.next_by_offset(trace.instruction, OFFSET, start).withColumn("how", F.lit("offset"))
    return by_offset.unionByName(search.next_by_memory_address(trace.memory_access, PREFIX, start).withColumn("how", F.lit("memory")))


def instruction_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifty."""
    trace = twin(spark, sf_dir)
    return trace.page(trace.count() - 50, 50)


QUERIES: dict[str, Query] = {f.__name__: f for f in (register_state, register_state_display, state_checkpoints, state_history, parsed_instructions, register_write_table, memory_access_table, mnemonic_table, register_write_counts, previous_write, definition_of_every_use, previous_overlapping_write, backward_taint, all_by_address, all_by_offset, all_by_mnemonic, count_by_mnemonic, all_by_data, next_matches, instruction_page)}

ORACLES: dict[str, str] = {
    "register_state": _sql(f"SELECT state_reg AS register, {_STATE} AS value FROM w WHERE idx <= {AT} GROUP BY ALL"),
    "register_state_display": _sql(f""",
now AS (SELECT state_reg, {_STATE} AS value FROM w WHERE idx <= {AT} GROUP BY ALL),
old AS (SELECT state_reg, {_STATE} AS value FROM w WHERE idx < {AT} GROUP BY ALL),
names AS (SELECT 'X' || range AS r FROM range(31) UNION ALL SELECT unnest(['SP', 'FP', 'LR']))
SELECT r AS register, '0x' || lower(to_hex(coalesce(now.value, 0))) AS x_value, '0x' || lower(to_hex(coalesce(now.value, 0) & 4294967295)) AS w_value,
  '0x' || lower(to_hex(coalesce(old.value, 0))) AS previous, r IN (SELECT state_reg FROM w WHERE idx = {AT}) AS changed, coalesce(now.value, 0) <> coalesce(old.value, 0) AS differs
FROM names LEFT JOIN now ON now.state_reg = r LEFT JOIN old ON old.state_reg = r"""),
    "state_checkpoints": _sql(f""",
k AS (SELECT idx AS pos FROM t WHERE idx % {SPACING} = 0)
SELECT pos AS idx, state_reg AS register, {_STATE} AS value FROM k JOIN w ON w.idx <= pos GROUP BY ALL"""),
    "state_history": _sql("""
SELECT idx, state_reg, (coalesce(last_value(CASE WHEN NOT is_w THEN val END IGNORE NULLS) OVER o, 0) & ~4294967295) | (val & 4294967295) AS state
FROM w WINDOW o AS (PARTITION BY state_reg ORDER BY idx)"""),
    "parsed_instructions": _sql("""SELECT idx, address, offset_text AS "offset", off AS offset_val, mnemonic, operands, comment, writes::INTEGER AS n_changes, touches::INTEGER AS n_ops FROM t"""),
    "register_write_table": _sql("SELECT idx, name AS register, state_reg, state_reg AS analysis_reg, is_w, val AS value FROM w"),
    "memory_access_table": _sql("SELECT idx, 0 AS slot, kind, mem AS addr, mem_text[3:] AS addr_hex, mem_text[3:8] AS bucket, size, mem_text AS address, data_value FROM m"),
    "mnemonic_table": _sql("SELECT mnemonic, count(*) AS n, min(idx) AS first_idx FROM t GROUP BY ALL"),
    "register_write_counts": _sql("SELECT state_reg AS analysis_reg, count(*) AS n FROM w GROUP BY ALL"),
    "previous_write": _sql(f"SELECT max(idx) AS idx FROM w WHERE state_reg = '{REG}' AND idx <= {AT}"),
    "definition_of_every_use": _sql("SELECT uses.idx, uses.reg, w.idx AS def_idx FROM uses ASOF LEFT JOIN w ON w.state_reg = uses.reg AND w.idx < uses.idx"),
    "previous_overlapping_write": _sql("""
SELECT r.idx, r.mem AS addr, r.size, max(s.idx) AS write_idx
FROM m AS r LEFT JOIN m AS s ON s.kind = 'W' AND s.idx < r.idx AND s.mem < r.mem + r.size AND r.mem < s.mem + s.size WHERE r.kind = 'R' GROUP BY ALL"""),
    "backward_taint": _sql(f""",
du AS (SELECT uses.idx, uses.reg, w.idx AS def_idx FROM uses ASOF LEFT JOIN w ON w.state_reg = uses.reg AND w.idx < uses.idx),
reach AS (
  SELECT max(idx) AS i FROM w WHERE state_reg = '{REG}' AND idx <= {AT}
  UNION
  SELECT du.def_idx FROM reach JOIN du ON du.idx = reach.i WHERE du.def_idx IS NOT NULL),
node AS (SELECT i FROM reach WHERE i IS NOT NULL ORDER BY i DESC LIMIT {STEPS_SHOWN}),
live AS (
  SELECT {AT} + 1 AS idx, '{REG}' AS reg, (SELECT max(idx) FROM w WHERE state_reg = '{REG}' AND idx <= {AT}) AS def_idx
  UNION ALL SELECT du.* FROM du JOIN node ON du.idx = node.i),
before AS (SELECT i, live.reg, live.def_idx FROM node JOIN live ON live.idx > i AND (live.def_idx IS NULL OR live.def_idx <= i)),
later AS (SELECT i, reg FROM before WHERE def_idx IS DISTINCT FROM i UNION SELECT node.i, du.reg FROM node JOIN du ON du.idx = node.i)
SELECT node.i AS index, address, mnemonic, operands,
  (SELECT string_agg(DISTINCT reg, ',' ORDER BY reg) FROM before AS b WHERE b.i = node.i AND b.def_idx = b.i) AS hit_writes,
  (SELECT coalesce(string_agg(DISTINCT reg, ',' ORDER BY reg), '') FROM du WHERE du.idx = node.i) AS read_regs,
  (SELECT string_agg(DISTINCT reg, ',' ORDER BY reg) FROM before AS b WHERE b.i = node.i) AS taint_before,
  (SELECT coalesce(string_agg(DISTINCT reg, ',' ORDER BY reg), '') FROM later AS l WHERE l.i = node.i) AS taint_after
FROM node JOIN t ON t.idx = node.i""", recursive=True),
    "all_by_address": _sql(f"""
SELECT m.idx AS index, m.idx + 1 AS line, t.address AS instruction_address, kind AS access, m.mem_text AS memory_address, t.v || ' (' || data_value || ')' AS data
FROM m JOIN t USING (idx) WHERE starts_with(m.mem_text, '{PREFIX}')"""),
    "all_by_offset": _sql(f"SELECT {_SHOWN} FROM t WHERE offset_text = '{OFFSET}'"),
    "all_by_mnemonic": _sql(f"SELECT {_SHOWN} FROM t WHERE starts_with(mnemonic, 'm')"),
    "count_by_mnemonic": _sql("SELECT count(*) AS n FROM t WHERE starts_with(mnemonic, 'm')"),
    "all_by_data": _sql(f"SELECT {_SHOWN}, '寄存器/注释' AS match_scope FROM t WHERE contains(comment, '{DATUM}')"),
    "next_matches": _sql(f"""
SELECT 'offset' AS how, coalesce(min(idx) FILTER (WHERE idx >= {MIDDLE}), min(idx)) AS idx FROM t WHERE offset_text = '{OFFSET}' HAVING count(*) > 0
UNION ALL
SELECT 'memory', coalesce(min(idx) FILTER (WHERE idx >= {MIDDLE}), min(idx)) FROM m WHERE starts_with(mem_text, '{PREFIX}') HAVING count(*) > 0"""),
    "instruction_page": _sql(f"""SELECT idx + 1 AS num, address, offset_text AS "offset", mnemonic, operands, comment FROM t WHERE idx > {AT} - 50"""),
}
