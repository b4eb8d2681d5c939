"""Queries over the indexes and directories of a stored trace, and over what a user sees of it, with their SQL.

The trace is the written log of ``log_twins``; a store builds the tables that a query asks for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.render import memory_panel
from ..operators import lineage, search, tables
from ..sources import logs, store
from ..sources.files import scratch_folder
from .log_twins import ORACLES as LOG_ORACLES
from .log_twins import log_sql as _sql
from .log_twins import write_log
from .trace import TAINT_STEPS, Trace

Query = Callable[[SparkSession, str], DataFrame]

#: Positions whose state is asked for, and bytes whose instructions are: every one that this divides.
EVERY, BYTES = 997, 1009


def stored_trace(spark: SparkSession, sf_dir: str, effects: bool = True) -> Trace:
    return Trace.open(spark, write_log(spark, sf_dir), scratch_folder(spark, "store"), effects=effects)


def _union(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def indexed_data_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the index over the text of lines: a value that a few lines have, an address that one in fifty has, a run that
    nearly all have, a text that none has, and one too short for the index."""
    trace = stored_trace(spark, sf_dir, effects=False)
    k = trace.count() // 16
    terms = (f"{(k * 2654435761 + 12345) % (1 << 48):x}", f"0x{139637976727552 + 4096 * 7:x}", "0x7f000", "no such text", "fp,")
    return _union([trace.places_by_data(t).select(F.lit(n).alias("term"), F.col("idx").alias("index"), (F.col("idx") + 1).alias("line")) for n, t in enumerate(terms)])


def indexed_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All at one module offset, by postings, and all of one mnemonic, by its directory."""
    trace = stored_trace(spark, sf_dir)
    offset = trace.at(0).first()["offset"]
    found = trace.all_by_offset(offset), trace.all_by_mnemonic("stp")
    return _union([rows.select(F.lit(how).alias("how"), "index", "instruction_text", "memory_address") for how, rows in zip(("offset", "mnemonic"), found, strict=True)])


def indexed_find_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next at each of a few addresses after the middle, by the postings of addresses."""
    trace = stored_trace(spark, sf_dir)
    addresses = sorted({r["address"] for r in trace.page(0, 5).collect()})
    return _union([trace.find_next(a, trace.count() // 2).withColumn("term", F.lit(a)) for a in addresses])


def deep_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rows from the middle of the matches of ``ldr*`` and of one module offset, by the directories of ranks."""
    trace = stored_trace(spark, sf_dir)
    offset = trace.at(0).first()["offset"]
    n, m = (rows.first()[0] for rows in (search.count_by_mnemonic(trace.mnemonic, "ldr*"), trace.count_by_offset(offset)))
    pages = trace.page_by_mnemonic("ldr*", n // 2, 20), trace.page_by_offset(offset, m // 2, 20)
    return _union([rows.select(F.lit(how).alias("how"), "index", "mnemonic", "instruction_address") for how, rows in zip(("mnemonic", "offset"), pages, strict=True)])


def nth_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th of a mnemonic and of a module offset, and how many there are."""
    trace = stored_trace(spark, sf_dir)
    offset = trace.at(0).first()["offset"]
    n, m = (rows.first()[0] for rows in (search.count_by_mnemonic(trace.mnemonic, "ld*"), trace.count_by_offset(offset)))
    rows = trace.nth_by_mnemonic("ld*", n - 1).select(F.lit("mnemonic").alias("how"), "idx", F.lit(n).cast("long").alias("n"))
    return rows.unionByName(trace.nth_by_offset(offset, m - 1).select(F.lit("offset").alias("how"), "idx", F.lit(m).cast("long").alias("n")))


def saved_result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows from the middle of a written result that is in the order of its memory addresses, highest first."""
    trace = stored_trace(spark, sf_dir)
    found = trace.all_by_mnemonic("str*")
    result = trace.result(found, F.col("memory_address").desc(), "index")
    return result.page(result.count() // 2, 25).select("index", "memory_address")


def address_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory of address buckets."""
    return stored_trace(spark, sf_dir).bucket


def candidate_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_trace(spark, sf_dir).candidates_by_address("0x7f0000")


def register_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_trace(spark, sf_dir).register


def last_write_of_read_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of last writes, byte by byte."""
    rows = stored_trace(spark, sf_dir).memory_def_use.select("idx", "slot", "at", F.posexplode("last_writes").alias("k", "w"))
    return rows.select("idx", "slot", (F.col("at") + F.col("k")).alias("byte"), "w.write_idx", "w.write_slot")


def stored_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``data_provenance``, by the last writes and the buckets' directory; with the events' labels."""
    trace = stored_trace(spark, sf_dir)
    events = trace.provenance("W5", 8 * (trace.count() // 8 - 1) + 5)[0]
    return events.withColumn("label", lineage.event_kind(F.col("kind")))


def _every(trace: Trace) -> DataFrame:
    return trace.instruction.where(F.col("idx") % EVERY == 0).select("idx")


def states_at_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From checkpoints and the writes behind them."""
    trace = stored_trace(spark, sf_dir)
    return trace.states_at(_every(trace))


def taint_of_many_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of X3 and W5 from every one of these positions."""
    trace = stored_trace(spark, sf_dir)
    roots = _every(trace).select("idx", F.posexplode(F.array(F.lit("X3"), F.lit("W5"))).alias("k", "register"))
    rows = trace.taints(roots.select((2 * F.col("idx") + F.col("k")).alias("root"), "register", "idx"))
    return rows.select("root", "index", "mnemonic", *[F.array_join(c, ",").alias(c) for c in ("hit_writes", "read_regs")])


def search_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a free term of each kind gives: a line, a mnemonic, a module offset, the next match."""
    trace = stored_trace(spark, sf_dir)
    first, found = trace.at(0).first(), []
    for term in ("5", "strb", first["offset"], first["address"], "no such text"):
        kind, rows = trace.search(term, 3)
        found.append(rows.select(F.lit(term).alias("term"), F.lit(kind).alias("kind"), F.col("index" if "index" in rows.columns else "idx").alias("idx")))
    return _union(found)


def register_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write before the middle of the log, by register."""
    trace = stored_trace(spark, sf_dir)
    return _union([trace.register_source(r, trace.count() // 2).select(F.lit(r).alias("register"), "idx") for r in ("SP", "FP", "X30", "w5", "X7")])


def accesses_of_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and modified dump lines alone, at addresses with a prefix."""
    rows = stored_trace(spark, sf_dir).all_by_address("0x7f0000", kinds=("R", "D*"))
    return rows.select("index", "access", "memory_address")


def memory_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of the memory panel, with strings, of every eighth instruction."""
    rows = stored_trace(spark, sf_dir).instruction.where("idx % 8 = 7")
    panel = memory_panel(F.col("memory_ops"), F.col("memory_dump"), F.col("raw_line"))
    return rows.select("idx", panel.alias("text"))


def exported_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search's result as lines with tabs, and a page of instructions in columns of fixed width."""
    trace = stored_trace(spark, sf_dir)
    result = trace.all_by_mnemonic("strb").select("index", "mnemonic", "memory_address")
    rows = store.tsv_lines(result).select(F.lit("tsv").alias("form"), "line")
    return rows.unionByName(store.fixed_width_lines(trace.page(0, 40)).select(F.lit("fixed").alias("form"), "line"))


def byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each instruction's lines end in the log, for the first file; and which instruction holds a byte in its middle."""
    trace = stored_trace(spark, sf_dir)
    rows = trace.page(0, 100).select((F.col("num") - 1).alias("idx")).join(trace.instruction.select("idx", "file_offset"), "idx")
    ends = logs.with_next_offset(rows, 0).where("next_file_offset > 0").select("idx", "file_offset", "next_file_offset")
    middle = ends.agg(F.max("file_offset").alias("m")).first()["m"] // 2
    held = logs.instruction_at_offset(rows, middle).first()["idx"]
    return ends.withColumn("holds_middle", F.col("idx") == held)


def instructions_at_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instructions at every 1009th byte of each file of the log and of what would be its next part, by the parts of files."""
    trace = stored_trace(spark, sf_dir)
    ends = trace.file_part.groupBy("path").agg((F.shiftleft(F.max("part") + 2, logs.PART_BITS) - 1).alias("end"))
    found = trace.at_bytes(ends.select("path", F.explode(F.sequence(F.lit(0).cast("long"), "end", F.lit(BYTES).cast("long"))).alias("at")))
    return found.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("file"), "at", "idx")


def written_register_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.write_sets(stored_trace(spark, sf_dir).register_write)
    return rows.select("idx", F.array_join("writes", ",").alias("writes"))


def mentions_of_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions one of whose memory addresses contains a few digits; the first thirty of a result and whether there are more."""
    rows = stored_trace(spark, sf_dir).instruction.where(search.memory_address_contains("0x7f00000070"))
    found, more = search.limited(rows.select("idx").orderBy("idx"), 30)
    return found.withColumn("more", F.lit(more))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    indexed_data_search, indexed_searches, indexed_find_next, deep_pages, nth_matches, saved_result_page, address_buckets, candidate_estimate, register_directory, last_write_of_read_bytes,
    stored_provenance, states_at_positions, taint_of_many_roots, search_dispatch, register_sources, accesses_of_kinds, memory_panels, exported_lines, byte_offsets, instructions_at_bytes,
    written_register_sets, mentions_of_addresses,
)}

#: Register writes of the log: (i, name, x: its name in data flow, val, is_w).
_WRITES = """
, w AS (
  SELECT i, CASE r WHEN 1 THEN 'X2' WHEN 2 THEN 'X3' WHEN 4 THEN 'SP' WHEN 5 THEN 'W5' WHEN 6 THEN 'FP' WHEN 7 THEN 'X7' END AS name,
         CASE r WHEN 1 THEN 'X2' WHEN 2 THEN 'X3' WHEN 4 THEN 'SP' WHEN 5 THEN 'X5' WHEN 6 THEN 'X29' WHEN 7 THEN 'X7' END AS x,
         CASE r WHEN 2 THEN v + 1 WHEN 4 THEN s - 16 WHEN 5 THEN half ELSE v END AS val, r = 5 AS is_w
  FROM t WHERE r NOT IN (0, 3)
  UNION ALL SELECT i, 'LR', 'X30', 0, false FROM t WHERE r = 6)"""
_HALF, _OFFSET = "(SELECT count(*) // 2 FROM events)", "(SELECT offset_text FROM t WHERE i = 0)"
_HEX = "lower(to_hex({}))".format
#: Lines of the log: (file, i: the instruction that they belong to, n, file_offset, size).
_PLACES = """
, every AS (
  SELECT CASE WHEN r = 7 THEN next ELSE here END AS file, i, 0 AS n, line FROM t
  UNION ALL SELECT next, i, unnest(range(1, len(more) + 1)), unnest(more) FROM t WHERE len(more) > 0
  UNION ALL SELECT 0, -1, 0, 'Original SP: 0x7fd0'),
l AS (SELECT *, octet_length(encode(line)) + 1 AS size FROM every),
o AS (SELECT file, i, n, size, (sum(size) OVER (PARTITION BY file ORDER BY i, n) - size)::BIGINT AS file_offset FROM l)"""
_RANKED = """
, f AS (SELECT mnemonic, min(i) AS place FROM t WHERE starts_with(mnemonic, '{}') GROUP BY ALL),
o AS (SELECT t.*, row_number() OVER (ORDER BY place, i) - 1 AS number, count(*) OVER () AS n FROM t JOIN f USING (mnemonic))"""

ORACLES: dict[str, str] = {
    "indexed_data_search": _sql(f"""
, term AS (
  SELECT 0 AS term, {_HEX("((SELECT count(*) FROM events) // 16 * 2654435761 + 12345) % 281474976710656")} AS body
  UNION ALL SELECT 1, {_HEX("139637976727552 + 4096 * 7")} UNION ALL SELECT 2, '7f000'),
token AS (SELECT term, '0x' || body AS plain, CASE WHEN len(body) % 2 = 0 THEN trim(regexp_replace(body, '(..)', '\\1 ', 'g')) ELSE body END AS other FROM term)
SELECT term, i AS index, i + 1 AS line FROM t JOIN token ON contains(t.line, plain) OR contains(t.line, other)
UNION ALL SELECT 4, i, i + 1 FROM t WHERE r = 6"""),
    "indexed_searches": _sql(f"""
, listed AS (SELECT idx, string_agg('0x' || {_HEX("addr")}, ', ' ORDER BY slot) AS addresses FROM m WHERE kind IN ('R', 'W') GROUP BY ALL),
shown AS (SELECT t.*, coalesce(addresses, '-') AS memory_address, mnemonic || ' ' || operands AS instruction_text FROM t LEFT JOIN listed ON listed.idx = t.i)
SELECT 'offset' AS how, i AS index, instruction_text, memory_address FROM shown WHERE offset_text = {_OFFSET}
UNION ALL SELECT 'mnemonic', i, instruction_text, memory_address FROM shown WHERE mnemonic = 'stp'"""),
    "indexed_find_next": _sql(f"""
SELECT address AS term, coalesce(min(i) FILTER (WHERE i >= {_HALF}), min(i)) AS idx, 'address' AS how FROM t WHERE address IN (SELECT address FROM t WHERE i < 5) GROUP BY ALL"""),
    "deep_pages": _sql(_RANKED.format("ldr") + f"""
, p AS (SELECT *, row_number() OVER (ORDER BY i) - 1 AS number, count(*) OVER () AS n FROM t WHERE offset_text = {_OFFSET})
SELECT 'mnemonic' AS how, i AS index, mnemonic, address AS instruction_address FROM o WHERE number BETWEEN n // 2 AND n // 2 + 19
UNION ALL SELECT 'offset', i, mnemonic, address FROM p WHERE number BETWEEN n // 2 AND n // 2 + 19"""),
    "nth_matches": _sql(_RANKED.format("ld") + f"""
SELECT 'mnemonic' AS how, i AS idx, n FROM o WHERE number = n - 1
UNION ALL SELECT 'offset', max(i), count(*) FROM t WHERE offset_text = {_OFFSET}"""),
    "saved_result_page": _sql(f"""
, o AS (
  SELECT i, '0x' || {_HEX("addr")} AS memory_address, row_number() OVER (ORDER BY '0x' || {_HEX("addr")} DESC, i) - 1 AS number, count(*) OVER () AS n
  FROM t JOIN m ON m.idx = t.i WHERE starts_with(mnemonic, 'str'))
SELECT i AS index, memory_address FROM o WHERE number BETWEEN n // 2 AND n // 2 + 24"""),
    "address_buckets": _sql(f"""
SELECT rpad({_HEX("addr")}[:6], 6, '0') AS bucket, count(*) AS n, count(*) FILTER (WHERE kind = 'W') AS n_writes, min(addr) FILTER (WHERE kind = 'W') AS lowest,
  max(addr) FILTER (WHERE kind = 'W') AS highest, (max(size) FILTER (WHERE kind = 'W'))::INTEGER AS widest, min(idx) AS first_idx, max(idx) AS last_idx FROM m GROUP BY ALL"""),
    "candidate_estimate": _sql(f"SELECT count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM m WHERE starts_with({_HEX('addr')}, '7f0000')"),
    "register_directory": _sql(_WRITES + "SELECT x AS analysis_reg, count(DISTINCT i) AS n, min(i) AS first_idx, max(i) AS last_idx FROM w GROUP BY ALL"),
    "last_write_of_read_bytes": _sql("""
, wb AS (SELECT idx, slot, unnest(range(addr, addr + size)) AS at FROM m WHERE kind = 'W'),
rb AS (SELECT idx, slot, unnest(range(0, size)) AS byte, unnest(range(addr, addr + size)) AS at FROM m WHERE kind = 'R')
SELECT rb.idx, rb.slot, rb.byte, wb.idx AS write_idx, wb.slot AS write_slot FROM rb ASOF LEFT JOIN wb ON wb.at = rb.at AND wb.idx < rb.idx"""),
    "stored_provenance": f"""SELECT *, CASE kind WHEN 'load' THEN '读取' WHEN 'write' THEN '写入' ELSE '计算' END AS label FROM ({LOG_ORACLES["data_provenance"]})""",
    "states_at_positions": _sql(_WRITES + f"""
SELECT t.i AS idx, CASE name WHEN 'W5' THEN 'X5' ELSE name END AS register,
  (coalesce(arg_max(val, w.i) FILTER (WHERE NOT is_w), 0) & ~4294967295) | coalesce(arg_max(val & 4294967295, w.i), 0) AS value
FROM t JOIN w ON w.i <= t.i WHERE t.i % {EVERY} = 0 GROUP BY ALL"""),
    "taint_of_many_roots": _sql(_WRITES + f"""
, uses AS (
  SELECT i, unnest(CASE r WHEN 0 THEN ['X0', 'X1'] WHEN 1 THEN ['X0'] WHEN 2 THEN ['X2'] WHEN 3 THEN ['X0', 'X3', 'X4'] WHEN 4 THEN ['SP', 'X2', 'X3'] WHEN 5 THEN ['SP'] WHEN 6 THEN ['X0', 'X6'] ELSE ['X8'] END) AS reg FROM t),
du AS MATERIALIZED (SELECT uses.i, w.i AS def FROM uses ASOF JOIN w ON w.x = uses.reg AND w.i < uses.i),
reach AS (
  SELECT 2 * t.i + place AS root, max(w.i) AS i FROM t, (SELECT 0 AS place, 'X3' AS reg UNION ALL SELECT 1, 'X5') JOIN w ON w.x = reg AND w.i <= t.i WHERE t.i % {EVERY} = 0 GROUP BY ALL
  UNION
  SELECT root, def FROM reach JOIN du USING (i)),
n AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY i DESC) AS place FROM reach),
read AS (SELECT i, string_agg(reg, ',' ORDER BY reg) AS read_regs FROM uses GROUP BY i)
SELECT root, i AS index, mnemonic, x AS hit_writes, read_regs FROM n JOIN t USING (i) JOIN w USING (i) JOIN read USING (i) WHERE place <= {TAINT_STEPS}""", recursive=True),
    "search_dispatch": _sql(f"""
SELECT '5' AS term, 'line' AS kind, 4 AS idx
UNION ALL SELECT 'strb', 'mnemonic', i FROM t WHERE r = 3
UNION ALL SELECT offset_text, 'offset', i FROM t WHERE offset_text = {_OFFSET}
UNION ALL SELECT address, 'next', coalesce(min(i) FILTER (WHERE i >= 4), min(i)) FROM t WHERE address = (SELECT address FROM t WHERE i = 0) GROUP BY ALL"""),
    "register_sources": _sql(_WRITES + f"""
SELECT asked.reg AS register, max(i) AS idx FROM (VALUES ('SP', 'SP'), ('FP', 'X29'), ('X30', 'X30'), ('w5', 'X5'), ('X7', 'X7')) AS asked(reg, name) JOIN w ON w.x = asked.name WHERE i < {_HALF} GROUP BY ALL"""),
    "accesses_of_kinds": _sql(f"SELECT idx AS index, kind AS access, '0x' || {_HEX('addr')} AS memory_address FROM m WHERE kind IN ('R', 'D*') AND starts_with({_HEX('addr')}, '7f0000')"),
    "memory_panels": _sql(f"""
SELECT i AS idx, concat('*0x', {_HEX("a + 32")}, '  41 42 ', lpad({_HEX("k % 256")}, 2, '0'), '  |AB', CASE WHEN k % 256 BETWEEN 32 AND 126 THEN chr((k % 256)::INTEGER) ELSE '.' END, '|', chr(10),
  ' 0x', {_HEX("a + 48")}, '  00 01  |..|', chr(10), 'X7: "s', k % 10, '" (73 3', k % 10, ')') AS text FROM t WHERE r = 7"""),
    "exported_lines": _sql(f"""
SELECT 'tsv' AS form, concat(i, chr(9), mnemonic, chr(9), '0x', {_HEX("a - 4")}) AS line FROM t WHERE r = 3
UNION ALL SELECT 'fixed', concat(rpad((i + 1)::VARCHAR, 6, ' '), ' ', rpad(address[:14], 14, ' '), ' ', rpad(offset_text[:10], 10, ' '), ' ', rpad(mnemonic, 8, ' '), ' ', rpad(operands[:40], 40, ' '), ' ', comment)
FROM t WHERE i < 40"""),
    "byte_offsets": _sql(_PLACES + """,
h AS (SELECT i, file_offset, lead(file_offset) OVER (ORDER BY i) AS next_file_offset FROM o WHERE n = 0 AND i BETWEEN 0 AND 99)
SELECT i AS idx, file_offset, next_file_offset, i = (SELECT max(i) FROM h WHERE file_offset <= (SELECT max(file_offset) // 2 FROM h WHERE next_file_offset IS NOT NULL)) AS holds_middle
FROM h WHERE next_file_offset IS NOT NULL"""),
    "instructions_at_bytes": _sql(_PLACES + f""",
e AS (SELECT file, ((max(file_offset + size) - 1) // 1048576 + 2) * 1048576 AS past FROM o GROUP BY ALL),
asked AS (SELECT file, unnest(range(0, past, {BYTES})) AS place FROM e)
SELECT asked.file::BIGINT AS file, place::BIGINT AS "at", CASE WHEN i >= 0 THEN i END AS idx FROM asked ASOF JOIN o ON o.file = asked.file AND o.file_offset <= place"""),
    "written_register_sets": _sql(_WRITES + "SELECT i AS idx, string_agg(x, ',' ORDER BY x) AS writes FROM w GROUP BY ALL"),
    "mentions_of_addresses": _sql(f"""
, f AS (SELECT DISTINCT idx FROM m WHERE contains({_HEX("addr")}, '7f00000070'))
SELECT idx, (SELECT count(*) FROM f) > 30 AS more FROM f ORDER BY idx LIMIT 30"""),
}
