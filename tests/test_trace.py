"""The golden trace and the targeted cases, worked out by hand."""

import random

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from tracelake.functions import parse, registers, terms, u64
from tracelake.functions.render import fixed_width, memory_value
from tracelake.operators import lineage, search, state, tables
from tracelake.plans import log_twins, twins
from tracelake.plans.trace import Trace
from tracelake.sources import logs, store

GOLDEN = """Original SP: 0x7fd0
0x7a1c2b3d40\t0x1d40\tldr x0, [sp, #0x10] ; SP=0x7fd0 X0=0x0 -> 0x1234
[12:00:01][libfoo.so 0x1d44] 0x7a1c2b3d44: "add w1, w0, #1" w0=0x1234 w1=0x0 => w1=0x1235
[libfoo.so 0x1d48] 0x7a1c2b3d48: "stp x0, x1, [sp, #-0x10]!" x0=0x1234 x1=0x1235 sp=0x7fd0 => sp=0x7fc0
[libfoo.so 0x1d4c] 0x7a1c2b3d4c: "ldr x2, [sp, #8]" sp=0x7fc0 x2=0x0 => x2=0x1235
"""


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("trace")
    (folder / "log.txt").write_text(GOLDEN)
    return Trace.open(spark, str(folder / "log.txt"), str(folder / "store"))


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


def test_golden_tables(golden):
    rows = golden.instruction.orderBy("idx").collect()
    assert golden.initial_sp == "0x7fd0"
    assert [(r.idx, r.offset, r.mnemonic) for r in rows] == [(0, "0x1d40", "ldr"), (1, "0x1d44", "add"), (2, "0x1d48", "stp"), (3, "0x1d4c", "ldr")]
    assert [[(c.register, c.old_value, c.new_value) for c in r.register_changes] for r in rows] == [[("X0", "0x0", "0x1234")], [("W1", "0x0", "0x1235")], [("SP", "0x7fd0", "0x7fc0")], [("X2", "0x0", "0x1235")]]
    assert [[(o.type, o.address, o.data_size, o.data_value) for o in r.memory_ops] for r in rows] == [
        [("read", "0x7fe0", 8, "X0=0x1234")], [], [("write", "0x7fc0", 16, "X0=0x1234, X1=0x1235")], [("read", "0x7fc8", 8, "X2=0x1235")]]
    begins = [GOLDEN.index(s) for s in ("0x7a1c2b3d40\t", "[12:", "[libfoo.so 0x1d48", "[libfoo.so 0x1d4c")]
    assert [r.file_offset for r in rows] == begins
    assert logs.instruction_at_offset(golden.instruction, begins[2] + 5).first()[0] == 2
    assert not logs.instruction_at_offset(golden.instruction, 3).count()
    ends = [r.next_file_offset for r in logs.with_next_offset(golden.instruction, len(GOLDEN)).orderBy("idx").collect()]
    assert ends == [*begins[1:], len(GOLDEN)]


def test_golden_state(golden):
    shown = {r.register: r.x_value for r in golden.state_for_display(3).collect()}
    assert len(shown) == 34 and {k: v for k, v in shown.items() if v != "0x0"} == {"X0": "0x1234", "X1": "0x1235", "X2": "0x1235", "SP": "0x7fc0"}
    assert {r.register: r.x_value for r in golden.state_for_display(1).collect()}["SP"] == "0x0"
    assert golden.register_source("SP", 3).first()[0] == 2 and golden.register_source("SP", 2).first() is None


def test_golden_lineage(golden):
    rows = [(r["index"], r.hit_writes, r.read_regs) for r in golden.taint("X1", 3).collect()]
    assert rows == [(1, ["X1"], ["X0"]), (0, ["X0"], ["SP"])]
    events, message = golden.provenance("X2", 3)
    rows = [(r.kind, r["index"], r.memory_address, r.value_hex) for r in events.orderBy("place").collect()]
    assert message == "ok" and rows == [("load", 3, "0x7fc8", "35 12 00 00 00 00 00 00"), ("write", 2, "0x7fc0", "34 12 00 00 00 00 00 00 35 12 00 00 00 00 00 00"), ("calc", 0, "-", "-")]
    assert events.where("kind = 'write'").first().detail.startswith("exact byte match") and "X0, X1" in events.where("kind = 'write'").first().detail


def test_golden_searches(golden):
    assert [(r["index"], r.access, r.memory_address) for r in golden.all_by_address("0x7fc0").collect()] == [(2, "W", "0x7fc0")]
    assert [r["index"] for r in golden.all_by_offset("0x1d48").collect()] == [2]
    assert [r["index"] for r in golden.all_by_mnemonic("ld*").collect()] == [0, 3]
    assert search.count_by_mnemonic(golden.mnemonic, "LD*").first()[0] == 2
    assert search.nth_by_mnemonic(golden.instruction, golden.mnemonic, "ld", 1).first()[0] == 3
    scopes = {r["index"]: r.match_scope for r in golden.all_by_data("0x1235").collect()}
    assert scopes == {1: "寄存器/注释", 2: "寄存器/注释 / 内存数据", 3: "寄存器/注释 / 内存数据"}
    assert [r["idx"] for r in golden.line(3).collect()] == [2] and not golden.line(9).count()
    assert golden.search("0x7a1c2b3d44")[1].first().asDict() == {"idx": 1, "how": "address"}
    assert golden.search("0x7fc8", 3)[0] == "offset" and golden.find_next("7fc8").first()["idx"] == 3
    assert golden.search("2")[0] == "line" and golden.search("st*")[0] == "mnemonic"
    # A match on the start line itself counts.
    assert golden.find_next("0x7a1c2b3d48", 2).first()["idx"] == 2


def test_narrow_tables_kinds_and_gates(golden, spark):
    assert [r[0] for r in golden.by_mnemonic.where("mnemonic = 'ldr'").orderBy("idx").select("idx").collect()] == [0, 3]
    assert golden.count_by_offset("0x1d48").first()[0] == 1 and golden.nth_by_offset("0x1d4c", 0).first()[0] == 3 and golden.nth_by_offset("0x1d4c", 1).first() is None
    assert golden.nth_by_mnemonic("ld", 1).first()[0] == 3
    assert golden.all_by_address("0x7fc0", kinds=("R",)).count() == 0
    assert golden.all_by_address("0x7fc0", kinds=("W", "R")).count() == 1
    for run, term in ((golden.all_by_address, "0x12"), (golden.all_by_offset, "1d48"), (golden.all_by_offset, "0x12345678"), (golden.all_by_mnemonic, "4x"), (golden.all_by_data, "  ")):
        with pytest.raises(ValueError):
            run(term)
    kinds = spark.createDataFrame([("load",), ("write",), ("calc",), ("other",), ("",), (None,)], "k string").select(lineage.event_kind(F.col("k"))).collect()
    assert [k[0] for k in kinds] == ["读取", "写入", "计算", "other", "-", "-"]
    rows, more = search.limited(golden.all_by_mnemonic("ld*"), 1)
    assert rows.count() == 1 and more and search.limited(golden.all_by_mnemonic("ld*"), None)[1] is False
    found = search.sorted_by(golden.all_by_mnemonic("l*"), "memory_address", descending=True)
    assert [r["index"] for r in found.collect()] == [0, 3] and [r["index"] for r in search.result_page(found, 1, 5).collect()] == [3]


def test_exports_and_panels(golden, tmp_path):
    found = golden.all_by_mnemonic("ld*")
    store.write_tsv(found, str(tmp_path / "out"))
    lines = [line for file in sorted((tmp_path / "out").glob("part-*.csv")) for line in file.read_text().splitlines()]
    assert lines[0] == "\t".join(found.columns) and [r.line for r in store.tsv_lines(found).collect()][0].split("\t")[:2] == ["0", "1"]
    grid = [r.line for r in store.fixed_width_lines(golden.page(1, 1)).collect()]
    assert grid == ["2      0x7a1c2b3d44   0x1d44     add      w1, w0, #1                               w0=0x1234 w1=0x0 => w1=0x1235"]
    assert golden.memory_panel(2).first().text == "W 0x7fc0 size 16: 0x1234, 0x1235"
    assert {r.idx: r.writes for r in tables.write_sets(golden.register_write).collect()} == {0: ["X0"], 1: ["X1"], 2: ["SP"], 3: ["X2"]}


EDGES = [0, 4, 2**63 - 3, 2**63 - 1, 2**63, 2**64 - 8, 2**64 - 1]


def signed(n):
    n %= 2**64
    return n - 2**64 if n >= 2**63 else n


def test_addresses_wrap_and_accesses_are_of_any_size(spark):
    rows = [(i, 0, "W", a, s) for i, (a, s) in enumerate((a, s) for a in EDGES for s in (1, 8, 20))] + [(50, 0, "W", 2**40, 70_000)]
    rows += [(100 + i, 0, "R", a, s) for i, (a, s) in enumerate((a + d, s) for a in EDGES for d in (-3, 0, 5) for s in (1, 8))] + [(300, 0, "R", 2**40 + 66_000, 4), (301, 0, "R", 2**40 + 70_000, 4)]
    df = spark.createDataFrame([(i, s, k, signed(a), n) for i, s, k, a, n in rows], "idx long, slot int, kind string, addr long, size int")
    overlap = lambda a, n, b, m: (b - a) % 2**64 < n or (a - b) % 2**64 < m
    want = {i: max((j for j, _, k, b, m in rows if k == "W" and j < i and overlap(a, n, b, m)), default=None) for i, _, k, a, n in rows if k == "R"}
    assert {x["idx"]: x["write_idx"] for x in lineage.previous_overlapping_writes(df).collect()} == want and want[300] == 50 and want[301] is None
    stores = df.where("kind = 'W'").withColumns({"value_bytes": F.lit(None).cast("string"), "source_registers": F.lit(None).cast("array<string>")})
    for i, _, k, a, n in rows:
        if k == "R" and i % 5 == 0:
            found = lineage.previous_matching_write(stores, i - 1, signed(a), n, None).first()
            assert (found["idx"] if found else None) == want[i]


def test_matching_bytes_of_wide_and_wrapping_stores(spark):
    rows = [(1, 0, "W", signed(2**64 - 2), 4, "aabbccdd", ["X1"]), (2, 0, "W", 0, 70_000, "ee" * 70_000, ["X2"]), (3, 0, "W", 100, 1, "00", ["X3"])]
    stores = spark.createDataFrame(rows, "idx long, slot int, kind string, addr long, size int, value_bytes string, source_registers array<string>")
    at = lambda addr, size, value: (lineage.previous_matching_write(stores, 9, signed(addr), size, value).first() or {"idx": None})["idx"]
    assert at(2**64 - 1, 3, "bbccdd") == 1 and at(66_000, 4, "eeeeeeee") == 2 and at(66_000, 4, "eeeeee00") is None and at(100, 1, "00") == 3 and at(1, 1, "dd") == 1


def test_a_block_that_spans_two_files_keeps_its_order(spark, tmp_path):
    read = lambda v: f"memory read at 0x{v}, instruction address = 0x1, data size = 1, data value = {v}\n"
    (tmp_path / "a.txt").write_text('[m 0x1] 0x1000: "ldr x1, [x2]" x2=0x10 => x1=0x1\n' + "padding that is long enough to matter\n" + read("aa"))
    (tmp_path / "b.txt").write_text(read("bb") + '[m 0x2] 0x1004: "nop"\n')
    rows = logs.read_trace(spark, str(tmp_path))[0].orderBy("idx").collect()
    assert [o.data_value for o in rows[0].memory_ops] == ["aa", "bb"] and [line[:8] for line in rows[0].raw_lines] == ["[m 0x1] ", "padding ", "memory r", "memory r"] and len(rows) == 2


def test_wrap(spark):
    matches = spark.createDataFrame([(2,), (9,)], "idx long")
    assert [search.next_of(matches, s).first()[0] for s in (5, 10, 9)] == [9, 2, 9]
    assert search.next_of(matches.limit(0), 1).first() is None


def test_store_is_reused_until_the_log_changes(spark, tmp_path):
    log = tmp_path / "log.txt"
    log.write_text(GOLDEN)
    first = store.open_store(spark, str(log), str(tmp_path / "s"))[1]
    assert store.open_store(spark, str(log), str(tmp_path / "s"))[1]["folder"] == first["folder"]
    log.write_text(GOLDEN + '[libfoo.so 0x1d50] 0x7a1c2b3d50: "nop"\n')
    found, again = store.open_store(spark, str(log), str(tmp_path / "s"))
    assert again["folder"] != first["folder"] and again["count"] == 5 and found["instruction"].count() == 5


def test_lines_belong_to_the_last_instruction_across_splits(spark, tmp_path):
    text = "junk\nmemory read at 0x1, instruction address = 0x1, data size = 1, data value = 00\n"
    for i in range(40):
        text += f'[m 0x{i:x}] 0x{4096 + i:x}: "ldr x1, [x2]" x2=0x10 => x1=0x{i:x}\nmemory read at 0xab{i:02x}, instruction address = 0x1, data size = 2, data value = 0102\n*7fe0 34 12 |4.|\n'
    (tmp_path / "log.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = logs.read_trace(spark, str(tmp_path / "log.txt"))[0].orderBy("idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.idx for r in rows] == list(range(40))
    assert all([o.address for o in r.memory_ops] == [f"0xab{r.idx:02x}"] and r.memory_dump[0].is_modified and r.memory_dump[0].data == ["34", "12"] for r in rows)
    assert all(text[r.file_offset :].startswith(f"[m 0x{r.idx:x}]") for r in rows)


def test_empty_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text("")
    trace = Trace.open(spark, str(tmp_path / "log.txt"), str(tmp_path / "s"))
    assert trace.count() == 0 and trace.state_at(5).count() == 0 and trace.find_next("0x12345678").first() is None


def changes(spark, line):
    rows = parse.with_snapshots(spark.createDataFrame([(line,)], "raw_line string"))
    return [(c.register, c.old_value, c.new_value) for c in rows.first().changes]


def fields_of(spark, line):
    return parse.with_instruction_fields(spark.createDataFrame([(line,)], "line string")).first().fields


def operation(spark, operands, comment, mnemonic="ldr"):
    line = f'[m 0x1] 0x1000: "{mnemonic} {operands}" {comment}'
    rows = spark.createDataFrame([(line, mnemonic, operands, "0x1000")], "raw_line string, mnemonic string, operands string, address string")
    return parse.with_effects(rows).first().inferred


def test_lines(spark):
    assert changes(spark, '[m 0x1] 0x10: "mov x0, x1" x0=0 => x0=0x0') == [("X0", "0", "0x0")]
    assert changes(spark, '[m 0x1] 0x10: "mov x0, x1" x0=0x1 => x0=0x1, x1=0x2') == [("X1", "", "0x2")]
    assert changes(spark, '[m 0x1] 0x10: "mov" x0=1 => x0=2 ; X5=0x0 -> 0x1') == [("X5", "0x0", "0x1")]
    assert changes(spark, "0x1\t0x2\tadd x0, x0 ; X0=0x1 -> 0x1") == [("X0", "0x1", "0x1")]
    fields = fields_of(spark, '[tag] 0x10: "ldr x0, [sp, #0x20]" x0=0x1 => x0=0x2')
    assert fields.asDict() == {"address": "0x10", "offset": "0x20", "mnemonic": "ldr", "operands": "x0, [sp, #0x20]", "comment": "x0=0x1 => x0=0x2"}
    assert fields_of(spark, "0x1\t0x2") is None
    assert one(spark, parse.dump_line(F.col("l")), l="*7fe0 34 12 |4.|").asDict() == {"address": "7fe0", "data": ["34", "12"], "is_modified": True}
    assert one(spark, parse.dump_line(F.col("l")), l="* 7fe0 34 12 |4.|") is None


def test_addresses(spark):
    assert operation(spark, "x1, [x0], #16", "x0=0x100 => x1=0x1").address == "0x100"
    assert operation(spark, "x1, [x0, #16]!", "x0=0x100 => x1=0x1").address == "0x110"
    assert operation(spark, "x2, [x0, w1, sxtw #2]", "x0=0x100 w1=0xffffffff => x2=0x1").address == "0xfc"
    assert operation(spark, "x2, [x0, #1]", "x0=0xffffffffffffffff => x2=0x1").address == "0x0"
    assert operation(spark, "x2, [x9]", "x0=0x1 => x2=0x1") is None
    assert operation(spark, "x0, [x1]", "x1=0x10 => x0=0x5 (string: \"ab\")").data_value == "X0=0x5 (string_hex: 61 62)"
    stored = operation(spark, "w3, [x1, #-4]", "x1=10 w3=0x7 => x1=10", "str")
    assert (stored.type, stored.address, stored.data_size, stored.data_value) == ("write", "0x6", 4, "W3=0x7")


def test_numbers(spark):
    edges = [0, 1, 2**31, 2**32 - 1, 2**32, 2**63 - 1, 2**63, 2**64 - 1]
    signed = lambda n: n - 2**64 if n >= 2**63 else n
    pairs = [(signed(a), signed(b), signed((a + b) % 2**64)) for a in edges for b in edges]
    rows = spark.createDataFrame(pairs, "a long, b long, c long")
    assert rows.where(u64.wrap_add(F.col("a"), F.col("b")) != F.col("c")).count() == 0
    cases = [("10", 16, 10), ("0x10", 16, 16), ("#-1!", None, -1), ("zz", None, None), ("010", 16, None), ("0b11", 0xB11, 3), ("0x" + "f" * 20, -1, -1), ("", None, None)]
    rows = spark.createDataFrame(cases, "t string, h long, a long").select(u64.hex_value(F.col("t")).eqNullSafe(F.col("h")), u64.auto_value(F.col("t")).eqNullSafe(F.col("a"))).collect()
    assert all(all(r) for r in rows)


def test_registers(spark):
    names = ["W3", "FP", "lr", "SP", "X31", "XZR", "Q0", "X005"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(registers.analysis_register(F.col("n")), registers.taint_register(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("X3", "X3"), ("X29", "X29"), ("X30", "X30"), ("SP", "SP"), (None, "X31"), (None, None), (None, None), ("X005", "X005")]
    reads = lambda m, ops, writes: one(spark, registers.read_registers(F.lit(m), F.lit(ops), F.array(*map(F.lit, writes))), i=1)
    assert reads("add", "x0, x0, #1", ["X0"]) == [] and reads("str", "x0, [x1, x2]", ["X1"]) == ["X0", "X1", "X2"] and reads("ldp", "x0, x1, [sp]", ["X0", "X1"]) == ["SP"]
    assert registers.related("w29") == ["W29", "X29"] and registers.related("FP") == ["FP", "X29"]


def test_terms():
    assert terms.data_tokens("deadbeef") == ["0xdeadbeef", "de ad be ef"] and terms.data_tokens("0x123") == ["0x123", "123"] and terms.data_tokens(" Foo ") == ["foo"]
    assert terms.exact_address("0x1234567") == "" and terms.is_offset("0x1234567") and terms.is_mnemonic("b.ne*") and not terms.is_address("0x12")
    assert [store.checkpoint_spacing(n) for n in (1, 512 << 20, 2 << 30, 8 << 30, 16 << 30)] == [500, 2000, 5000, 10000, 20000]


def test_padded_dump_addresses_do_not_match(spark):
    rows = spark.createDataFrame([("00007fe0", "7fe0", "7fe000"), ("7fe0", "7fe0", "7fe000")], "address string, addr_hex string, bucket string")
    assert [r.address for r in search.with_address_prefix(rows, "7fe0").collect()] == ["7fe0"]


def test_rendering(spark):
    value = lambda t: tuple(one(spark, memory_value(F.col("t")), t=t))
    assert value("") == ("?", "") and value("0XAB") == ("0xab", "") and value("X0=0X1, X1=2") == ("0x1, 2", "X0=0X1, X1=2")
    assert one(spark, fixed_width((F.col("t"), 4), (F.lit(7), 2)), t="abcdef") == "abcd 7 "


def history(seed, n=60):
    r = random.Random(seed)
    return [(i, k, f"{r.choice('XW')}{r.randrange(3)}", r.choice([hex(r.getrandbits(64)), hex(r.getrandbits(20)), "zz"])) for i in range(n) for k in range(r.randrange(3))]


def folded(rows, upto):
    out = {}
    for i, _, name, text in rows:
        if i <= upto:
            reg, old = f"X{name[1:]}", out.get(f"X{name[1:]}", 0)
            try:
                v = int(text, 16)
            except ValueError:
                v = None
            out[reg] = old if v is None else v if name[0] == "X" else (old >> 32 << 32) | (v & 0xFFFFFFFF)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_state_equals_an_ordered_fold(spark, seed):
    rows = history(seed)
    writes = tables.register_writes(spark.createDataFrame([(i, [(k, n, "", t)]) for i, k, n, t in rows], "idx long, register_changes array<struct<ordinal:int,register:string,old_value:string,new_value:string>>")).persist()
    for at in (0, 17, 59):
        assert {r.register: r.value % 2**64 for r in state.state_at(writes, at).collect()} == folded(rows, at)
    marks = state.checkpoints(writes, 60, 7, chunk=3).persist()
    for at in (0, 14, 56):
        assert {r.register: r.value % 2**64 for r in marks.where(F.col("idx") == at).collect()} == folded(rows, at)
    assert {r.register: r.value % 2**64 for r in state.state_at(writes, 31, marks, 7).collect()} == folded(rows, 31)
    assert all(folded(rows[: n + 1], 99)[r.state_reg] == r.state % 2**64 for n, r in enumerate(state.state_history(writes, chunk=5).orderBy("idx", "ordinal").collect()))


@pytest.mark.parametrize("seed", range(2))
def test_taint_equals_the_greedy_walk(spark, seed):
    r = random.Random(seed)
    ops = [(i, r.randrange(5), [r.randrange(5) for _ in range(r.randrange(3))]) for i in range(50)]
    line = lambda i, d, s: f'[m 0x1] 0x{i:x}: "add x{d}, {", ".join(f"x{x}" for x in s) or "#1"}" x{d}=0x0 => x{d}=0x1'
    lines = spark.createDataFrame([(i, i, 0, i, line(*op)) for i, *op in [(i, i, d, s) for i, d, s in ops]], "idx long, file_offset long, split int, at long, line string")
    trace = Trace.of(logs.instructions(logs.classified(lines)).persist())
    for steps in (3, 100):
        tainted, want, cursor = {2}, [], 40
        while cursor >= 0 and tainted and len(want) < steps:
            i, d, s = ops[cursor]
            cursor -= 1
            if d in tainted:
                tainted = tainted - {d} | (set(s) - {d})
                want.append((i, sorted(f"X{x}" for x in tainted)))
        have = [(n["index"], n.taint_after) for n in trace.taint("X2", 40, steps).collect()]
        assert have == want


def test_overlapping_writes(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(2), r.choice("RW"), r.randrange(20), r.choice([1, 2, 4, 8])) for i in range(80)]
    accesses = spark.createDataFrame(rows, "idx long, slot int, kind string, addr long, size int")
    have = {x["idx"]: x["write_idx"] for x in lineage.previous_overlapping_writes(accesses, chunk=9).collect()}
    want = {i: max((j for j, _, k, b, m in rows if k == "W" and j < i and b < a + n and a < b + m), default=None) for i, _, kind, a, n in rows if kind == "R"}
    assert have == want


@pytest.mark.parametrize("name", sorted(twins.ORACLES | log_twins.ORACLES))
def test_queries_match_their_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, (twins.QUERIES | log_twins.QUERIES)[name], (twins.ORACLES | log_twins.ORACLES)[name])
