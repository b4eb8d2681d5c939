"""Indexes, directories and pages: what they give, and that little is read for it."""

import functools
import random
from collections import Counter

import pyarrow as pa
import pytest
from oracle import assert_same
from pyspark.sql import functions as F
from test_positions import rows_scanned
from test_trace import EDGES, GOLDEN, signed

from tracelake.functions import terms
from tracelake.operators import grams, lineage, lookup, pages, search, tables
from tracelake.plans import index_twins
from tracelake.plans.trace import Trace
from tracelake.sources import store

N = 20_000


one_trace = functools.cache(index_twins.stored_trace)


@pytest.mark.parametrize("name", sorted(index_twins.ORACLES))
def test_queries_match_their_sql(spark, sf_dir, monkeypatch, name):
    # All ask one store, whose tables the first to need them builds.
    monkeypatch.setattr(index_twins, "stored_trace", one_trace)
    assert_same(spark, sf_dir, index_twins.QUERIES[name], index_twins.ORACLES[name])


def in_pages(df, folder, order, bloom=None):
    """Written in one sorted file of short pages, so that what a scan gives out shows what it could leave out."""
    writer = df.coalesce(1).sortWithinPartitions(*order).write.option("parquet.page.row.count.limit", 200)
    (writer.option(f"parquet.bloom.filter.enabled#{bloom}", True) if bloom else writer).parquet(str(folder))
    return df.sparkSession.read.parquet(str(folder))


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """A trace of N instructions whose lines hold random numbers; and the tables of its indexes."""
    folder = tmp_path_factory.mktemp("wide")
    rows = spark.range(N).selectExpr(
        "id AS idx", "concat('0x', hex(1879048192 + 4 * (id % 9001))) AS address", "concat('0x', lower(hex(4096 + 4 * (id % 4999)))) AS offset", "4096 + 4 * (id % 4999) AS offset_val",
        "CASE WHEN id % 4001 = 7 THEN 'svc' WHEN id % 2 = 0 THEN 'mov' ELSE 'add' END AS mnemonic", "'x0, x1' AS operands", "concat('X0=0x', lower(substr(md5(cast(id AS string)), 1, 12))) AS comment",
    )
    rows = rows.withColumn("raw_line", F.concat_ws(" ", F.lower("address"), "mnemonic", "operands", "comment")).withColumn("raw_lines", F.array("raw_line"))
    none = "cast(array() AS array<struct<slot:int,type:string,address:string,instruction_address:string,data_size:int,data_value:string>>)"
    dump = "cast(array() AS array<struct<slot:int,address:string,data:array<string>,is_modified:boolean>>)"
    instruction = in_pages(rows.selectExpr("*", f"{none} AS memory_ops", f"{dump} AS memory_dump"), folder / "i", ["idx"])
    by_gram = in_pages(grams.by_gram(instruction), folder / "g", ["gram", "block"], "gram")
    by_address = in_pages(tables.by_address(instruction), folder / "a", ["address", "idx"], "address")
    by_offset, by_mnemonic = (in_pages(f(instruction), folder / n, [c, "idx"]) for f, n, c in ((tables.by_offset, "o", "offset_val"), (tables.by_mnemonic, "m", "mnemonic")))
    return {"instruction": instruction, "by_gram": by_gram, "gram": grams.gram_counts(by_gram).persist(), "by_address": by_address, "by_offset": by_offset, "by_mnemonic": by_mnemonic}


def test_data_search_reads_candidate_blocks(wide):
    line = wide["instruction"].where("idx = 12345").first()
    for term in (line.comment[3:], line.comment[5:], "no such text", "0xfffffffffffff", line.comment[3:12], "x0, "):
        plain = search.all_by_data(wide["instruction"], term)
        found = search.all_by_data(wide["instruction"], term, wide["by_gram"], wide["gram"])
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    assert sum(rows_scanned(search.all_by_data(wide["instruction"], line.comment[3:], wide["by_gram"], wide["gram"]))) <= 1_000
    assert grams.candidate_blocks(wide["by_gram"], wide["gram"], ["abc"]) is None


def test_offset_and_mnemonic_searches_read_their_ranges(wide):
    text = wide["instruction"].where("idx = 77").first().offset
    found = search.all_by_offset(wide["instruction"], text, wide["by_offset"])
    assert [r["index"] for r in found.collect()] == [i for i in range(N) if i % 4999 == 77] and sum(rows_scanned(found)) <= 5_000
    names = tables.mnemonic_counts(wide["by_mnemonic"])
    chunks = wide["by_mnemonic"].groupBy("mnemonic", F.expr(f"idx div {pages.RANK_CHUNK}").alias("chunk")).agg(F.count("*").alias("n"))
    assert [r["index"] for r in search.all_by_mnemonic(wide["instruction"], names, "sv*", chunks).collect()] == [i for i in range(N) if i % 4001 == 7]


def test_next_address_reads_its_row_group(wide):
    address = wide["instruction"].where("idx = 5000").first().address.lower()
    for start in (0, 5001, 15_000):
        have = search.next_by_address(wide["instruction"], address, start, wide["by_address"])
        assert have.first() == search.next_by_address(wide["instruction"], address, start).first()
    assert sum(rows_scanned(have)) <= 1_000
    assert search.next_by_address(wide["instruction"], "0x12", 0, wide["by_address"]).first() is None


def test_pages_of_postings_and_saved_results(wide, monkeypatch):
    monkeypatch.setattr(pages, "RANK_CHUNK", 512)
    names = tables.mnemonic_counts(wide["by_mnemonic"]).persist()
    ranks = pages.ranks(wide["by_mnemonic"], "mnemonic").persist()
    places = {"mov": 0, "add": 1, "svc": 7}
    kind = lambda i: "svc" if i % 4001 == 7 else "mov" if i % 2 == 0 else "add"
    for term, wanted in (("*", []), ("m", ["mov"]), ("s*", ["svc"]), ("a", ["add"])):
        order = sorted((i for i in range(N) if kind(i) in wanted), key=lambda i: (places[kind(i)], i))
        for top, count in ((0, 3), (len(order) // 2, 30), (max(0, len(order) - 2), 9), (len(order) + 5, 4), (1000, 0)):
            have = [r["index"] for r in search.page_by_mnemonic(wide["instruction"], wide["by_mnemonic"], names, term, top, count, ranks).collect()]
            assert have == order[top : top + count]
    assert search.nth_by_mnemonic(wide["by_mnemonic"], names, "add", 4000, ranks).first()[0] == [i for i in range(N) if kind(i) == "add"][4000]
    result = pages.SavedResult(wide["instruction"].select("idx", "comment").repartition(7), "comment", "idx")
    order = [tuple(r) for r in wide["instruction"].select("idx", "comment").orderBy("comment", "idx").collect()]
    assert result.count() == N
    for top, count in ((0, 5), (9_990, 40), (N - 3, 10), (N, 5)):
        assert [tuple(r) for r in result.page(top, count).collect()] == order[top : top + count]
    assert pages.SavedResult(wide["instruction"].limit(0), "idx").page(0, 5).count() == 0


@pytest.mark.parametrize("most", [1, 3, 128])
def test_ranges_hold_all_places(spark, most):
    r = random.Random(most)
    for places in ([], [5], [0, 1, 2, 9], sorted(r.sample(range(1000), 50)), [3, 10**12]):
        ranges = lookup.ranges_of(spark.createDataFrame([(p,) for p in places * 2], "at long"), 4, most)
        assert len(ranges) <= most and all(any(a <= x <= b for a, b in ranges) for p in places for x in (4 * p, 4 * p + 3))
        assert most < 128 or len(places) > 128 or sum(b - a + 1 for a, b in ranges) == 4 * len(places)


def byte_writes(rows, i, a, n):
    """By hand: the last write before ``i`` of each of ``n`` bytes."""
    out = []
    for k in range(n):
        hits = [(j, s) for j, s, kind, b, m in rows if kind == "W" and j < i and (a + k - b) % 2**64 < m]
        out.append(max(hits, default=None))
    return out


def test_last_writes_of_read_bytes(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(2), r.choice("RW"), r.randrange(30), r.choice([1, 2, 4, 8, 20])) for i in range(80)] + [(90 + i, 0, "RW"[i % 2], a, 9) for i, a in enumerate(EDGES * 2)]
    accesses = spark.createDataFrame([(i, s, k, signed(a), n) for i, s, k, a, n in rows], "idx long, slot int, kind string, addr long, size int")
    uses = lineage.memory_def_use(accesses, chunk=7).persist()
    have = {}
    for row in uses.collect():
        for k, w in enumerate(row.last_writes):
            have[row.idx, row.slot, row["at"] + k] = tuple(w) if w else None
    want = {(i, s, k): w for i, s, kind, a, n in rows if kind == "R" for k, w in enumerate(byte_writes(rows, i, a, n))}
    assert have == want
    for i, s, kind, a, n in rows[::5]:
        if kind == "R":
            part = [w for w in byte_writes(rows, i, a, n)[1:3] if w]
            found = lineage.last_write_of(uses, i, s, 1, 2).first()
            assert (tuple(found) if found else None) == max(part, default=None)


def test_pruned_provenance_equals_the_scan(spark, monkeypatch):
    r = random.Random(5)
    rows = []
    for i in range(150):
        a, n = r.choice([r.randrange(64), 2**64 - r.randrange(1, 20), 2**63 - 8 + r.randrange(16)]), r.choice([1, 2, 4, 8, 40])
        rows.append((i, 0, "W", a, n, r.choice([None, "".join(r.choice(["00", "11"]) for _ in range(n))]), ["X1"]))
    df = spark.createDataFrame([(i, s, k, signed(a), f"{a:x}", n, v, x) for i, s, k, a, n, v, x in rows], "idx long, slot int, kind string, addr long, addr_hex string, size int, value_bytes string, source_registers array<string>")
    stores = df.withColumn("bucket", tables.address_bucket(F.col("addr_hex"))).persist()
    buckets = tables.bucket_directory(stores).persist()
    for most in (8, 0):
        monkeypatch.setattr(lineage, "_BUCKETS", most)
        for _ in range(12):
            a, n, at = r.choice([r.randrange(64), 2**64 - 3, 2**63 - 2]), r.choice([1, 4, 8]), r.randrange(150)
            value = r.choice([None, "".join(r.choice(["00", "11"]) for _ in range(n))])
            want = lineage.previous_matching_write(stores, at, signed(a), n, value, 20).first()
            assert lineage.previous_matching_write(stores, at, signed(a), n, value, 20, buckets).first() == want
    accesses = [(i, s, k, a, n) for i, s, k, a, n, _, _ in rows] + [(200 + i, 0, "R", a, 8) for i, a in enumerate((3, 20, 2**64 - 4, 2**63 - 4))]
    uses = lineage.memory_def_use(spark.createDataFrame([(i, s, k, signed(a), n) for i, s, k, a, n in accesses], "idx long, slot int, kind string, addr long, size int")).persist()
    for i, _, kind, a, _ in accesses[150:]:
        for skip, size, value in ((0, 8, None), (2, 4, "00110011"), (4, 2, "1111"), (0, 1, "00")):
            load = {"idx": i, "slot": 0, "addr": signed(a + skip), "skip": skip, "size": size, "bytes": value}
            assert lineage.writer_of(stores, load, 500, uses, buckets) == lineage.previous_matching_write(stores, i - 1, signed(a + skip), size, value, 500).first()


def test_stored_tables_appear_when_asked_for(spark, tmp_path):
    (tmp_path / "log.txt").write_text(GOLDEN)
    trace = Trace.open(spark, str(tmp_path / "log.txt"), str(tmp_path / "s"))
    folder = next(p for p in (tmp_path / "s").iterdir() if p.is_dir())
    assert {p.name for p in folder.iterdir()} == {"instruction"}
    assert [r["index"] for r in trace.all_by_data("0x1235").collect()] == [1, 2, 3] and trace.state_at(3).count() == 4
    assert {p.name for p in folder.iterdir()} == {"instruction", "by_gram", "gram", "register_write", "checkpoint"}
    again = Trace.open(spark, str(tmp_path / "log.txt"), str(tmp_path / "s"))
    plain = Trace.of(again.instruction)
    for term in ("0x1d48", "0x7fc0", "0x7a1c2b3d44"):
        assert again.find_next(term).first() == plain.find_next(term).first()
    assert [tuple(r) for r in again.provenance("X2", 3)[0].collect()] == [tuple(r) for r in plain.provenance("X2", 3)[0].collect()]
    assert again.candidates_by_address("0x7fc0").first()["n"] == 1 and terms.is_address("7fc0")
    # What a broken build leaves behind isn't taken for a table.
    (folder / "by_offset.half").mkdir()
    assert again.count_by_offset("0x1d48").first()[0] == 1 and set(store.TABLES) >= set(store.ORDER)
    with pytest.raises(AttributeError):
        _ = plain.checkpoint


def test_parts_of_files_are_read_from_the_log_when_asked_for(spark, tmp_path):
    (tmp_path / "log.txt").write_text(GOLDEN)
    log = str(tmp_path / "log.txt")
    trace, late = (Trace.open(spark, log, str(tmp_path / s)) for s in ("s", "late"))
    folder = next(p for p in (tmp_path / "s").iterdir() if p.is_dir())
    assert trace.count() == trace.instruction.count() and not (folder / "file_part").exists()
    assert trace.file_part.agg(F.min("first_idx"), F.max("last_idx")).first()[1] == trace.count() - 1
    assert {p.name for p in folder.iterdir()} == {"instruction", "file_part"}
    (tmp_path / "log.txt").write_text(GOLDEN + GOLDEN)
    with pytest.raises(ValueError, match="changed"):
        _ = late.file_part


def runs_by_brute_force(rows):
    """{(run, block)} of (idx, lines)."""
    return {(line[i : i + 4], idx // 64) for idx, lines in rows for line in lines for i in range(len(line) - 3)}


def test_index_over_text_is_made_where_lines_are_read(spark):
    r = random.Random(4)
    some = ["", "abc", "abcd", "Ωmega ≤ 0x12", "tab\there", "日本語のテキスト", "x" * 9, "0x7f00 0x7f01"]
    rows = [(i, [r.choice(some) + f"{r.randrange(4096):x}" * r.randrange(3) for _ in range(r.randrange(4))]) for i in range(700)] + [(70_000, ["far off"]), (1 << 40, ["farther"])]
    lines = spark.createDataFrame(rows, "idx long, raw_lines array<string>")
    index = grams.by_gram(lines.coalesce(1))
    flat = [(r.gram, r.block + at) for r in index.collect() for at in r.within]
    assert set(flat) == runs_by_brute_force(rows)
    plan = grams.by_gram(lines)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Explode" not in plan
    # One row for a run among 1,024 blocks, and the same by small batches and pieces of text.
    assert len({(r.gram, r.block) for r in index.collect()}) == index.count() <= len(runs_by_brute_force([(0, lines) for _, lines in rows])) + 12
    counts = {r["gram"]: r["n"] for r in grams.gram_counts(index).collect()}
    assert counts == Counter(run for run, _ in set(flat)) and len(flat) == len(set(flat))


@pytest.mark.parametrize("piece", [1, 50, 1 << 20])
def test_runs_of_batches_and_pieces(monkeypatch, piece):
    monkeypatch.setattr(grams, "PIECE", piece)
    rows = [(i, [f"0x{i * 7919:x} = é{i}", "", "ab", f"{i:05d}"][: i % 5]) for i in range(300)]
    batches = [pa.record_batch([pa.array([i // 64 for i, _ in part], pa.int64()), pa.array([x for _, x in part], pa.list_(pa.string()))], ["block", "raw_lines"]) for part in (rows[:10], rows[10:100], rows[100:])]
    found = [(row["gram"], row["block"] + at) for b in grams._indexed(iter(batches)) for row in b.to_pylist() for at in row["within"]]
    assert set(found) == runs_by_brute_force(rows) and len(found) == len(set(found))


def test_bytes_that_are_no_text_are_indexed_around(spark):
    lines = spark.range(1).selectExpr("id AS idx", "array(concat('0x12', cast(X'ff' AS string), 'value'), concat(cast(X'e2' AS string), 'tail')) AS raw_lines")
    assert {r.gram for r in grams.by_gram(lines).select("gram").collect()} == {"0x12", "valu", "alue", "tail"}


STATES = """Original SP: 0x7fd0
[m 0x10] 0x1000: "str w1, [x2]" x2=0x7fc0 w1=4660 => x2=0x7fc0
[m 0x14] 0x1004: "ldr x3, [x2]" x2=0x7fc0 => x3=0x1234
note 0x1234 here
[m 0x18] 0x1008: "add x1, x1, #1" x1=1 => x1=2
note 0x1234 and 0x7fd8 here
[m 0x1c] 0x100c: "str x1, [x2]" x2=0x7fc0 x1=0x5 => x2=0x7fc0
memory write at 0x7fc0, instruction address = 0x100c, data size = 2, data value = 3412
note 0x1234 here
[m 0x20] 0x1010: "str x4, [x2]" x2=0x7fc0 => x4=4660
note 0x1234 here
*7fc0 34 12 |4.|
"""


def test_listing_waits_with_what_lines_imply(spark, tmp_path):
    (tmp_path / "log.txt").write_text(GOLDEN + STATES)
    whole = Trace.open(spark, str(tmp_path / "log.txt"), str(tmp_path / "s"))
    trace = Trace.open(spark, str(tmp_path / "log.txt"), str(tmp_path / "late"), effects=False)
    folder = next(p for p in (tmp_path / "late").iterdir() if p.is_dir())
    assert {p.name for p in folder.iterdir()} == {"listing"} and trace.initial_sp == whole.initial_sp and trace.count() == whole.count()
    plain = Trace.of(whole.instruction)
    for term in ("0x1234", "1234", "0x1235", "0x7fd8", "34 12", "here", "x2", "0x5", "no such text", "3412", "0x7fc0"):
        want = sorted(r["index"] for r in whole.all_by_data(term).collect())
        for t in (trace, whole, plain):
            assert sorted(r["idx"] for r in t.places_by_data(term).collect()) == want, term
    # A decimal of an instruction's registers is hexadecimal in what it stores: no line of its own has that.
    assert 8 in [r["idx"] for r in trace.places_by_data("0x1234").collect()] and 6 not in [r["idx"] for r in trace.places_by_data("0x7fd8").collect()]
    with pytest.raises(ValueError, match="value or text"):
        trace.places_by_data(" ")
    assert {p.name for p in folder.iterdir()} == {"listing", "by_gram", "gram"}
    have, want = (sorted(map(str, t.instruction.collect())) for t in (trace, whole))
    assert have == want and trace.instruction.schema == whole.instruction.schema
    assert {p.name for p in folder.iterdir()} == {"listing", "by_gram", "gram", "instruction"}
    again = Trace.open(spark, str(tmp_path / "log.txt"), str(tmp_path / "late"))
    assert [r["index"] for r in again.all_by_data("0x1235").collect()] == [r["index"] for r in whole.all_by_data("0x1235").collect()]
