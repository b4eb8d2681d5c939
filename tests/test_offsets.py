"""Bytes of files to instructions, and blocks of lines across splits and files."""

import random
import re

import pytest
from test_positions import rows_scanned

from tracelake.operators import offsets
from tracelake.plans.trace import Trace
from tracelake.sources import logs


def random_log(folder, seed, files, lines):
    """Files of random lines; of every byte (file, offset) the instruction it belongs to, and of these their own lines."""
    rng, owner, blocks, idx = random.Random(seed), {}, [], -1
    folder.mkdir()
    for f in range(files):
        text = b""
        # Some files have no instruction, so that a block goes on over several.
        for _ in range(0 if rng.random() < 0.1 else rng.randint(1, lines)):
            kind = rng.random() * (0.9 if rng.random() < 0.8 else 0.4)
            if kind < 0.2:
                line = "junk " + "é" * rng.randint(0, 400)
            elif kind < 0.4:
                line = f"memory read at 0x{rng.randrange(1 << 20):x}, instruction address = 0x1, data size = 1, data value = {rng.randrange(256):02x}"
            else:
                idx += 1
                line = f'[m 0x{idx:x}] 0x{4096 + idx:x}: "ldr x1, [x2]" x2=0x10 => x1=0x{idx:x}'
                blocks.append([])
            if idx >= 0:
                blocks[-1].append(line)
            for at in range(len(text), len(text) + len(line.encode()) + 1):
                owner[f, at] = idx
            text += line.encode() + b"\n"
        (folder / f"{f:03}.txt").write_bytes(text)
    return owner, blocks


@pytest.fixture
def short_splits(spark, monkeypatch):
    monkeypatch.setattr(logs, "PART_BITS", 9)
    monkeypatch.setattr(offsets, "PART_BITS", 9)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed", range(2))
def test_bytes_belong_to_instructions(spark, tmp_path, short_splits, seed):
    owner, blocks = random_log(tmp_path / "log", seed, 6, 25)
    trace = Trace.open(spark, str(tmp_path / "log"), str(tmp_path / "s"))
    assert [list(r.raw_lines) for r in trace.instruction.orderBy("idx").collect()] == blocks
    paths = {int(re.search(r"(\d+)\.txt", r.path)[1]): r.path for r in trace.file_part.select("path").distinct().collect()}
    ends = {f: max(at for g, at in owner if g == f) for f in paths}
    want = {(paths[f], at): i for (f, at), i in owner.items()}
    want |= {(paths[f], ends[f] + more): owner[f, ends[f]] for f in paths for more in (1, 5, 5000)}
    want |= {("elsewhere", 3): -1, (paths[min(paths)], -1): -1}
    asked = spark.createDataFrame([*want, *list(want)[:9], (None, 1), (paths[min(paths)], None)], "path string, at long")
    found = {(r.path, r.at): r.idx for r in trace.at_bytes(asked).collect()}
    assert found == {k: (v if v >= 0 else None) for k, v in want.items()} | {(None, 1): None, (paths[min(paths)], None): None}
    for place in random.Random(seed).sample(sorted(want), 6):
        row = trace.at_byte(place[1], place[0]).first()
        assert (row[0] if row else -1) == want[place]


def test_no_bytes_and_no_lines(spark, tmp_path):
    (tmp_path / "log.txt").write_text("")
    trace = Trace.open(spark, str(tmp_path / "log.txt"), str(tmp_path / "s"))
    assert trace.at_byte(0).first() is None and trace.at_bytes(spark.createDataFrame([("a", 1)], "path string, at long")).first().idx is None
    assert trace.at_bytes(spark.createDataFrame([], "path string, at long, idx int, part int")).count() == 0


def test_one_byte_reads_one_part(spark, tmp_path):
    spark.range(20_000).selectExpr("id AS idx", "id * 100 AS file_offset").coalesce(1).write.option("parquet.page.row.count.limit", 500).parquet(str(tmp_path / "i"))
    instruction = spark.read.parquet(str(tmp_path / "i"))
    parts = spark.range(2).selectExpr("'a' AS path", "id AS part", "id * 10486 - if(id > 0, 1, 0) AS first_idx", "if(id = 0, 10485, 19999) AS last_idx")
    found = offsets.instruction_at(instruction, parts, 123_456)
    assert found.first()[0] == 1234 and max(rows_scanned(found)) <= 2_000
