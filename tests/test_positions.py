"""State at many positions and slices of many roots, against their single versions and an ordered fold."""

import random

import pytest
from test_trace import folded, history

from tracelake.operators import lineage, state, tables
from tracelake.plans.trace import Trace
from tracelake.sources import logs
from tracelake.sources.files import saved


@pytest.mark.parametrize("seed", range(2))
def test_states_at_many_positions_equal_an_ordered_fold(spark, seed):
    rows = history(seed, 80)
    writes = tables.register_writes(spark.createDataFrame([(i, [(k, n, "", t)]) for i, k, n, t in rows], "idx long, register_changes array<struct<ordinal:int,register:string,old_value:string,new_value:string>>")).persist()
    marks = state.checkpoints(writes, 80, 7).persist()
    wanted = [0, 1, 6, 7, 8, 33, 34, 35, 79, 79, -1]
    positions = spark.createDataFrame([(i,) for i in wanted], "idx long")
    for given in ({}, {"checkpoints": marks, "interval": 7}):
        have = {}
        for r in state.states_at(writes, positions, chunk=5, **given).collect():
            assert have.setdefault(r.idx, {}).setdefault(r.register, r.value % 2**64) == r.value % 2**64
        assert have == {i: f for i in wanted if i >= 0 and (f := folded(rows, i))}


def test_states_read_only_the_spans_asked_for(spark, tmp_path):
    writes = spark.range(20_000).selectExpr("id AS idx", "0 AS ordinal", "concat('X', id % 3) AS state_reg", "false AS is_w", "id AS value")
    writes.coalesce(1).write.option("parquet.page.row.count.limit", 500).parquet(str(tmp_path / "w"))
    writes = spark.read.parquet(str(tmp_path / "w"))
    marks = state.checkpoints(writes, 20_000, 500).persist()
    found = state.states_at(writes, spark.createDataFrame([(700,), (12_345,)], "idx long"), marks, 500)
    assert {(r.idx, r.register): r.value for r in found.collect()} == {(i, f"X{k}"): max(v for v in range(i + 1) if v % 3 == k) for i in (700, 12_345) for k in range(3)}
    assert max(rows_scanned(found)) <= 3_000


def rows_scanned(df):
    """The rows that each file scan of a query gave out, by its executed plan."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def visit(node):
        if node.nodeName().startswith("Scan parquet"):
            out.append(node.metrics().apply("numOutputRows").value())
        for name in ("finalPhysicalPlan", "plan"):
            if node.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "ShuffleQueryStageExec", "BroadcastQueryStageExec") and any(m.getName() == name for m in node.getClass().getMethods()):
                visit(getattr(node, name)())
                return
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))

    visit(plan)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_many_slices_equal_single_ones(spark, monkeypatch, seed):
    r = random.Random(seed)
    ops = [(i, r.randrange(5), [r.randrange(5) for _ in range(r.randrange(3))]) for i in range(60)]
    line = lambda i, d, s: f'[m 0x1] 0x{i:x}: "add x{d}, {", ".join(f"x{x}" for x in s) or "#1"}" x{d}=0x0 => x{d}=0x1'
    lines = spark.createDataFrame([(i, i, 0, i, line(i, d, s)) for i, d, s in ops], "idx long, file_offset long, split int, at long, line string")
    trace = Trace.of(saved(logs.instructions(logs.classified(lines)), "instruction"))
    uses, writes = saved(trace.def_use, "def_use"), saved(trace.register_write, "register_write")
    monkeypatch.setattr(lineage, "TOGETHER", 2)
    roots = [(n, reg, idx) for n, (reg, idx) in enumerate([("X2", 40), ("w2", 40), ("X3", 59), ("X1", 12), ("X0", 0), ("XZR", 5), ("SP", 9), ("X2", 55)])]
    plain = lambda rows: sorted((x["index"], x.address, x.hit_writes, x.read_regs, x.taint_before, x.taint_after) for x in rows)
    for steps, window in ((4, 16), (100, 7)):
        have = lineage.taint_slices(trace.instruction, writes, uses, spark.createDataFrame(roots, "root long, register string, idx long"), steps, window).collect()
        for n, reg, idx in roots:
            assert plain([x for x in have if x.root == n]) == plain(lineage.taint_slice(trace.instruction, writes, uses, reg, idx, steps).collect())
    assert lineage.taint_slices(trace.instruction, writes, uses, spark.createDataFrame([], "root long, register string, idx long")).count() == 0
