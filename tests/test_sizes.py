"""What grows with a trace is dealt out, and nothing that grows with it is sent to every executor."""

from pyspark.sql import functions as F

from tracelake.operators import offsets
from tracelake.plans.trace import Trace
from tracelake.sources import logs, store


def rows_out(df, kind):
    """The rows that each node of a kind gave out, by a query's executed plan."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def visit(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return visit(node.finalPhysicalPlan())
        if name in ("ShuffleQueryStageExec", "BroadcastQueryStageExec"):
            return visit(node.plan())
        if node.nodeName().startswith(kind):
            out.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            visit(node.children().apply(i))

    visit(plan)
    return out


def test_parts_of_files_make_no_row_for_each_instruction(spark, tmp_path):
    spark.range(20_000).selectExpr("id AS idx", "id * 100 AS file_offset").write.parquet(str(tmp_path / "i"))
    instruction = spark.read.parquet(str(tmp_path / "i"))
    parts = spark.range(2).selectExpr("'a' AS path", "id AS part", "id * 10486 - if(id > 0, 1, 0) AS first_idx", "if(id = 0, 10485, 19999) AS last_idx")
    asked = spark.range(0, 2_000_000, 7).selectExpr("'a' AS path", "id AS at")
    found = offsets.instructions_at(instruction, parts, asked)
    assert found.where("idx != at div 100").count() == 0 and found.count() == asked.count()
    assert (made := rows_out(found, "Generate")) and sum(made) <= 10


def test_tasks_of_a_store_do_not_grow_with_the_log(spark, tmp_path, monkeypatch):
    rows = "".join(f'[m 0x{i:x}] 0x{4096 + i:x}: "ldr x1, [x2]" x2=0x10 => x1=0x{i:x}\nmemory read at 0x10, instruction address = 0x1, data size = 1, data value = 0{i % 9}\n' for i in range(4_000))
    (tmp_path / "log.txt").write_text(rows)
    monkeypatch.setattr(logs, "RUN_BITS", 6)
    monkeypatch.setattr(logs, "MOST_ROWS", 200)
    monkeypatch.setattr(store, "MOST_ROWS", 200)
    trace = Trace.open(spark, str(tmp_path / "log.txt"), str(tmp_path / "s"))
    ends = [0]
    for pair in zip(*[iter(rows.splitlines(keepends=True))] * 2, strict=True):
        ends.append(ends[-1] + sum(map(len, pair)))
    have = trace.instruction.orderBy("idx").collect()
    assert [(r.idx, r.file_offset, len(r.raw_lines), r.memory_ops[0].data_value) for r in have] == [(i, ends[i], 2, f"0{i % 9}") for i in range(4_000)]
    for table in (trace.instruction, trace.def_use, trace.memory_access, trace.register_write):
        assert max(r[0] for r in table.groupBy(F.col("_metadata.file_path")).count().select("count").collect()) <= 400
    again, sp = logs.read_trace(spark, str(tmp_path / "log.txt"), str(tmp_path / "lines"))
    assert sorted(map(tuple, again.select("idx", "file_offset", "raw_line").collect())) == [(r.idx, r.file_offset, r.raw_line) for r in have]
    assert logs.placed(logs.parsed(spark, str(tmp_path / "log.txt")), 50).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 800
