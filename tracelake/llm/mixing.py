"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the keys are cut into equal ranges; sums of
sizes over the ranges, and prefix sums over those, locate the range in which the source's budget
ends, and a prefix sum inside that range alone finds the key at which to cut. What remains is one
small row per source, so the texts themselves are never shuffled.

Defined cases
- null text: size 0, taken 0. Null source: a source of its own, ordered last.
- Repeated rows and other rows with equal keys share what is left at the cut evenly (rounded down).
- Empty table: no rows. Extra columns pass through ``mix_documents``, whatever their names;
  ``mix_sizes`` doesn't read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, hash_key, key_block, materialise, named, word_count

#: Rows of one key range, and ranges of one range of ranges.
BLOCK_ROWS = 4096
#: No document is used more often than this.
MAX_EPOCHS = 3
#: Weights, dealt to the sources in order.
WEIGHTS = (1, 2, 3)
SEED = "mix-1"


def _ranked(sources: DataFrame) -> DataFrame:
    """``rank`` from 0 by source, nulls last, without gathering the sources in one task."""
    dealt = materialise(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()),
        "mix-sources",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").agg(F.count("*").alias("here")).select("part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return dealt.withColumn("at", F.row_number().over(inside) - 1).join(starts, "part").withColumn("rank", F.col("first") + F.col("at")).drop("part", "first", "at")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, n, source_size, target) from rows of (source, size).

    Targets share all words by weight; one above ``max_epochs`` times its source is lowered to that
    and the rest is shared again, until none is above. Each round moves three sums to the driver."""
    per = _ranked(sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    per = materialise(per.withColumn("weight", weight).withColumn("most", F.col("source_size") * max_epochs), "mix-weights")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    # Multiplied out in doubles as (total - held) / weight * w, with exact integers below.
    level, held = 0.0, None
    while True:
        capped = F.lit(False) if held is None else F.col("weight") * F.lit(level) > F.col("most")
        row = per.agg(
            F.sum(F.when(capped, F.col("most")).otherwise(0)).alias("held"),
            F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("weight"),
            F.sum(F.when(capped, 1).otherwise(0)).alias("n"),
        ).first()
        if row["n"] == held or not row["weight"]:
            if not row["weight"]:
                level = float("inf")
            break
        held, level = row["n"], (total - row["held"]) / row["weight"]
    target = F.when(F.col("weight") * F.lit(level) > F.col("most"), F.col("most").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return per.select("source", "n", "source_size", target.alias("target"))


def _before(blocks: DataFrame) -> DataFrame:
    """``before``: the sum of ``total`` over the source's earlier blocks, by two levels of windows."""
    wide = blocks.withColumn("wide", F.floor(F.col("block") / BLOCK_ROWS))
    earlier = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    tops = wide.groupBy("source", "wide").agg(F.sum("total").alias("all")).withColumn("top", F.coalesce(F.sum("all").over(earlier("source", by="wide")), F.lit(0))).drop("all")
    inner = wide.withColumn("inner", F.coalesce(F.sum("total").over(earlier("source", "wide", by="block")), F.lit(0)))
    same = inner["source"].eqNullSafe(tops["source"]) & (inner["wide"] == tops["wide"])
    return inner.join(tops, same).select(inner["source"], "block", "total", (F.col("top") + F.col("inner")).alias("before"))


def mix_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: (source, source_size, target, epochs, cut_key, cut_words).

    ``sizes`` has (source, size, key). A document is taken ``epochs`` times whole; once more if its
    key is below ``cut_key``; and at that key ``cut_words`` more of its words are taken."""
    targets = source_targets(sizes, weights, max_epochs)
    budget = F.floor("target").cast("long")
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as long) div source_size")).otherwise(F.lit(0)).cast("long"))
    targets = materialise(targets.withColumn("rest", budget - F.col("epochs") * F.col("source_size")).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS)), "mix-targets")
    of = targets.select(F.col("source").alias("s"), "blocks", "rest")
    dealt = sizes.join(of, sizes["source"].eqNullSafe(of["s"])).withColumn("block", key_block(F.col("key"), F.col("blocks")))
    sums = _before(dealt.groupBy("source", "block").agg(F.sum("size").alias("total")))
    found = sums.join(of, sums["source"].eqNullSafe(of["s"])).where("before <= rest and rest < before + total").select("s", F.col("block").alias("b"), "before")
    at = dealt.drop("s").join(found, dealt["source"].eqNullSafe(found["s"]) & (F.col("block") == F.col("b")))
    keys = at.groupBy("source", "key", "before", "rest").agg(F.sum("size").alias("total"), F.count("*").alias("same"))
    upto = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("start", F.col("before") + F.coalesce(F.sum("total").over(upto), F.lit(0)))
    cut = keys.where("start <= rest and rest < start + total").select(F.col("source").alias("s"), F.col("key").alias("cut_key"), F.expr("(rest - start) div same").alias("cut_words"))
    joined = targets.join(cut, targets["source"].eqNullSafe(cut["s"]), "left")
    # No cut: nothing is left over, which is a cut below all keys.
    return materialise(joined.select("source", "source_size", "target", "epochs", F.coalesce("cut_key", F.lit(-1)).alias("cut_key"), F.coalesce("cut_words", F.lit(0)).alias("cut_words")), "mix-plan")


def taken_words(size: Column, key: Column) -> Column:
    """Words taken of a document, given its source's columns of ``mix_plan``."""
    more = F.when(key < F.col("cut_key"), size).when(key == F.col("cut_key"), F.least(size, F.col("cut_words"))).otherwise(0)
    return (F.col("epochs") * size + more).cast("long")


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of (doc_id, text, source)."""
    key = hash_key(F.lit(seed), F.col("doc_id"), F.col("text"))
    sizes = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key")), "mix-sizes")
    plan = mix_plan(sizes.select("source", "size", "key"), weights, max_epochs).withColumnRenamed("source", "s")
    joined = sizes.join(plan, sizes["source"].eqNullSafe(plan["s"]))
    return joined.select("doc_id", "size", "source_size", "target", taken_words(F.col("size"), F.col("key")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.

    Documents stay whole: the one at a source's cut is taken once more if at least half of it is within the
    budget. So a source misses its target by half of that document at most (or of the rows that share its key)."""
    size_of, key_of, plan_of, take = fresh(docs, "size", "key", "plan", "take")
    rows = docs.withColumn(size_of, word_count(F.col("text"))).withColumn(key_of, hash_key(F.lit(seed), F.col("doc_id"), F.col("text")))
    sizes = materialise(rows.select("source", named(size_of).alias("size"), named(key_of).alias("key")), "mix-sizes")
    plan = mix_plan(sizes, weights, max_epochs)
    rows = rows.join(plan.select(F.struct("*").alias(plan_of)), named("source").eqNullSafe(F.col(plan_of)["source"]))
    size, key, of = named(size_of), named(key_of), F.col(plan_of)
    more = (key < of["cut_key"]) | ((key == of["cut_key"]) & (2 * of["cut_words"] >= size))
    times = F.when(size > 0, of["epochs"] + more.cast("int")).otherwise(0)
    return rows.withColumn(take, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*map(named, docs.columns))
