"""Running values over long ordered sequences, without a task that holds a whole sequence.

Positions are cut into chunks of equal width. Inside a chunk a window carries values on; one row for
each key and chunk carries them over chunk borders. A key with most of the rows is thereby split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of one chunk.
CHUNK = 1 << 20


def carried_last(rows: DataFrame, keys: list[str], position: str, order: list[str], cols: dict[str, Column], inclusive: bool = True, chunk: int = CHUNK) -> DataFrame:
    """``rows`` with each of ``cols``: the last value that isn't null among the rows of the same keys up to
    this one (before it, if not ``inclusive``). ``order`` begins with the whole number ``position``."""
    rows = rows.withColumn("_chunk", F.expr(f"{position} div {chunk}")).withColumns({f"_{n}": c for n, c in cols.items()})
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    place = F.struct(*[F.col(o) for o in order])
    tops = rows.groupBy(*keys, "_chunk").agg(*[F.max_by(F.col(f"_{n}"), F.when(F.col(f"_{n}").isNotNull(), place)).alias(f"_{n}") for n in cols])
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_c"), *[F.last(f"_{n}", ignorenulls=True).over(earlier).alias(f"_top_{n}") for n in cols])
    rows = rows.withColumns({f"_in_{n}": F.last(f"_{n}", ignorenulls=True).over(inside) for n in cols})
    same = F.col("_chunk") == F.col("_c")
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(tops[f"_k{i}"])
    joined = rows.join(tops, same, "left").withColumns({n: F.coalesce(f"_in_{n}", f"_top_{n}") for n in cols})
    return joined.drop("_chunk", "_c", *[f"_k{i}" for i in range(len(keys))], *[f"{p}{n}" for n in cols for p in ("_", "_in_", "_top_")])
