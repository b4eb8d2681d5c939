"""Token counts without token ids.

A sentencepiece BPE never merges across the start of a run of blanks (no piece of the vocabulary
holds another character before a blank), so a text's count is the sum over its pre-tokens, each a run
of blanks and what follows it. One job lists the distinct pre-tokens of the corpus with their
frequencies and counts the pieces of each once. Those that occur most, a bounded number, are then
counted map-side; the others of each document meet their counts in a join, so that no pre-token is
hot in it.

Defined cases
- null or empty text: no bytes, no tokens. Null doc_id: kept. Repeated rows: a result each.
- Empty table: no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, materialise
from .tokenizers_cache import piece_model

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Distinct pre-tokens that are counted map-side: at most so many are sent to every executor.
HOT = 150_000
#: Distinct pre-tokens a task holds before it hands on their frequencies so far.
HELD = 300_000

_RUN = re.compile(" +[^ ]+| +$")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens, without the first blank of each (which the model adds to any text)."""
    text = text.replace("▁", " ")
    if "  " not in text and text[-1:] != " " and text[:1] != " ":
        return text.split(" ") if text else []
    return [run[1:] for run in _RUN.findall(" " + text)] if text else []


def frequencies(docs: DataFrame, split, held: int = HELD) -> DataFrame:
    """(token, n): how often each token that ``split`` finds occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(split(text))
            if len(seen) >= held:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["token", "n"])
                seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["token", "n"])

    return docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def hot_tokens(counted: DataFrame, most: int = HOT) -> DataFrame:
    """The rows of the most frequent tokens, ``most`` of them or fewer.

    Frequencies are told apart by eighths of powers of two only, so one small aggregate decides."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8)
    sizes = sorted(counted.groupBy(step.alias("step")).count().collect(), reverse=True)
    least, room = float("inf"), most
    for step_at, n in sizes:
        if n > room:
            break
        least, room = step_at, room - n
    return counted.where(step >= F.lit(least).cast("double"))


def piece_counts(counted: DataFrame, model: str = MODEL) -> DataFrame:
    """``counted`` (token, n) with ``pieces``: how many pieces the model makes of each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = piece_model(model)
        for batch in batches:
            tokens = batch.column(0).to_pylist()
            # An empty one is the blank alone, which is a piece.
            pieces = [len(ids) if token else 1 for token, ids in zip(tokens, sp.encode(tokens, num_threads=1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.int32())], ["token", "n", "pieces"])

    return counted.mapInArrow(run, "token string, n long, pieces int")


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of (doc_id, text)."""
    spark = in_small_batches(docs).sparkSession
    counts = materialise(piece_counts(frequencies(docs, pre_tokens), model), "pre-tokens")
    known = hot_tokens(counts, hot).select("token", "pieces").toPandas()
    sent = spark.sparkContext.broadcast(dict(zip(known["token"], known["pieces"].tolist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sent.value
        for batch in batches:
            n_bytes, sums, tokens, times = [], [], [], []
            for text in batch.column(2).to_pylist():
                text = text or ""
                n_bytes.append(len(text.encode()))
                total, rare, often = 0, [], []
                for token, n in Counter(pre_tokens(text)).items():
                    if (k := pieces.get(token)) is not None:
                        total += k * n
                    else:
                        rare.append(token)
                        often.append(n)
                sums.append(total)
                tokens.append(rare)
                times.append(often)
            cols = [batch.column(0), batch.column(1), pa.array(n_bytes, pa.int64()), pa.array(sums, pa.int64()), pa.array(tokens, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n_bytes", "hot", "tokens", "times"])

    # The row number tells repeated rows apart; it is drawn once, in the task that reads the text.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    per = rows.mapInArrow(run, "row long, doc_id long, n_bytes long, hot long, tokens array<string>, times array<long>")
    # A document's own columns travel with its first rare token, or alone if it has none.
    rare = per.select("row", "doc_id", "n_bytes", "hot", F.posexplode_outer(F.arrays_zip("tokens", "times")).alias("at", "rare"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    rare = rare.select("row", *[F.when(first, F.col(c)).alias(c) for c in ("doc_id", "n_bytes", "hot")], F.col("rare.tokens").alias("token"), F.col("rare.times").alias("times"))
    met = rare.join(counts.select("token", "pieces"), "token", "left")
    summed = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), (F.max("hot") + F.coalesce(F.sum(F.col("times") * F.col("pieces")), F.lit(0))).alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
