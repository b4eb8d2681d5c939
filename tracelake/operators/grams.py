"""An inverted index over the text of lines: which blocks of instructions hold which runs of GRAM characters.

A datum's own runs are looked up, and the blocks that hold the rarest of them all are candidates; lines are then
read in those blocks alone and looked through. Runs are of four characters, because of three hexadecimal digits
most blocks hold every run. A datum of fewer characters has no run, so it is sought in all lines.

A row of the index has a run's blocks among CHUNK of them; the task that reads the lines makes it, so that no row
for a run and block is shuffled or sorted. Where two tasks, or two batches of one, have a part of a chunk each, a run
has a row of each."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a run; instructions of a block; how many of a datum's runs are intersected.
GRAM, BLOCK, RAREST = 4, 64, 4
#: Blocks of a row of the index at most, two to this power; bytes of text that are cut up at once; runs by block that a task holds.
CHUNK_BITS, PIECE, HELD = 10, 1 << 20, 1 << 22

_INDEX = "gram string, block long, within array<int>"


def by_gram(instruction: DataFrame) -> DataFrame:
    """The table ``by_gram``: (gram, block, within), the places of the blocks that hold a run among the CHUNK from ``block``
    on. Runs don't cross the ends of lines."""
    return instruction.select(F.expr(f"idx div {BLOCK}").alias("block"), "raw_lines").mapInArrow(_indexed, _INDEX)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the index, chunk by chunk as lines come."""
    chunk, held, others = -1, [], set()
    for batch in batches:
        rows = np.asarray(pc.list_parent_indices(batch.column(1)))
        blocks, lines = batch.column(0).to_numpy()[rows], pc.list_flatten(batch.column(1)).cast(pa.large_binary())
        for of in np.unique(blocks >> CHUNK_BITS).tolist():
            if of != chunk or sum(map(len, held)) + len(others) > HELD:
                yield from _rows(chunk, held, others)
                chunk, held, others = of, [], set()
            mine = np.flatnonzero(blocks >> CHUNK_BITS == of)
            _cut_up(lines.take(pa.array(mine)), blocks[mine] - (of << CHUNK_BITS), held, others)
    yield from _rows(chunk, held, others)


def _cut_up(lines: pa.Array, within: np.ndarray, held: list[np.ndarray], others: set[tuple[str, int]]) -> None:
    """Adds the runs of lines: to ``held`` as numbers of four bytes and a block's place, each once, or as text to
    ``others`` if they aren't ASCII."""
    _, offsets, data = lines.buffers()
    begin = np.frombuffer(offsets, np.int64)[lines.offset : lines.offset + len(lines) + 1]
    first = 0
    while first < len(lines):
        last = max(first + 1, int(np.searchsorted(begin, begin[first] + PIECE, "right")) - 1)
        text = np.frombuffer(data, np.uint8)[begin[first] : begin[last]] if data is not None else np.empty(0, np.uint8)
        starts, ends = begin[first:last] - begin[first], begin[first + 1 : last + 1] - begin[first]
        runs, wide = np.ones(len(text), bool), np.flatnonzero(text >= 128)
        # A run that begins so near a line's end would cross it; one that is so near a byte beyond ASCII would hold it.
        for at in [ends - back for back in range(1, GRAM)] + [wide - back for back in range(GRAM)]:
            runs[at[at >= 0]] = False
        for i in np.unique(np.searchsorted(ends, wide, "right")).tolist():
            # Bytes that aren't UTF-8 are in no datum, so neither is a run with one.
            line = text[starts[i] : ends[i]].tobytes().decode("utf-8", "surrogateescape")
            others.update((run, int(within[first + i])) for run in runs_of(line) if not run.isascii() and not any("\ud800" <= c <= "\udfff" for c in run))
        if len(text) >= GRAM:
            n = len(text) - GRAM + 1
            number = text[:n].astype(np.uint64)
            for j in range(1, GRAM):
                number = number << np.uint64(8) | text[j : n + j]
            keys = (number << np.uint64(CHUNK_BITS) | np.repeat(within[first:last].astype(np.uint64), ends - starts)[:n])[runs[:n]]
            held.append(_once(keys))
        first = last


def _once(keys: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _rows(chunk: int, held: list[np.ndarray], others: set[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    def batch(gram: pa.Array, starts: np.ndarray, within: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(within)), pa.int32()), pa.array(within, pa.int32()))
        return pa.RecordBatch.from_arrays([gram, pa.array(np.full(len(starts), chunk << CHUNK_BITS), pa.int64()), lists], ["gram", "block", "within"])

    keys = _once(np.concatenate(held)) if held else np.empty(0, np.uint64)
    if len(keys):
        number = (keys >> np.uint64(CHUNK_BITS)).astype(">u4")
        starts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        text = pa.py_buffer(number[starts].tobytes())
        gram = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.arange(0, GRAM * len(starts) + 1, GRAM, dtype=np.int32)), text)
        yield batch(gram, starts, (keys & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.int32))
    if others:
        pairs = sorted(others)
        starts = np.array([i for i, (run, _) in enumerate(pairs) if not i or pairs[i - 1][0] != run])
        yield batch(pa.array([pairs[i][0] for i in starts], pa.string()), starts, np.array([at for _, at in pairs], np.int32))


def gram_counts(by_gram: DataFrame) -> DataFrame:
    """The table ``gram``: in how many blocks each run occurs; a block that two tasks have read counts for each."""
    return by_gram.groupBy("gram").agg(F.sum(F.size("within")).alias("n"))


def runs_of(token: str) -> list[str]:
    """The distinct runs of a token."""
    return list(dict.fromkeys(token[i : i + GRAM] for i in range(len(token) - GRAM + 1)))


def blocks_with(by_gram: DataFrame, gram: DataFrame, token: str) -> DataFrame:
    """(block) of every block that may hold a token: those with the rarest of its runs."""
    runs = runs_of(token)
    counts = {r["gram"]: r["n"] for r in gram.where(F.col("gram").isin(runs)).collect()}  # a row for each run of the token
    if len(counts) < len(runs):
        return by_gram.select("block").limit(0)
    rarest = sorted(runs, key=lambda r: (counts[r], r))[:RAREST]
    found = by_gram.where(F.col("gram").isin(rarest)).select("gram", "block", F.explode("within").alias("at")).select("gram", (F.col("block") + F.col("at")).alias("block"))
    held = F.count_distinct("gram")  # as two tasks may have a part of one block
    return found.groupBy("block").agg(held.alias("n")).where(F.col("n") == len(rarest)).select("block")


def candidate_blocks(by_gram: DataFrame, gram: DataFrame, tokens: list[str]) -> DataFrame | None:
    """(block) of the blocks that may hold any of the tokens; None if one of them is too short to tell."""
    if not tokens or any(len(t) < GRAM for t in tokens):
        return None
    return reduce(DataFrame.unionByName, [blocks_with(by_gram, gram, t) for t in tokens]).distinct()
