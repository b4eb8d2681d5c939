"""Fingerprints of documents as invertible Bloom lookup tables of their paragraphs.

A paragraph is a line, or a part of one: lines are also cut after words whose last letters hash to
zero, so that an edit changes the paragraphs around it and no others. The 64-bit digests of a text's
paragraphs (a repeated one has a digest for each time) go into a table of cells (count, sum of digests, sum of check values), each
into one cell of three parts. The tables of two versions subtract; cells left with one digest give it
away, which frees others, until the digests of both sides are recovered or the peeling stalls, in
which case both tables are built again with four times the cells. The fingerprint is the table of
the smallest size together with the number of paragraphs.

Documents are cut into ranges of doc_id (then of the text's hash) once, each a partition of its own, so that a text
and its successor meet in one task. ``near_*`` of the result rest on tables of both whole sets, as many cells as peeling
needs; the fingerprints that are returned have the smallest size, which is enough for versions that differ little.

Defined cases
- null text: empty, no paragraphs; two empty texts are alike (1.0).
- Null doc_id: last in order. Equal doc_ids: in the order of their texts' hashes. Only rows that are equal in both
  can't be told apart, so they are one range's.
- One document: its own successor. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches
from .shingles import mix

#: Cells of the smallest table, in three parts; a stalled peeling gets WIDER times as many.
CELLS, WIDER = 24, 4
#: A line is cut after one in so many words, after each of a text's first words, and before it is LONGEST words long.
CUT, FIRST, LONGEST = 4, 8, 32
#: Bytes of text in one range of documents, about, and the corpus from which on ranges grow. The driver sees one row for
#: each of PIECES pieces of a range.
RANGE_BYTES, RANGES_GROW, PIECES = 16_000_000, 10**10, 4

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def paragraphs(text: str) -> np.ndarray:
    """The digests of a text's paragraphs; one that repeats has a digest for each time."""
    data = text.encode()
    if not data:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(b"\0" * 8 + data, np.uint8)
    at = np.flatnonzero(_SPACE[raw])
    # The eight bytes before each blank decide whether a part ends there; a line feed always ends one.
    tail = np.zeros(len(at), np.uint64)
    for back in range(1, 9):
        tail = (tail << np.uint64(8)) | raw[at - back]
    order = np.arange(1, len(at) + 1)
    cut = (raw[at] == 10) | (mix(tail) % np.uint64(CUT) == 0) | (order <= FIRST)
    since = order - np.maximum.accumulate(np.where(cut, order, 0))
    ends = at[cut | (since % LONGEST == LONGEST - 1)] - 7
    digest, start, out = xxhash.xxh3_64_intdigest, 0, []
    for end in [*ends.tolist(), len(data)]:
        if end > start:
            out.append(digest(data[start:end]))
        start = end
    kept = np.sort(np.array(out, np.uint64))
    new = np.concatenate(([True], kept[1:] != kept[:-1]))
    if not new.all():
        place = np.arange(len(kept))
        kept = mix(kept + (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64))
    else:
        kept = mix(kept)
    return kept


def places(digests: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each digest in each of the three parts, and its check value."""
    part = np.uint64(cells // 3)
    first = mix(digests)
    third = mix(first)
    where = np.stack((first % part, part + (first >> np.uint64(32)) % part, part + part + third % part)).astype(np.int64)
    return where, mix(third)


def tables(sets: list[np.ndarray], cells: int) -> np.ndarray:
    """Counts, sums of digests and sums of check values, as (3, sets, cells); cells is a multiple of 3."""
    out = np.zeros((3, len(sets) * cells), np.uint64)
    digests = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets]) * cells
    _add(out, digests, of, np.uint64(1), cells)
    return out.reshape(3, len(sets), cells)


def _add(flat: np.ndarray, digests: np.ndarray, of: np.ndarray, sign: np.ndarray | np.uint64, cells: int) -> None:
    """Adds digests, ``sign`` times each, to the tables that begin at ``of``."""
    where, check = places(digests, cells)
    for at in where + of:
        np.add.at(flat[0], at, sign)
        np.add.at(flat[1], at, digests * sign)
        np.add.at(flat[2], at, check * sign)


def peel(diff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What comes off the subtracted tables (3, pairs, cells), all pairs at once.

    Returns the pair, digest and side (1 or -1) of each digest recovered, and which pairs are
    recovered whole; those that are not need larger tables."""
    _, pairs, cells = diff.shape
    flat = diff.reshape(3, pairs * cells)
    plus, minus = np.uint64(1), np.uint64((1 << 64) - 1)
    found: list[tuple[np.ndarray, ...]] = []
    look = np.arange(pairs * cells)
    while True:
        lone = look[(flat[0][look] == plus) | (flat[0][look] == minus)]
        sign = flat[0][lone]
        keys, check, pair = flat[1][lone] * sign, flat[2][lone] * sign, lone // cells
        where, right = places(keys, cells)
        # A single digest fits its cell and its check value; one that is alone in several cells counts once.
        fits = (check == right) & (where == lone % cells).any(axis=0)
        keys, sign, pair, where = keys[fits], sign[fits], pair[fits], where[:, fits]
        order = np.lexsort((keys, pair))
        again = np.zeros(len(order), bool)
        again[1:] = (keys[order][1:] == keys[order][:-1]) & (pair[order][1:] == pair[order][:-1])
        take = order[~again]
        if not len(take):
            break
        keys, sign, pair = keys[take], sign[take], pair[take]
        found.append((pair, keys, sign))
        _add(flat, keys, pair * cells, np.uint64(0) - sign, cells)
        look = np.unique(where[:, take] + pair * cells)
    whole = ~diff.any(axis=(0, 2))
    join = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    return join[0], join[1], join[2].view(np.int64), whole


def differences(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS, diff: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of sets the digests in the left alone and in the right alone.

    ``diff``: the subtracted tables of the first size, if they are there. Pairs whose peeling stalls
    are tried again with tables of WIDER times as many cells."""
    out: list = [None] * len(left)
    todo = np.arange(len(left))
    gap = np.abs(np.array([len(a) for a in left], np.int64) - np.array([len(b) for b in right], np.int64))
    while len(todo):
        # Fewer cells than digests that differ cannot be peeled.
        tried = todo[gap[todo] <= cells]
        if diff is None:
            diff = tables([left[i] for i in tried], cells) - tables([right[i] for i in tried], cells)
        else:
            diff = diff[:, tried]
        pair, keys, side, whole = peel(diff)
        order = np.argsort(pair, kind="stable")
        pair, keys, side = pair[order], keys[order], side[order]
        ends = np.searchsorted(pair, np.arange(len(tried) + 1))
        for k in np.flatnonzero(whole).tolist():
            mine, of = keys[ends[k] : ends[k + 1]], side[ends[k] : ends[k + 1]]
            out[tried[k]] = (mine[of > 0], mine[of < 0])
        todo = np.array([i for i in todo.tolist() if out[i] is None], np.int64)
        cells, diff = cells * WIDER, None
    return out


def likeness(a: np.ndarray, b: np.ndarray, only: tuple[np.ndarray, np.ndarray]) -> float:
    """Shared paragraphs over all paragraphs of both, by the digests that peeling recovered."""
    n, differ = len(a) + len(b), len(only[0]) + len(only[1])
    return (n - differ) / (n + differ) if n else 1.0


def written(digests: np.ndarray, cells: np.ndarray) -> str:
    """A fingerprint as text: the number of paragraphs, then counts, sums and check sums of the cells, in hexadecimal."""
    return f"{len(digests):x}:{cells[0].astype('>u4').tobytes().hex()}:{cells[1].astype('>u8').tobytes().hex()}:{cells[2].astype('>u8').tobytes().hex()}"


def edited_text(text: str, after: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of ``after``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + after[:quarter]


def _size_of_ranges(total: int, range_bytes: int) -> int:
    """Bytes of one range: more in a larger corpus, so that the driver's list grows with its three quarters only."""
    return int(range_bytes * max(1.0, total / RANGES_GROW) ** 0.25)


def _range_starts(docs: DataFrame, range_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ranges of about ``range_bytes`` bytes of text begin: the (doc_id, key) of the first row of each that
    begins with a doc_id, in order, and the keys of those that begin without one.

    Rows are first cut into PIECES times as many pieces of equal numbers of rows; neighbouring pieces make up a
    range, so that long texts don't make one large."""
    total = docs.agg(F.sum("size")).first()[0] or 0
    range_bytes = _size_of_ranges(total, range_bytes)
    pieces = docs.select("none", "id", "key", "size").repartitionByRange(PIECES * (int(total // range_bytes) + 1), "none", "id", "key")
    found = pieces.groupBy(F.spark_partition_id().alias("at")).agg(F.min(F.struct("none", "id", "key")).alias("first"), F.sum("size").alias("size")).select("size", "first.*").toPandas()
    found = found.sort_values(["none", "id", "key"])
    # A piece begins a range where the bytes before it have passed another multiple of a range's.
    before = np.cumsum(found["size"].to_numpy(np.int64)) - found["size"].to_numpy(np.int64)
    found = found[np.diff(before // range_bytes, prepend=-1) > 0]
    none = found["none"].to_numpy(bool)
    return found[["id", "key"]].to_numpy(np.int64)[~none], found["key"].to_numpy(np.int64)[none]


def _place(ids: np.ndarray, none: np.ndarray, keys: np.ndarray, starts: np.ndarray, starts_without: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of each row and whether the row is (like) the first of it. ``none``: rows without a doc_id."""
    n = len(starts)
    low, high = np.searchsorted(starts[:, 0], ids, "left"), np.searchsorted(starts[:, 0], ids, "right")
    at = high - 1
    # Several ranges may begin with one doc_id; the keys tell them apart.
    for a in np.unique(low[(high > low) & ~none]).tolist():
        rows = np.flatnonzero((low == a) & (high > a) & ~none)
        at[rows] = a + np.searchsorted(starts[a : high[rows[0]], 1], keys[rows], "right") - 1
    at[none] = n + np.searchsorted(starts_without, keys[none], "right") - 1
    all_keys = np.concatenate((starts[:, 1], starts_without))
    same = np.where(none, at >= n, (at >= 0) & (at < n) & (low < high))
    first = same & (all_keys[np.maximum(at, 0)] == keys) if len(all_keys) else same
    return np.maximum(at, 0), first


def successive(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(range, last, doc_id, text) in partitions that each hold one whole range in order of doc_id, then of the text's
    hash; a range ends with rows of ``last``, the first of which is the first document of the next range."""
    docs = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # A missing id is 0 beside its mark, so that pandas doesn't turn ids into floating numbers.
    docs = docs.withColumns({"none": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0).cast("long")), "key": F.xxhash64("text"), "size": F.octet_length("text")})
    starts, starts_without = _range_starts(docs, range_bytes)
    n = max(1, len(starts) + len(starts_without))
    sent = docs.sparkSession.sparkContext.broadcast((starts, starts_without))

    @F.pandas_udf("long")
    def placed(none: pd.Series, ids: pd.Series, keys: pd.Series) -> pd.Series:
        """Twice the range, and one more for its first row."""
        at, first = _place(ids.to_numpy(np.int64), none.to_numpy(bool), keys.to_numpy(np.int64), *sent.value)
        return pd.Series(2 * at + first)

    rows = docs.withColumn("at", placed("none", "id", "key"))
    own = F.floor(F.col("at") / 2).cast("int")
    to = F.when(F.col("at") % 2 == 1, F.array(own, F.pmod(own - 1, F.lit(n)))).otherwise(F.array(own))
    rows = rows.select("doc_id", "key", "text", F.posexplode(to).alias("last", "range"))
    order = ["range", "last", F.col("doc_id").asc_nulls_last(), "key"]
    return rows.repartitionById(n, F.col("range")).sortWithinPartitions(*order).select("range", "last", "doc_id", "text")


def fingerprints(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, removed, added)
    for every row of (doc_id, text). ``removed`` and ``added`` count the paragraph digests that peeling
    recovers between a text and its edited text; ``differences`` gives the digests for any versions."""

    def rows(docs: list[tuple], pairs: list[tuple[int, int]]) -> list[tuple]:
        """Results of the first of each pair of documents (doc_id, text, digests), the second being its successor."""
        news = [edited_text(docs[i][1], docs[j][1]) for i, j in pairs]
        sets, edits = [d[2] for d in docs], [paragraphs(new) for new in news]
        own, other = tables(sets, cells), tables(edits, cells)
        first, second = [i for i, _ in pairs], [j for _, j in pairs]
        left = [sets[i] for i in first]
        to_edit = differences(left, edits, cells, own[:, first] - other)
        to_next = differences(left, [sets[j] for j in second], cells, own[:, first] - own[:, second])
        return [
            (docs[i][0], len(docs[i][1]), hashlib.sha256(news[k].encode()).hexdigest(), written(sets[i], own[:, i]), written(edits[k], other[:, k]))
            + (likeness(sets[i], edits[k], to_edit[k]), likeness(sets[i], sets[j], to_next[k]), len(to_edit[k][0]), len(to_edit[k][1]))
            for k, (i, j) in enumerate(pairs)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, closed, at = None, True, None
        for batch in batches:
            docs, pairs = [before] if before else [], []
            for part, last, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    at, before, closed = part, None, False
                if closed:
                    continue
                docs.append(here := (doc_id, text, paragraphs(text)))
                if before:
                    pairs.append((len(docs) - 2, len(docs) - 1))
                before, closed = here, last == 1
            out = rows(docs, pairs)
            before = None if closed else before
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "removed", "added"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, removed long, added long"
    return successive(docs).mapInArrow(run, schema)
