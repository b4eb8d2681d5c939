"""Best-fit decreasing packing of tokenised documents into sequences of a fixed length.

Documents are tokenised once, in Arrow batches. Pieces are then dealt at random into groups of a
bounded number of pieces, and each group is packed by itself: longest piece first, each into the
tightest sequence that still has room, which a segment tree over remaining capacities finds in
logarithmic time. A group wastes about one sequence, so the loss is below one in ten thousand.

Defined cases
- null or empty text: the end token alone. Null doc_id: kept; its pieces carry the null.
- Repeated rows are separate documents. Very long texts are cut; no text is shortened.
- Empty table: no rows. Columns other than doc_id and text are not read; ``pack`` passes those of its pieces on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, materialise
from .tokenizers_cache import byte_bpe

SEQUENCE = 1024
END_ID = 2
#: Pieces that one task packs; bounds its memory and time. Fewer where they carry their ids.
GROUP_PIECES, GROUP_WITH_IDS = 50_000, 10_000


def token_pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k", length: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's tokens and end token.

    A document longer than ``length`` is cut so that all pieces but the first are full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(vocabulary)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            names = ("doc", "piece", "start", "length", "crc", "ids")
            out: dict[str, list] = {n: [] for n in names}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate((encode(text or ""), end)).astype("<u4", copy=False)
                first = len(ids) % length or length
                for k, stop in enumerate(range(first, len(ids) + 1, length)):
                    start = max(0, stop - length) if k else 0
                    for n, v in zip(names, (doc, k, start, stop - start, zlib.crc32(part := ids[start:stop])), strict=False):
                        out[n].append(v)
                    if keep_ids:
                        out["ids"].append(part.astype(np.int32))
            cols = [pa.array(out["doc"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[n], pa.int64()) for n in ("start", "length", "crc"))]
            cols += [pa.array(out["ids"], pa.list_(pa.int32()))] if keep_ids else []
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


class CapacityTree:
    """A segment tree over remaining capacities 0..size: how many open sequences have each."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        at = self.leaves + capacity
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes the open sequence of the smallest capacity of at least ``need``: (capacity, sequence)."""
        at = self.leaves + need
        if not self.count[at]:
            # Up to the first ancestor with something to the right, then down to its leftmost leaf.
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        while at:
            self.count[at] -= 1
            at >>= 1
        return capacity, self.open[capacity].pop()


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, by best-fit decreasing."""
    tree, sequences = CapacityTree(size), 0
    at, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if found := tree.take(need) if need < size else None:
            capacity, at[i] = found
        else:
            capacity, at[i] = size, sequences
            sequences += 1
        offset[i] = size - capacity
        if capacity > need:
            tree.add(capacity - need, int(at[i]))
    return at, offset


def pack(pieces: DataFrame, length: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (with ``length``) and where each one goes: ``sequence_id`` and ``offset``."""
    total = pieces.count()
    groups = max(1, -(-total // group_pieces))
    # Plain names, because grouped Arrow functions don't take every one.
    plain = {c: f"c{i}" for i, c in enumerate(pieces.columns)}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.drop_columns(["in_group"]).sort_by([(plain[c], "ascending") for c in ("ids_crc32", "doc_id", "piece")])
        at, offset = best_fit(table[plain["length"]].to_numpy(), length)
        return table.append_column("sequence_id", pa.array(at * groups + key[0].as_py())).append_column("offset", pa.array(offset))

    rows = pieces.toDF(*plain.values())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", sequence_id long, offset long"
    # Not by length or source: every group then has about the same mix of lengths. The row's number tells equal rows apart.
    group = F.pmod(F.xxhash64(*[plain[c] for c in ("doc_id", "piece", "ids_crc32")], F.monotonically_increasing_id()), F.lit(groups))
    packed = rows.withColumn("in_group", group).groupBy("in_group").applyInArrow(run, schema)
    return packed.toDF(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k", length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Where each piece of each document goes: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    The tokens are written once without their ids; ``packed_sequences`` gives the sequences themselves."""
    return pack(materialise(token_pieces(docs, vocabulary, length, end_id, keep_ids=False), "pieces"), length)


def packed_sequences(docs: DataFrame, vocabulary: str = "byte_bpe_50k", length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids, doc_ids, starts): the sequences that training reads."""
    return fill_sequences(pack(materialise(token_pieces(docs, vocabulary, length, end_id), "pieces"), length, GROUP_WITH_IDS))


def fill_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, starts): whole sequences, from ``pack`` over ``token_pieces`` with ids.

    A sequence is as long as ``length`` at most, so its group is bounded."""
    row = F.struct("offset", "doc_id", "ids")
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return rows.select(
        "sequence_id",
        F.flatten(F.transform("rows", lambda r: r["ids"])).alias("ids"),
        F.transform("rows", lambda r: r["doc_id"]).alias("doc_ids"),
        F.transform("rows", lambda r: r["offset"]).alias("starts"),
    )
