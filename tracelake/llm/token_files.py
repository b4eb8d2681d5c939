"""Token ids in binary files of fixed-width packed bits.

Every id takes as many bits as the largest id of the vocabulary needs. Ids are packed in blocks of
BLOCK_IDS, each of whole bytes; a file lists where its blocks and its documents begin, so that any ids
are found without reading those before them, and many are unpacked at once by numpy shifts.

Documents are dealt to ranges of doc_id (then of the text's hash, then of the row's number, so that equal
rows can be split), sorted, and tokenised where they are packed: one shuffle, of texts. A range is cut into
files of about FILE_IDS ids at ends of documents. Spark writes and commits the files, one row each, so a
task that is repeated leaves no part of a file behind. A file's own header says where it comes in the whole;
places in the whole follow from sums over files, by two levels of windows.

A file, all numbers little-endian: MAGIC; seven numbers of 64 bits (bits of an id, ids of a block, ids,
documents, blocks, range, place in the range); the documents' ids (signed, 64 bits), whether each has one (a
byte), where each begins and where the last ends (64 bits, in ids); where each block begins and the last ends
(64 bits, in bytes of what follows); the blocks; a line feed, which Spark's writer adds.

Defined cases
- null or empty text: the end id alone. Null doc_id: kept, before all others. Repeated rows: each its own.
- Ties of doc_id: by the text's hash, so equal tables give equal files whatever their order (but for rows that are equal in both).
- A text may be of any length that a row can hold; a file holds whole documents, so one may be larger than the rest.
- Empty table: no documents; reading gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_small_batches, materialise
from .tokenizers_cache import byte_bpe, byte_ranks

MAGIC = b"IDSBITS1"
#: Ids of one block; ids of one file, about; bytes of text in one range, about; ranges that are summed together.
BLOCK_IDS, FILE_IDS, RANGE_BYTES, SUMMED = 4096, 1 << 22, 64 << 20, 1024
_HEAD, _HEAD_SIZE = "<8s7Q", struct.calcsize("<8s7Q")
_READ = "path string, part long, seq long, n_ids long, n_docs long"


def bits_for(vocabulary_size: int) -> int:
    """The bits that the largest id of a vocabulary needs."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids of ``width`` bits (32 at most), lowest bit first, filled up to a whole byte."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :width], bitorder="little").tobytes()


def take_bits(data: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """The ids at any places ``at`` of packed bytes."""
    if width in (8, 16, 32):
        return data[: len(data) // (width // 8) * (width // 8)].view(f"<u{width // 8}")[at].astype(np.uint32)
    bit = at.astype(np.int64) * width
    byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
    # An id lies in five bytes at most; those behind the end hold none of it.
    found = np.zeros(len(bit), np.uint64)
    for k in range(5):
        found |= data[np.minimum(byte + k, len(data) - 1)].astype(np.uint64) << np.uint64(8 * k)
    return ((found >> shift) & np.uint64((1 << width) - 1)).astype(np.uint32)


class TokenFile:
    """One file, as bytes or a memory map: ids at any place, documents by number."""

    def __init__(self, data):
        self.data = np.frombuffer(data, np.uint8) if isinstance(data, (bytes, bytearray, memoryview, pa.Buffer)) else data
        magic, self.width, self.block_ids, self.n_ids, self.n_docs, n_blocks, self.part, self.seq = struct.unpack(_HEAD, self.data[:_HEAD_SIZE].tobytes())
        if magic != MAGIC:
            raise ValueError("not a file of packed token ids")
        at = _HEAD_SIZE
        sizes = (("doc_ids", "<i8", self.n_docs), ("has_id", "u1", self.n_docs), ("starts", "<u8", self.n_docs + 1), ("blocks", "<u8", n_blocks + 1))
        for name, kind, n in sizes:
            size = n * np.dtype(kind).itemsize
            setattr(self, name, np.frombuffer(self.data[at : at + size].tobytes(), kind))
            at += size
        self.body = self.data[at : at + int(self.blocks[-1])]

    def ids(self, first: int, n: int) -> np.ndarray:
        """``n`` ids from the place ``first`` on; reads only the blocks that hold them."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        low, high = first // self.block_ids, (first + n - 1) // self.block_ids
        begin, end = int(self.blocks[low]), int(self.blocks[high + 1])
        # All blocks but the last are full, and a full one ends with a whole byte: places go on across blocks.
        return take_bits(self.body[begin:end], self.width, np.arange(first, first + n) - low * self.block_ids)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, in one go."""
        return take_bits(self.body, self.width, np.asarray(places, np.int64))

    def document(self, number: int) -> np.ndarray:
        return self.ids(int(self.starts[number]), int(self.starts[number + 1] - self.starts[number]))


class _Packer:
    """Gathers documents of one file; full blocks are packed as they fill."""

    def __init__(self, width: int):
        self.width, self.doc_ids, self.starts, self.blocks, self.waiting, self.held, self.n_ids = width, [], [0], [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 16 * BLOCK_IDS:
            self._flush(self.held - self.held % BLOCK_IDS)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        self.blocks += [pack_bits(ids[k : min(k + BLOCK_IDS, n)], self.width) for k in range(0, n, BLOCK_IDS)]
        self.waiting, self.held = [ids[n:]], self.held - n

    def file(self, part: int, seq: int) -> bytes:
        self._flush(self.held)
        n = len(self.doc_ids)
        ends = np.cumsum([0, *map(len, self.blocks)]).astype("<u8")
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        head = struct.pack(_HEAD, MAGIC, self.width, BLOCK_IDS, self.n_ids, n, len(self.blocks), part, seq)
        return b"".join((head, np.array([d or 0 for d in self.doc_ids], "<i8").tobytes(), known.tobytes(), np.array(self.starts, "<u8").tobytes(), ends.tobytes(), *self.blocks))


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = "byte_bpe_50k", end_id: int = 0, file_ids: int = FILE_IDS, range_bytes: int = RANGE_BYTES) -> None:
    """Writes the ids of all documents of (doc_id, text), each followed by ``end_id``, in ascending order of doc_id."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "key", "row"]
    rows = rows.repartitionByRange(int(total // range_bytes) + 1, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = byte_bpe(vocabulary), bits_for(max(len(byte_ranks(vocabulary)), end_id) + 1)
        end, part, seq, packer = np.array([end_id], np.uint32), TaskContext.get().partitionId(), 0, _Packer(width)
        file = lambda: pa.RecordBatch.from_arrays([pa.array([packer.file(part, seq)], pa.binary())], ["content"])
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc, np.concatenate((encode(text or "").astype(np.uint32, copy=False), end)))
                if packer.n_ids >= file_ids:
                    yield file()
                    packer, seq = _Packer(width), seq + 1
        if packer.doc_ids:
            yield file()

    # Spark's text writer writes the bytes as they are, and a line feed; each row is a file of its own.
    rows.mapInArrow(run, "content binary").select(F.col("content").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(folder)


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths)
    return in_small_batches(files.select("path", "content").where("length > 0"))


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """(path, part, seq, n_ids, n_docs, first): every file and the place of its first id in the whole.

    Written, so that files are not read again for it. It has one row for some millions of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [struct.unpack(_HEAD, x.as_buffer().slice(0, _HEAD_SIZE).to_pybytes()) for x in batch.column(1)]
            cols = [batch.column(0), *(pa.array([f[k] for f in found], pa.int64()) for k in (6, 7, 3, 4))]
            yield pa.RecordBatch.from_arrays(cols, ["path", "part", "seq", "n_ids", "n_docs"])

    return materialise(placed_files(materialise(_files(spark, folder).mapInArrow(run, _READ), "token-heads")), "token-index")


def placed_files(heads: DataFrame) -> DataFrame:
    """``heads`` (part, seq, n_ids, ...) with ``first``: the ids of all files before each."""
    wide = heads.withColumn("_wide", F.expr(f"part div {SUMMED}"))
    upto = lambda keys, by: Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = wide.groupBy("_wide").agg(F.sum("n_ids").alias("_all"))
    sums = sums.select(F.col("_wide").alias("_w"), F.coalesce(F.sum("_all").over(Window.orderBy("_wide").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_top"))
    inner = wide.withColumn("_in", F.coalesce(F.sum("n_ids").over(upto(["_wide"], ["part", "seq"])), F.lit(0)))
    return inner.join(sums, F.col("_wide") == F.col("_w")).withColumn("first", F.col("_top") + F.col("_in")).drop("_wide", "_w", "_in", "_top")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: ``start`` counts the ids of all
    documents before it, ``ids_crc32`` is of its ids as unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = TokenFile(content.as_buffer())
                ids, starts = file.ids(0, file.n_ids).astype("<u4"), file.starts.astype(np.int64)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                n = file.n_docs
                cols = [pa.array(np.full(n, x), pa.int64()) for x in (file.part, file.seq)]
                cols += [pa.array(file.doc_ids.astype(np.int64), pa.int64(), mask=file.has_id == 0), *(pa.array(x, pa.int64()) for x in (starts[:-1], np.diff(starts), np.array(crc, np.int64)))]
                yield pa.RecordBatch.from_arrays(cols, ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    read = _files(spark, folder).select("content").mapInArrow(run, "part long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    read = materialise(read, "token-documents")
    first = placed_files(read.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n_ids"))).select("part", "seq", "first")
    return read.join(first, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, index: DataFrame, first: int, n: int) -> DataFrame:
    """(at, ids): the ids at places ``first`` to ``first + n`` of the whole, by file. Only the files that hold some
    of them are opened, and only the blocks that do are unpacked. ``index``: from ``token_index``."""
    wanted = index.where((F.col("first") < first + n) & (F.col("first") + F.col("n_ids") > first)).select("path", "first").collect()
    schema = "at long, ids array<int>"
    if not wanted or n <= 0:
        return spark.createDataFrame([], schema)
    begins = {r["path"]: r["first"] for r in wanted}  # files of one read, which the caller has bounded by n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file, base = TokenFile(content.as_buffer()), begins[path]
                low, high = max(first, base), min(first + n, base + file.n_ids)
                yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([file.ids(low - base, high - low).astype(np.int32)], pa.list_(pa.int32()))], ["at", "ids"])

    return _files(spark, list(begins)).mapInArrow(run, schema)
