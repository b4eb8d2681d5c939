"""Alignment of two tokenizers on the same texts: an event sweep.

Tokenizer A is a byte-level BPE and gets a blank and the text; B is a sentencepiece BPE, which adds that blank
itself. Both cut the same bytes, so every token is an event: the byte at which it ends. A pre-token of B is encoded
once in a task and then looked up, for B never merges across the start of a run of blanks. The events of both sides
are one table, in which a row holds the ids of one side that end in one window of bytes; an id gives its token's
length, so ids and a window's first offset are events enough. The table is dealt out by document, sorted by offset
inside it, and streamed through a machine that is fed a batch of windows at a time. Its state is what one open
document needs: the open group's ids, running numbers, a running hash, and the links so far of the present run of windows.

Where both sides end together a group ends, and the two tokens that end there are linked. Links are counted
corpus-wide by pair of ids. The most frequent pairs, a bounded number, are then looked up in the tasks; the
others of each document meet their counts in a join, so that no pair is hot in it.

Defined cases
- null or empty text, or one whose bytes a side doesn't give back (as where it holds U+2581): no tokens, zeros, no hash.
- Null doc_id: kept. Repeated rows: a result each, and each counts. Very long texts: any number of windows; one
  document's are streamed in one task.
- Equal counts: all pairs of the highest count of a B id are best. Empty table: no rows.
- Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, materialise
from .token_counts import hot_tokens, pre_tokens
from .tokenizers_cache import byte_bpe, byte_ranks, piece_model

BYTE_MODEL, PIECE_MODEL = "byte_bpe_50k", "piece_bpe_32k.model"
#: Bytes of one window; pre-tokens that a task keeps the ids of; pairs of ids that are counted map-side.
WINDOW, HELD, HOT = 1 << 16, 300_000, 500_000
#: Ids that the machine is fed at once, about; links of one document that it holds before it hands them on.
FED, LINKS = 1 << 18, 1 << 18
_SWEPT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def piece_bytes(piece: str) -> bytes:
    """What a piece of B stands for: ``<0xHH>`` a byte, U+2581 a blank."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def token_lengths(byte_model: str, model: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of every token of A and of every piece of B."""
    ranks, sp = byte_ranks(byte_model), piece_model(model)
    a = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, at in ranks.items():
        a[at] = len(token)
    return a, np.array([len(piece_bytes(sp.id_to_piece(i))) for i in range(sp.get_piece_size())], np.int64)


class PieceIds(dict):
    """The ids of pre-tokens of B as bytes, encoded as they are asked for; ``bad`` are those whose pieces don't give
    their bytes back. Emptied when it holds too many."""

    def __init__(self, model: str, held: int = HELD):
        self.sp, self.held, self.bad = piece_model(model), held, set()
        self.bytes = [piece_bytes(self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size())]
        self.blank = [self.sp.piece_to_id("▁")]

    def __missing__(self, token: str) -> bytes:
        if len(self) >= self.held:
            self.clear()
        ids = self.sp.encode(token) if token else self.blank
        if b"".join(map(self.bytes.__getitem__, ids)) != b" " + token.encode():
            self.bad.add(token)
        self[token] = out = np.array(ids, "<u4").tobytes()
        return out

    def of(self, text: str) -> np.ndarray | None:
        """A text's ids, or None if they don't give it back."""
        if not text or "▁" in text:
            return None
        tokens = pre_tokens(text)
        ids = b"".join(map(self.__getitem__, tokens))
        return None if self.bad and not self.bad.isdisjoint(tokens) else np.frombuffer(ids, "<u4")


def events(docs: DataFrame, byte_model: str = BYTE_MODEL, model: str = PIECE_MODEL, window: int = WINDOW) -> DataFrame:
    """(row, doc_id, first, side, ids): the tokens of side 0 (A) or 1 (B) whose ends lie in the window of bytes that
    begins at ``first``, as unsigned numbers of 16 bits (32 where a vocabulary needs them). A document without tokens has one row without ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The strings of special tokens inside a text are plain text.
        encode, pieces, lengths = byte_bpe(byte_model, special=False), PieceIds(model), token_lengths(byte_model, model)
        kinds = [_kind(len(n)) for n in lengths]
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for row, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                b = pieces.of(text or "")
                # Tokens of A are bytes of the text by construction: they always give it back.
                both = [np.zeros(0, np.uint32)] if b is None else [encode(" " + text), b]
                for side, ids in enumerate(both):
                    at = (np.cumsum(lengths[side][ids]) - 1) // window
                    cuts = np.searchsorted(at, np.arange(1, int(at[-1]) + 1)).tolist() if len(at) and at[-1] else []
                    for k, (begin, end) in enumerate(zip([0, *cuts], [*cuts, len(ids)], strict=True)):
                        for column, value in zip(out, (row, doc, k * window, side, ids[begin:end].astype(kinds[side]).tobytes()), strict=True):
                            column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["row", "doc_id", "first", "side", "ids"])

    # The row's number tells repeated rows apart; both sides are drawn from it in one task.
    rows = in_small_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, first long, side int, ids binary")


def _kind(vocabulary_size: int) -> str:
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


class Sweep:
    """The machine: takes events in order of document and offset, gives each document's numbers.

    A batch's documents are one long run of bytes to it: their ends can't meet, as every document's last token
    ends on both sides. Only the last document of a batch may be open; what it needs is carried."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray], links: int = LINKS):
        self.lengths, self.ids_of_b, self.links = lengths, len(lengths[1]), links
        # Ids as text: an id of A before another or before B's; an id of B before another or before the next group.
        self.text = [f"{i}{mark}" for size, marks in ((len(lengths[0]), ",|"), (len(lengths[1]), ",;")) for mark in marks for i in range(size)]
        a, b = len(lengths[0]), len(lengths[1])
        self.base = ((0, a), (2 * a, 2 * a + b))
        self.open: dict | None = None

    def feed(self, rows: list[tuple]) -> list[tuple]:
        """``rows``: (row, doc_id, side, ids) in order. Returns what is done."""
        docs: list[dict] = [self.open] if self.open else []
        ids: tuple[list, list] = ([], [])
        if self.open:
            for side in (0, 1):
                ids[side].append(self.open["waiting"][side])
        for row, doc, side, more in rows:
            if not docs or docs[-1]["row"] != row:
                docs.append({"row": row, "doc_id": doc, "n": [0, 0], "groups": 0, "hash": None, "keys": np.zeros(0, np.int64), "times": np.zeros(0, np.int64), "more": []})
            docs[-1]["n"][side] += len(more)
            docs[-1]["more"].append((side, len(more)))
            ids[side].append(more)
        a, b = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in ids)
        # Where each document's ids end on each side, in this feed.
        held = [len(self.open["waiting"][s]) if self.open else 0 for s in (0, 1)]
        upto = np.array([[sum(n for s, n in d["more"] if s == side) for d in docs] for side in (0, 1)], np.int64).reshape(2, -1)
        if self.open:
            upto[:, 0] += held
        upto = upto.cumsum(axis=1)
        ends_a, ends_b = self._ends(a, upto[0], b, upto[1])
        at_a, at_b = _common(ends_a, ends_b)
        text, cut = self._groups(a, b, at_a, at_b)
        keys = a[at_a] * self.ids_of_b + b[at_b]
        # Groups of each document: those whose last token of A lies before its end.
        stop = np.searchsorted(at_a, upto[0]).tolist()
        begin, done = 0, []
        for k, d in enumerate(docs):
            end = stop[k]
            if end > begin:
                d["hash"] = d["hash"] or hashlib.sha256()
                part = text[cut[begin] : cut[end]]
                # A group's mark stands behind it; the last one's is left out in the end, so it is kept back.
                d["hash"].update(((";" if d["groups"] else "") + part[:-1]).encode())
                d["groups"] += end - begin
                _count(d, keys[begin:end])
            begin = end
            d["more"] = []
        self.open = None
        if docs:
            last = docs.pop()
            last_a, last_b = (int(at_a[-1]) + 1, int(at_b[-1]) + 1) if len(at_a) else (0, 0)
            start_a, start_b = (max(int(upto[s][-2]), n) if len(docs) else n for s, n in ((0, last_a), (1, last_b)))
            last["waiting"] = (a[start_a:], b[start_b:])
            self.open = last
        for d in docs:
            done += _result(d)
        if self.open and len(self.open["keys"]) > self.links:
            done.append(_links(self.open))
        return done

    def finish(self) -> list[tuple]:
        last, self.open = self.open, None
        return _result(last) if last else []

    def _ends(self, a: np.ndarray, upto_a: np.ndarray, b: np.ndarray, upto_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where tokens end, in bytes of the feed. The open group's ids begin together, and so does each document; sides
        may be ahead of each other where a window is not the last, so each document begins where both have ended."""
        ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        last = lambda ends, upto: np.concatenate(([0], ends))[upto]
        size = np.maximum(np.diff(last(ends_a, upto_a), prepend=0), np.diff(last(ends_b, upto_b), prepend=0))
        starts = np.cumsum(size) - size
        for ends, upto in ((ends_a, upto_a), (ends_b, upto_b)):
            counts = np.diff(upto, prepend=0)
            ends += np.repeat(starts - (last(ends, upto) - np.diff(last(ends, upto), prepend=0)), counts)
        return ends_a, ends_b

    def _groups(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> tuple[str, list[int]]:
        """All groups as one text, ids of A then of B, each group with a mark behind it; and where each begins."""
        if not len(at_a):
            return "", [0]
        n_a, n_b = int(at_a[-1]) + 1, int(at_b[-1]) + 1
        group_a, group_b = (np.repeat(np.arange(len(at)), np.diff(at, prepend=-1)) for at in (at_a, at_b))
        before_b, upto_a = np.concatenate(([0], at_b + 1))[:-1], at_a + 1
        pick = np.empty(n_a + n_b, np.int64)
        place_a, place_b = np.arange(n_a) + before_b[group_a], np.arange(n_b) + upto_a[group_b]
        last_a, last_b = np.zeros(n_a, bool), np.zeros(n_b, bool)
        last_a[at_a], last_b[at_b] = True, True
        pick[place_a] = a[:n_a] + np.where(last_a, self.base[0][1], self.base[0][0])
        pick[place_b] = b[:n_b] + np.where(last_b, self.base[1][1], self.base[1][0])
        parts = list(map(self.text.__getitem__, pick.tolist()))
        sizes = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        return "".join(parts), [0, *sizes[at_a + at_b + 1].tolist()]


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in two rising arrays of the numbers that are in both."""
    at = np.searchsorted(b, a)
    same = b[np.minimum(at, len(b) - 1)] == a if len(b) else np.zeros(len(a), bool)
    return np.flatnonzero(same), at[same]


def _count(d: dict, keys: np.ndarray) -> None:
    """Adds links to a document's pairs."""
    found, times = np.unique(keys, return_counts=True)
    if len(d["keys"]):
        found, where = np.unique(np.concatenate((d["keys"], found)), return_inverse=True)
        times = np.bincount(where, np.concatenate((d["times"], times)), len(found)).astype(np.int64)
    d["keys"], d["times"] = found, times


def _links(d: dict) -> tuple:
    """A row with a part of a document's links alone."""
    out = (d["row"], None, 0, 0, 0, 0, None, d["keys"], d["times"])
    d["keys"], d["times"] = np.zeros(0, np.int64), np.zeros(0, np.int64)
    return out


def _result(d: dict) -> list[tuple]:
    return [(d["row"], d["doc_id"], *d["n"], d["groups"], d["groups"], d["hash"].hexdigest() if d["hash"] else "", d["keys"], d["times"])]


def sweep(rows: DataFrame, byte_model: str = BYTE_MODEL, model: str = PIECE_MODEL) -> DataFrame:
    """``events`` to (row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times), a row for each document,
    which has all columns but a part of the links, and more rows with links alone (no groups_sha256) for very long ones.
    A pair is A's id times the pieces of B, plus B's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = token_lengths(byte_model, model)
        kinds, machine = [_kind(len(n)) for n in lengths], Sweep(lengths, LINKS)
        fed: list[tuple] = []
        size = 0
        for batch in batches:
            for row, doc, side, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                fed.append((row, doc, side, np.frombuffer(ids, kinds[side])))
                size += len(ids)
                # Side 1 comes last in a window, so both of its sides are fed together.
                if side and size >= 2 * FED:
                    yield _batch(machine.feed(fed))
                    fed, size = [], 0
        yield _batch(machine.feed(fed) + machine.finish())

    ordered = rows.repartition("row").sortWithinPartitions("row", "first", "side")
    return ordered.mapInArrow(run, _SWEPT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
    lists = []
    for values, kind in ((cols[7], np.int64), (cols[8], np.int32)):
        ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
        flat = np.concatenate(values).astype(kind) if len(values) else np.zeros(0, kind)
        lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
    plain = [pa.array(c, pa.string() if i == 6 else pa.int64()) for i, c in enumerate(cols[:7])]
    return pa.RecordBatch.from_arrays([*plain, *lists], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def pair_counts(swept: DataFrame, ids_of_b: int) -> DataFrame:
    """(pair, n, best): the links of each pair in all documents, and whether no pair of its B id has more."""
    each = swept.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.pairs", "p.times")
    counts = materialise(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")), "pair-counts")
    b = F.col("pair") % ids_of_b
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row for each piece of B, at most
    return materialise(counts.join(F.broadcast(most), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def align(docs: DataFrame, byte_model: str = BYTE_MODEL, model: str = PIECE_MODEL, hot: int = HOT, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of (doc_id, text).

    ``n_best``: links whose pair is as frequent as any of its B id; ``count_sum``: the sum over links of their pairs' counts."""
    spark = docs.sparkSession
    ids_of_b = piece_model(model).get_piece_size()
    swept = materialise(sweep(events(docs, byte_model, model, window), byte_model, model), "swept")
    counts = pair_counts(swept, ids_of_b)
    known = hot_tokens(counts, hot).select("pair", "n", "best").toPandas().sort_values("pair")
    sent = spark.sparkContext.broadcast((known["pair"].to_numpy(np.int64), known["n"].to_numpy(np.int64), known["best"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        for batch in batches:
            size = batch.num_rows
            lists = batch.column(7)
            keys, times = lists.flatten().to_numpy(), batch.column(8).flatten().to_numpy()
            of = np.repeat(np.arange(size), pc.list_value_length(lists).to_numpy())
            at = np.minimum(np.searchsorted(pairs, keys), max(len(pairs) - 1, 0))
            found = pairs[at] == keys if len(pairs) else np.zeros(len(keys), bool)
            at, mine, often = at[found], of[found], times[found].astype(np.int64)
            sums = [_sums(mine, often * x[at], size) for x in (best, n)] if len(pairs) else [np.zeros(size, np.int64)] * 2
            rare = np.concatenate(([0], np.cumsum(np.bincount(of[~found], minlength=size)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(rare, pa.int32()), pa.array(x[~found])) for x in (keys, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(7)), *map(pa.array, sums), *lists], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "pairs", "times"])

    own = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    per = swept.mapInArrow(run, _SWEPT.replace("pairs array<long>", "n_best long, count_sum long, pairs array<long>"))
    # A document's own columns travel with its first rare pair, or with a number that is no pair's if it has none.
    rare = per.select("row", *own, F.posexplode_outer(F.arrays_zip("pairs", "times")).alias("at", "rare"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    rare = rare.select("row", *[F.when(first, F.col(c)).alias(c) for c in own], F.coalesce("rare.pairs", -F.col("row") - 1).alias("pair"), F.col("rare.times").alias("times"))
    met = rare.join(counts, "pair", "left")
    of_rare = lambda value: F.coalesce(F.sum(F.col("times") * value), F.lit(0))
    total = lambda c, value: (F.sum(c) + of_rare(value)).alias(c)
    return met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")], total("n_best", F.col("best").cast("int")), total("count_sum", F.col("n")),
        F.max("groups_sha256").alias("groups_sha256"),
    ).drop("row")


def _sums(of: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of whole numbers by rows; ``of`` doesn't fall."""
    upto = np.concatenate(([0], np.cumsum(values)))
    return np.diff(upto[np.searchsorted(of, np.arange(size + 1))])
