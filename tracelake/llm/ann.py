"""Approximate nearest neighbours by cosine with an inverted multi-index.

Vectors are scaled to length one and cut into two halves; k-means on a bounded sample gives each half
its centroids, whose number grows with the fourth root of the entries, and a vector's cell is its pair
of nearest centroids. A query visits cells in order of the sum of both halves' squared distances, which
a heap yields without sorting all pairs, until they hold as many entries as a calibration on a few
queries asks for; every entry of a visited cell is scored exactly. Of equal vectors only those rows are
entries that can be among some query's best, so a hot vector costs no more than any other. Entries lie in
blocks of neighbouring cells; a cell with many entries is spread over several. A query goes to the blocks of its cells. Where a
block has many queries, they are dealt to chunks and the block is sent to each of its own chunks, so no
task holds an unbounded number of either, and nothing is sent where no query looks.

Defined cases
- null or zero vectors, or ones with null or non-finite components, take no part; so do vectors of
  another than the most frequent dimension (the smaller one of two equally frequent).
- Null ids take no part. Equal ids: candidates of their own; a query's own row is every row of its id.
- Fewer than ``k`` candidates: all. Ties go to the smaller id. Empty table: no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_small_batches, materialise

#: Centroids of each half up to so many entries; rows to fit them on at most; rounds of k-means.
CENTROIDS, FEW, SAMPLE, FIT_ROUNDS = 64, 50_000, 20_000, 12
#: Entries of one block and queries of one chunk, about; entries of a cell that share a block at most.
BLOCK_ROWS, CHUNK_QUERIES, CELL_ROWS = 16_384, 4_096, 4_096
#: Queries that the number of visits is calibrated on, and the share of their neighbours to be found.
CALIBRATION, RECALL = 200, 0.97


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector as doubles) of the rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where("id is not null and vector is not null")
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vector") == (sizes["d"] if sizes else 0))


def least_rows(vectors: DataFrame, k: int) -> DataFrame:
    """Of each vector the rows (id, vector) that can be among a query's best ``k``: ``k`` rows of each of its ``k`` + 1
    smallest ids. Ties go to the smaller id and only one id is the query's own, so no other row ever is.

    Both steps leave out rows before they are shuffled, however many a vector or an id has."""
    each = vectors.groupBy("vector", "id").agg(F.count("*").alias("copies"))
    order = Window.partitionBy("vector").orderBy("id")
    each = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    return each.select("id", "vector", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))).alias("copy")).drop("copy")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    x = np.unique(x, axis=0)
    centroids = x[np.random.default_rng(1).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _distances(x, centroids).argmin(axis=1)
        sums, n = np.zeros_like(centroids), np.bincount(near, minlength=len(centroids))
        np.add.at(sums, near, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def drawn(vectors: DataFrame, n: int, sample: int) -> DataFrame:
    """At most ``sample`` of ``n`` rows (id, vector), those of the smallest hashes.

    A threshold leaves about twice as many before they are put in order."""
    rate = min(1.0, 2 * sample / max(1, n))
    # The row's number tells repeated rows apart, so that they don't all pass together.
    rows = vectors.withColumn("h", F.xxhash64("id", "vector", F.monotonically_increasing_id()))
    return rows.where(F.shiftrightunsigned("h", 32) <= F.lit(int(rate * 0xFFFFFFFF))).orderBy("h", "id").limit(sample).drop("h")


def centroids_for(n: int) -> int:
    """How many centroids each half gets for ``n`` entries: cells grow with the square root of the entries."""
    return int(CENTROIDS * max(1.0, n / FEW) ** 0.25)


def fit_centroids(vectors: DataFrame, n: int, k: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of the first and the second half, from at most ``sample`` of ``n`` rows."""
    rows = drawn(vectors, n, sample).select("vector").toArrow()
    if not rows.num_rows:
        return np.zeros((1, 0)), np.zeros((1, 0))
    x = _unit(_matrix(rows["vector"]))
    half = x.shape[1] // 2
    return k_means(x[:, :half], k), k_means(x[:, half:], k)


def with_cells(vectors: DataFrame, centroids: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``vectors`` with ``cell``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = centroids
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(1)))
                half = first.shape[1]
                cell = _distances(x[:, :half], first).argmin(axis=1) * len(second) + _distances(x[:, half:], second).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32))], ["id", "vector", "cell"])

    return vectors.mapInArrow(run, "id long, vector array<double>, cell int")


def traverse(near: np.ndarray, far: np.ndarray, counts: np.ndarray, visits: int) -> list[int]:
    """Cells by ascending sum of both halves' distances, until they hold ``visits`` entries.

    The heap holds the corners of what is visited in the grid of both halves' sorted distances."""
    a, b = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
    da, db, a, b, wide = near[a].tolist(), far[b].tolist(), a.tolist(), b.tolist(), len(b)
    reach = [-1] * len(a)  # the last visited column of each row
    heap, cells, held = [(da[0] + db[0], 0, 0)], [], 0
    push, pop = heapq.heappush, heapq.heappop
    while heap and held < visits:
        _, i, j = pop(heap)
        reach[i] = j
        if n := counts[a[i] * wide + b[j]]:
            cells.append(a[i] * wide + b[j])
            held += n
        if i + 1 < len(a) and reach[i + 1] == j - 1:
            push(heap, (da[i + 1] + db[j], i + 1, j))
        if j + 1 < wide and (i == 0 or reach[i - 1] > j):
            push(heap, (da[i] + db[j + 1], i, j + 1))
    return cells


def _best(query_id: int, q: np.ndarray, ids: np.ndarray, x: np.ndarray, scores: np.ndarray, k: int) -> tuple[list[int], list[float], np.ndarray]:
    """The best ``k`` of some candidates, rescored one by one so that equal vectors have equal scores."""
    keep = np.flatnonzero(ids != query_id)
    if len(keep) > k:
        least = np.partition(scores[keep], len(keep) - k)[len(keep) - k]
        keep = keep[scores[keep] >= least - 1e-9]
    exact = (x[keep] * q).sum(axis=1) / (np.sqrt((x[keep] * x[keep]).sum(axis=1)) * np.sqrt((q * q).sum()))
    order = np.lexsort((ids[keep], -exact))[:k]
    return ids[keep][order].tolist(), exact[order].tolist(), keep[order]


def _scaled(x: np.ndarray) -> np.ndarray:
    """By powers of two, which change no cosine, so that squares stay finite."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def exact_neighbours(entries: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int) -> DataFrame:
    """(query_id, cell, score, vec_id) of a few queries' best ``k`` within each batch of all entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, unit = _scaled(queries), _unit(queries)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x, cells = batch.column(0).to_numpy(), _scaled(_matrix(batch.column(1))), batch.column(2).to_numpy()
            scores = unit @ _unit(x).T
            out: list[list] = [[], [], [], []]
            for i, query_id in enumerate(query_ids.tolist()):
                found, exact, at = _best(query_id, q[i], ids, x, scores[i], k)
                for col, values in zip(out, ([query_id] * len(found), cells[at].tolist(), exact, found), strict=True):
                    col.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.float64(), pa.int64()), strict=True)], ["query_id", "cell", "score", "vec_id"])

    return _top(entries.mapInArrow(run, "query_id long, cell int, score double, vec_id long"), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each query, with ``rank``."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibrated_visits(entries: DataFrame, queries: DataFrame, centroids: tuple[np.ndarray, np.ndarray], counts: np.ndarray, k: int, recall: float = RECALL, sample: int = CALIBRATION) -> int:
    """How many entries a query must visit for ``recall`` of a sample's true neighbours to be among them."""
    some = drawn(queries, queries.count(), sample).toArrow()
    if not some.num_rows:
        return k + 1
    x, first, second = _matrix(some["vector"]), *centroids
    unit, half = _unit(x), first.shape[1]
    near, far = _distances(unit[:, :half], first), _distances(unit[:, half:], second)
    at = {q: i for i, q in enumerate(some["id"].to_pylist())}
    needed, total = [], int(counts.sum())
    found: dict[int, list[int]] = {}
    for r in exact_neighbours(entries, x, some["id"].to_numpy(), k).select("query_id", "cell").collect():
        found.setdefault(r["query_id"], []).append(r["cell"])
    for query_id, cells in found.items():
        order = traverse(near[at[query_id]], far[at[query_id]], counts, total)
        held = dict(zip(order, np.cumsum(counts[order]).tolist(), strict=True))
        needed += [held[c] for c in cells]
    return max(k + 1, sorted(needed)[min(len(needed) - 1, int(recall * len(needed)))]) if needed else k + 1


def blocks_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many parts each cell has, the number of its first part, and the block of each part.

    Blocks are runs of parts of about BLOCK_ROWS entries, so neighbouring cells share one."""
    splits = np.maximum(1, -(-counts // CELL_ROWS))
    starts = np.cumsum(splits) - splits
    sizes = np.repeat(counts / splits, splits)
    return splits, starts, ((np.cumsum(sizes) - sizes) // BLOCK_ROWS).astype(np.int64)


def search(vectors: DataFrame, is_query: Column, k: int = 5, visits: int | None = None, k_centroids: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row (id, vector) that ``is_query`` picks.

    ``visits``: entries that a query visits at least; calibrated for a recall of RECALL if not given."""
    rows = materialise(least_rows(in_small_batches(vectors), k), "rows")
    n = rows.count()
    centroids = fit_centroids(rows, n, k_centroids or centroids_for(n))
    entries = with_cells(rows, centroids)
    counts = np.zeros(len(centroids[0]) * len(centroids[1]), np.int64)
    for r in entries.groupBy("cell").count().collect():  # one row for each cell, as many as the square root of the entries
        counts[r["cell"]] = r["count"]
    queries = vectors.where(is_query)
    if visits is None:
        visits = calibrated_visits(entries, queries, centroids, counts, k)
    sent = vectors.sparkSession.sparkContext.broadcast((centroids, counts, *blocks_of(counts)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries go to the block of their part of the cell."""
        _, _, splits, starts, block = sent.value
        for batch in batches:
            ids, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            part = starts[cell] + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % splits[cell]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block[part])], ["id", "vector", "cell", "block"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query and, for each block it must look at, the cells to visit there."""
        (first, second), counts, splits, starts, block = sent.value
        listed = counts.tolist()
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, half = _unit(_matrix(batch.column(1))), first.shape[1]
            near, far = _distances(unit[:, :half], first), _distances(unit[:, half:], second)
            rows: list[int] = []
            out: list[list] = [[], []]
            for i in range(batch.num_rows):
                order = np.array(traverse(near[i], far[i], listed, visits), np.int64)
                n = splits[order]
                owner = np.repeat(order, n)
                at = block[np.repeat(starts[order] - (np.cumsum(n) - n), n) + np.arange(len(owner))]
                pairs = np.unique(np.stack((at, owner)), axis=1)
                found, begin = np.unique(pairs[0], return_index=True)
                rows += [i] * len(found)
                out[0] += [cells.astype(np.int32) for cells in np.split(pairs[1], begin[1:])] if len(found) else []
                out[1] += found.tolist()
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(out[0], pa.list_(pa.int32())), pa.array(out[1], pa.int64())], ["id", "vector", "cells", "block"])

    def score(entries: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if entries.num_rows and queries.num_rows:
            order = np.argsort(entries["cell"].to_numpy(), kind="stable")
            ids, cell, x = entries["id"].to_numpy()[order], entries["cell"].to_numpy()[order], _scaled(_matrix(entries["vector"])[order])
            q, query_ids = _scaled(_matrix(queries["vector"])), queries["id"].to_pylist()
            unit_x, unit_q = _unit(x), _unit(q)
            here, begin = np.unique(cell, return_index=True)
            end = np.append(begin[1:], len(cell))
            for i, wanted in enumerate(queries["cells"].to_pylist()):
                at = np.searchsorted(here, wanted)
                rows = np.concatenate([np.arange(begin[k], end[k]) for k, c in zip(at.tolist(), wanted, strict=True) if k < len(here) and here[k] == c] or [np.zeros(0, np.int64)])
                found, exact, _ = _best(query_ids[i], q[i], ids[rows], x[rows], unit_x[rows] @ unit_q[i], k)
                for col, values in zip(out, ([query_ids[i]] * len(found), found, exact), strict=True):
                    col.extend(values)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    placed = entries.mapInArrow(place, "id long, vector array<double>, cell int, block long")
    routed = materialise(queries.mapInArrow(route, "id long, vector array<double>, cells array<int>, block long"), "routed")
    chunks = materialise(routed.groupBy("block").agg(F.ceil(F.count("*") / CHUNK_QUERIES).cast("int").alias("chunks")), "chunks")
    placed = placed.join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    routed = routed.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("chunks")
    placed, routed = placed.select("id", "vector", "cell", "block", "chunk"), routed.select("id", "vector", "cells", "block", "chunk")
    found = placed.groupBy("block", "chunk").cogroup(routed.groupBy("block", "chunk")).applyInArrow(score, "query_id long, vec_id long, score double")
    return _top(found, k).select("query_id", "rank", "vec_id", "score")
