"""Near-duplicate documents by one-permutation MinHash.

Each text's shingle hashes fall into as many bins as there are signature values; a bin's smallest
hash is its value and an empty bin borrows from a bin that its own hash sequence picks (optimal
densification). Texts with equal sets are one class from then on. A class has one bucket per band of
values. Candidate edges are stars: every class of a bucket with the one that shares most buckets with
others. Edges are confirmed on full sets and joined classes become components. Where a bucket still
holds more than one component, small buckets get the pairs across components that are left, and the
classes of larger ones an exact prefix-filtered join: shingles in ascending order of frequency, a pair
that is similar enough shares one so early in both that what follows can still make up the overlap.
So all that the bands bring together is decided, while a large group's pairs stay in proportion to it.

Defined cases
- null or empty text, or white space only: no shingles, a component of its own, kept.
- Rows that share a doc_id (repeated rows): each gets the component of its own text; one row of a component is kept.
- Null doc_id: takes part; it is a component's id only if no member has one, and one row is kept then too.
- Empty table: no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, in_small_batches, materialise, named
from .components import connected
from .shingles import _odd, mix, shingle_sets

#: Bands and values in each; a pair of similarity 0.8 shares no band once in 300,000 cases.
BANDS, ROWS = 42, 6
BIN_BITS = 8
#: Members of a bucket whose remaining pairs are tried directly.
SMALL = 8

_BINS = 1 << BIN_BITS
#: For each attempt and bin, the bin that an empty one borrows from.
_BORROW = np.random.default_rng(7).integers(0, _BINS, (16 * _BINS, _BINS)).astype(np.uint8)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of sorted distinct hashes (at least one)."""
    bins = (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    filled = np.zeros(_BINS, bool)
    filled[bins[first]] = True
    out = np.zeros(_BINS, np.uint64)
    out[bins[first]] = hashes[first]
    empty = np.flatnonzero(~filled)
    for a, b in ((0, 16), (16, len(_BORROW))):
        if not len(empty):
            break
        hits = filled[_BORROW[a:b, empty]]
        found, which = hits.any(axis=0), hits.argmax(axis=0)
        done = empty[found]
        out[done] = out[_BORROW[a + which[found], done]]
        empty = empty[~found]
    out[empty] = hashes[0]  # after thousands of attempts
    return out


def numbered(docs: DataFrame, name: str = "_row") -> DataFrame:
    """The rows with a number each, ``name``; written, so that a row keeps its number however often it is read."""
    return materialise(in_small_batches(docs).withColumn(name, F.monotonically_increasing_id()), "numbered")


def signed_rows(docs: DataFrame, size: int) -> DataFrame:
    """(row, doc_id, n_shingles, digest, bands) of numbered rows: a digest of the whole set, null if empty, and its buckets."""
    factors, offset = _odd(ROWS), mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, values = [], [], []
            for hashes in shingle_sets(batch.column(2), size):
                n.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                if len(hashes):
                    values.append(signature(hashes)[: BANDS * ROWS])
            table = np.array(values, np.uint64).reshape(-1, BANDS, ROWS)
            keys = mix((table * factors).sum(axis=2, dtype=np.uint64) + offset).view(np.int64)
            ends = np.concatenate(([0], np.cumsum(np.array(n) > 0))).astype(np.int32) * BANDS
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), bands], ["row", "doc_id", "n_shingles", "digest", "bands"])

    rows = docs.select(F.col("_row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, n_shingles long, digest binary, bands array<long>")


def class_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cid, hashes), one row for each class in ``wanted`` (cid, rep), from the text of the row numbered ``rep``."""
    rows = docs.select("_row", "text").join(wanted.hint("shuffle_hash"), F.col("_row") == F.col("rep")).select("cid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [hashes.view(np.int64) for hashes in shingle_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["cid", "hashes"])

    return rows.mapInArrow(run, "cid long, hashes array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets share enough: 100 * intersection >= percent * union."""
    left = sets.select(F.col("cid").alias("a"), F.col("hashes").alias("of_a"))
    right = sets.select(F.col("cid").alias("b"), F.col("hashes").alias("of_b"))
    both = pairs.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(100 * shared >= percent * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (cid, component) across components, among them all that are similar enough.

    With sizes n and m the sets must share ``need`` = percent * (n + m) / (100 + percent) shingles. Taking
    shingles in one order, the first shared one, at places i and j from 1, leaves at most n - i + 1 and
    m - j + 1 to share. So only a set's first (100 - percent) % and one more can be that first one. In the
    largest component, most of whose pairs are inside it, no pair is sought from both sides."""
    chosen = materialise(nodes.join(sets, "cid").select("cid", "component", "hashes"), "chosen")
    words = chosen.select("cid", "component", F.size("hashes").alias("n"), F.explode("hashes").alias("shingle"))
    # Written first, so that the join can be split where a shingle is in most of the sets.
    often = materialise(words.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1"), "often")
    counted = words.join(often, "shingle", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    ranked = counted.groupBy("cid", "component", "n").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("all"))
    keep = F.floor((100 - percent) * F.col("n") / 100).cast("int") + 1
    first = ranked.select("cid", "component", "n", F.posexplode(F.slice("all", F.lit(1), keep)).alias("at", "one")).select("cid", "component", "n", "at", "one.shingle", "one.often")
    first = materialise(first.where("often > 1").drop("often"), "prefixes")
    largest = chosen.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select(F.col("component").alias("largest"))
    probes = first.join(F.broadcast(largest), F.col("component") == F.col("largest"), "left_anti")
    other = first.select("shingle", F.col("cid").alias("b"), F.col("component").alias("other"), F.col("n").alias("m"), F.col("at").alias("to"))
    need = F.ceil(percent * (F.col("n") + F.col("m")) / (100 + percent))
    able = (F.col("n") - F.col("at") >= need) & (F.col("m") - F.col("to") >= need)
    met = probes.join(other, "shingle").where((F.col("component") != F.col("other")) & able)
    return met.select(F.least("cid", "b").alias("a"), F.greatest("cid", "b").alias("b")).distinct()


def _named_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, kept) of numbered rows."""
    rows = materialise(signed_rows(docs, size), "signatures")
    # The first row of a class: by doc_id, those without one last, then by number.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    classes = rows.where("digest is not null").groupBy("digest").agg(first.alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")).withColumn("rep", F.col("first.row"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    members = classes.select("cid", "n", F.explode("bands").alias("bucket"))
    # Most buckets have one member; only the others are looked at again. What is joined on a bucket is written
    # first, here and below: a large group's bucket has most of the rows, and joins of two plain exchanges can be split.
    shared = materialise(members.groupBy("bucket").agg(F.count("*").alias("many")).where("many > 1"), "shared")
    members = materialise(members.join(shared, "bucket"), "buckets")
    degree = members.groupBy("cid").agg(F.sum("many").alias("degree"))
    wanted = members.select("cid").distinct().join(classes.select("cid", "rep"), "cid")
    sets = materialise(class_sets(docs, wanted, size), "sets")

    fits = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (F.col("a") != F.col("b"))
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    centre = F.max(F.struct("degree", (-F.col("cid")).alias("least"), F.col("n").alias("m"))).alias("centre")
    centres = materialise(members.join(degree, "cid").groupBy("bucket").agg(centre).select("bucket", (-F.col("centre.least")).alias("b"), "centre.m"), "centres")
    tried = materialise(members.withColumnRenamed("cid", "a").join(centres, "bucket").where(fits).select(*pair).distinct(), "pairs")
    links = connected(confirmed(tried, sets, percent))

    named = members.join(links, "cid", "left").select("bucket", "cid", "n", "many", F.coalesce("component", "cid").alias("component"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    named = materialise(named.join(materialise(mixed, "mixed"), "bucket"), "named")
    few = named.where(F.col("many") <= SMALL)
    others = few.select("bucket", F.col("cid").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"))
    few = few.withColumnRenamed("cid", "a").join(others, "bucket").where(fits & (F.col("a") < F.col("b")) & (F.col("component") != F.col("other"))).select("a", "b")
    left = few.unionByName(prefix_pairs(named.where(F.col("many") > SMALL).select("cid", "component").distinct(), sets, percent)).distinct()
    found = confirmed(materialise(left.join(tried, ["a", "b"], "left_anti"), "pairs"), sets, percent)
    links = connected(found.unionByName(links.select(F.col("cid").alias("a"), F.col("component").alias("b"))))

    named = classes.join(links, "cid", "left").select("digest", "first", F.coalesce("component", "cid").alias("component"))
    # Written first: a join of two plain exchanges can be split where one component has most of the rows.
    best = F.min(F.struct("first.no_id", "first.doc_id", "digest", "first.row")).alias("best")
    least = materialise(named.groupBy("component").agg(best).select("component", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("stays")), "components")
    of = named.join(least, "component").select("digest", "component_id", "stays")
    none = F.col("digest").isNull()
    return rows.join(of, "digest", "left").select("row", "doc_id", "n_shingles", F.when(none, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (none | (F.col("row") == F.col("stays"))).alias("kept"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of (doc_id, text)."""
    return _named_rows(numbered(docs.select("doc_id", "text")), size, percent).drop("row")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those whose component another row stands for.

    One row of each component stays: that of the least doc_id, rows without one last, then by the digest
    of its set, then by number. So of repeated rows one stays, of a component without any doc_id too, and
    of two texts under one doc_id only the one that is another's copy goes. Texts without shingles all stay.
    All columns pass through, whatever their names."""
    row, number = fresh(docs, "row", "gone")
    docs = numbered(docs, row)
    gone = _named_rows(docs.select(named(row).alias("_row"), "doc_id", "text"), size, percent).where("not kept").select(F.col("row").alias(number))
    return docs.join(gone.hint("shuffle_hash"), named(row) == named(number), "left_anti").drop(row)
