"""Merkle fixity audit of WARC archives.

A manifest has a row for each record: archive, offset, length and SHA-256 of its bytes. Records of an
offset range make a leaf block, blocks of neighbouring ranges a node, and so on up to the whole
archive, neighbouring archives, and one root. Two replicas' trees are built in the same jobs. If the
roots differ, the audit goes down: at each level it reads only the children of nodes that differ, and
in the end only the records of blocks that differ.

Defined cases
- null html or url: an empty block or no target; null page_id: archived together.
- Repeated rows (all columns equal) are one record. Equal page_ids are records of their own.
- An archive of more than ARCHIVE_ROWS records is split by hash, so that none is hot.
- Empty manifests: equal roots, no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_key, key_block, materialise

#: page_ids that share an archive, and records at most, about.
ARCHIVE_IDS, ARCHIVE_ROWS = 256, 4096
#: Parts of one archive's name: the low bits count the parts that it is split into.
SPLIT_BITS = 20
#: Bytes of one leaf block; bits of fan-out over blocks and over archives.
BLOCK_BYTES, BLOCK_BITS, ARCHIVE_BITS = 1 << 16, 4, 10


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A page as the text of a WARC resource record."""
    body = F.coalesce(html, F.lit(""))
    lines = [
        F.lit("WARC/1.0"), F.lit("WARC-Type: resource"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))), F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")), F.lit(""), body, F.lit(""), F.lit(""),
    ]
    return F.concat_ws("\r\n", *lines)


def manifest(pages: DataFrame, *more: Column) -> DataFrame:
    """(record_id, archive, offset, length, digest, ...) of pages (page_id, url, html) as WARC archives.

    ``more``: further aggregable columns of the pages to keep, equal for equal rows."""
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(F.col("page_id").alias("record_id"), hash_key(F.col("page_id"), F.col("url"), F.col("html")).alias("key"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"), *more)
    rows = materialise(rows.distinct(), "records")
    group = F.coalesce(F.pmod(F.floor(F.col("record_id") / ARCHIVE_IDS), F.lit(1 << 40)), F.lit(0)).cast("long")
    rows = rows.withColumn("group", group)
    sizes = rows.groupBy("group").agg(F.ceil(F.count("*") / ARCHIVE_ROWS).alias("splits"))
    rows = rows.join(sizes, "group").withColumn("archive", F.shiftleft("group", SPLIT_BITS) + key_block(F.col("key"), F.col("splits")))
    before = Window.partitionBy("archive").orderBy("record_id", "key", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("group", "splits", "key")


def _node(children: DataFrame, keys: list[Column], *said: str) -> DataFrame:
    """Digests over ordered children of each side and node; the fan-out bounds what is gathered."""
    listed = F.array_sort(F.collect_list(F.struct(*said)))
    text = F.array_join(F.transform(listed, lambda x: F.concat_ws(":", *[x[c].cast("string") for c in said])), "\n")
    return children.groupBy("side", *keys).agg(F.sha2(text, 256).alias("digest"))


def _differing(nodes: DataFrame) -> DataFrame:
    """(archive, block) of the nodes that the two sides don't have alike."""
    side = lambda n: F.max(F.when(F.col("side") == n, F.col("digest")))
    return nodes.groupBy("archive", "block").agg(side(0).alias("x"), side(1).alias("y")).where("not (x <=> y)").select("archive", "block")


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """(record_id, archive, offset, length, status, digest, replica_digest) of the records that differ.

    ``status``: changed, missing (in the right manifest) or extra. A record is one and the same if its id and digest
    are; a missing one moves those behind it, whose blocks are looked through, but they aren't reported."""
    cols = ["record_id", "archive", "offset", "length", "digest"]
    records = left.select(F.lit(0).alias("side"), *cols).unionByName(right.select(F.lit(1).alias("side"), *cols))
    records = materialise(records.withColumn("block", F.expr(f"offset div {BLOCK_BYTES}")), "replicas")
    top = records.agg(F.max("block"), F.max("archive")).first()
    blocks, archives = ((x or 0).bit_length() for x in top)
    # Each level: how its nodes follow from those of the level below.
    steps = [(0, BLOCK_BITS)] * -(-blocks // BLOCK_BITS) + [(ARCHIVE_BITS, 0)] * -(-archives // ARCHIVE_BITS)
    up = lambda step: [F.shiftright("archive", step[0]).alias("archive"), F.shiftright("block", step[1]).alias("block")]
    levels = [materialise(_node(records, [F.col("archive"), F.col("block")], "offset", "length", "digest"), "blocks")]
    for step in steps:
        levels.append(materialise(_node(levels[-1], up(step), "archive", "block", "digest"), "nodes"))
    bad = _differing(levels[-1])
    for nodes, step in zip(levels[-2::-1], steps[::-1], strict=True):
        parents = bad.select(F.col("archive").alias("above"), F.col("block").alias("over"))
        archive, block = up(step)
        bad = _differing(nodes.join(parents, (archive == F.col("above")) & (block == F.col("over")), "left_semi"))
    found = records.join(bad, ["archive", "block"], "left_semi")
    # What both sides hold equally often, wherever it lies, is no difference.
    found = materialise(found.withColumn("group", F.shiftright("archive", SPLIT_BITS)), "suspects")
    on = lambda n: F.sum((F.col("side") == n).cast("int"))
    uneven = found.groupBy("group", "record_id", "digest").agg(on(0).alias("n"), on(1).alias("m")).where("n <> m")
    uneven = materialise(uneven.select(F.col("group").alias("g"), F.col("record_id").alias("r"), F.col("digest").alias("d")), "uneven")
    found = found.join(uneven, (F.col("group") == F.col("g")) & F.col("record_id").eqNullSafe(F.col("r")) & F.col("digest").eqNullSafe(F.col("d")), "left_semi")
    # The rest is matched within an archive, which is bounded: first by record and digest, then by record.
    at = F.struct("offset", "length", "digest")
    sides = lambda rows, keys: rows.groupBy(*keys, "rank").agg(*[F.max(F.when(F.col("side") == n, F.col("at"))).alias(f"of_{n}") for n in (0, 1)])
    ranked = lambda rows, keys: rows.withColumn("rank", F.row_number().over(Window.partitionBy("side", *keys).orderBy("at")))
    keys = ["archive", "record_id"]
    alone = sides(ranked(found.select("side", *keys, "digest", at.alias("at")), [*keys, "digest"]), [*keys, "digest"]).where("of_0 is null or of_1 is null")
    alone = alone.select(*keys, F.col("of_0").isNull().cast("int").alias("side"), F.coalesce("of_0", "of_1").alias("at"))
    met = sides(ranked(alone, keys), keys)
    either = lambda c: F.coalesce(F.col(f"of_0.{c}"), F.col(f"of_1.{c}")).alias(c)
    status = F.when(F.col("of_0").isNull(), "extra").when(F.col("of_1").isNull(), "missing").otherwise("changed")
    return met.select("record_id", "archive", either("offset"), either("length"), status.alias("status"), F.col("of_0.digest").alias("digest"), F.col("of_1.digest").alias("replica_digest"))
