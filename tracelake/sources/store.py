"""A trace's tables as Parquet, reused while the log is the same; and exports of results.

A store is a folder of generations. Each build writes a new folder and names it in a manifest that is
written last, so readers see a whole generation or none. A manifest carries the log's fingerprint
(files, sizes, times of change), the format's version and the checkpoint spacing; if any differs, all is
built anew. The instructions are written then, or their listing if their effects are to wait; the tables and indexes that follow from them, and the parts of the
log's files, which follow from its lines, are written when they are first asked for, each under another name and renamed when it is whole. Paths are read and written by
Spark and Hadoop alone, so any file system will do."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.render import fixed_width
from ..operators import state
from ..operators.derived import DERIVED
from ..schema import TABLES
from .files import files_of, move, remove, saved
from .logs import MOST_ROWS, by_position, classified, completed, counted, file_parts, instructions, parsed, placed, read_lines, tasks_of

VERSION = 5
#: Checkpoint spacing by the size of the log: up to so many bytes, positions between two checkpoints.
SPACING = ((512 << 20, 500), (2 << 30, 2000), (8 << 30, 5000), (16 << 30, 10000))
WIDEST_SPACING = 20000
#: What each table is sorted by, so that files and row groups have narrow ranges of it.
ORDER = {
    "listing": ["idx"], "instruction": ["idx"], "register_write": ["analysis_reg", "idx", "ordinal"], "memory_access": ["addr_hex", "idx", "slot"],
    "by_offset": ["offset_val", "idx"], "by_mnemonic": ["mnemonic", "idx"], "checkpoint": ["idx", "register"], "mnemonic": ["first_idx"], "def_use": ["idx", "reg"],
    "register": ["analysis_reg"], "bucket": ["bucket"], "memory_def_use": ["idx", "slot", "at"], "by_address": ["address", "idx"], "offset_rank": ["offset_val", "chunk"],
    "mnemonic_rank": ["mnemonic", "chunk"], "by_gram": ["gram", "block"], "gram": ["gram"], "file_part": ["path", "part"],
}
#: Tables whose rows take long to compute.
COSTLY = ("memory_access", "file_part")
#: Tables whose rows stay in the tasks that read their positions: each file is sorted, and all are looked into.
BY_PART = ("by_gram",)
#: Columns of tables whose row groups carry Bloom filters as well.
BLOOM = {"by_address": "address", "by_gram": "gram"}


def checkpoint_spacing(size: int) -> int:
    """Positions between two checkpoints for a log of ``size`` bytes."""
    return next((spacing for below, spacing in SPACING if size < below), WIDEST_SPACING)


def fingerprint(spark: SparkSession, path: str) -> dict:
    """Size and a description of the log's files; both change if the log does."""
    fs, where = files_of(spark, path)
    found = sorted((str(s.getPath()), s.getLen(), s.getModificationTime()) for s in fs.listStatus(where))
    return {"size": sum(n for _, n, _ in found), "files": [list(f) for f in found]}


def read_manifest(spark: SparkSession, store: str) -> dict | None:
    """The manifest, or None if there is no whole one."""
    fs, where = files_of(spark, f"{store}/manifest.json")
    if not fs.exists(where):
        return None
    try:
        return json.loads("".join(r[0] for r in spark.read.text(f"{store}/manifest.json").collect()))
    except ValueError:
        return None


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """By a temporary name, then renamed over what is there, in one step where the file system can do that."""
    jvm = spark.sparkContext._jvm
    _, where = files_of(spark, path)
    _, aside = files_of(spark, f"{path}.{uuid.uuid4().hex}")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    fs, _ = files_of(spark, path)
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    files.rename(fs.makeQualified(aside), fs.makeQualified(where), overwrite)


def save(df: DataFrame, name: str, path: str, count: int | None = None, dealt: bool = False) -> DataFrame:
    """A table in its order, and read from there. ``count``: of instructions; then no task's share grows with them.
    ``dealt``: rows are in ranges of that order already."""
    order, n = ORDER[name], [] if count is None else [max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // MOST_ROWS))]
    if dealt:
        ranges = df
    elif count is not None and order[0] == "idx":
        ranges = by_position(df, count).drop("range")
    else:
        # Ranges are found by reading rows first, so what takes long to compute is written before.
        ranges = (saved(df, name) if name in COSTLY else df).repartitionByRange(*n, *order)
    writer = ranges.sortWithinPartitions(*order).write.option("compression", "zstd")
    (writer.option(f"parquet.bloom.filter.enabled#{BLOOM[name]}", True) if name in BLOOM else writer).parquet(path)
    return df.sparkSession.read.schema(TABLES[name]).parquet(path)


class Tables(dict):
    """The tables of a generation by name; one that isn't there yet is built from the others and stays."""

    def __init__(self, spark: SparkSession, manifest: dict, log: str):
        self.spark, self.manifest, self.log = spark, manifest, log

    def __missing__(self, name: str) -> DataFrame:
        path = f"{self.manifest['folder']}/{name}"
        fs, where = files_of(self.spark, path)
        if not fs.exists(where):
            if name == "listing":  # then the instructions are there, and have all of it
                self[name] = found = self["instruction"]
                return found
            aside = f"{path}.{uuid.uuid4().hex}"
            save(self._derived(name), name, aside, self.manifest["count"], dealt=name in BY_PART)
            if not move(self.spark, aside, path):  # another session was first
                remove(self.spark, aside)
        self[name] = found = self.spark.read.schema(TABLES[name]).parquet(path)
        return found

    def _derived(self, name: str) -> DataFrame:
        if name == "instruction":
            return completed(self["listing"])
        if name == "checkpoint":
            return state.checkpoints(self["register_write"], self.manifest["count"], self.manifest["spacing"])
        if name == "file_part":
            if fingerprint(self.spark, self.log) != self.manifest["log"]:
                raise ValueError("the log was changed after its store was opened")
            lines = read_lines(self.spark, self.log)
            return file_parts(placed(classified(lines), tasks_of(lines)))
        return DERIVED[name](self.__getitem__)


def build(spark: SparkSession, log: str, store: str, spacing: int | None = None, effects: bool = True) -> dict:
    """Reads a log and writes its instructions, or, without ``effects``, their listing; returns the manifest."""
    known = fingerprint(spark, log)
    spacing = spacing or checkpoint_spacing(known["size"])
    folder = f"{store}/{uuid.uuid4().hex}"
    lines = parsed(spark, log, f"{folder}/lines", effects)
    n, count, sp = counted(lines)
    name = "instruction" if effects else "listing"
    save(instructions(placed(lines, tasks_of(lines, n)), count, effects), name, f"{folder}/{name}", count, dealt=True)
    manifest = {"version": VERSION, "log": known, "spacing": spacing, "count": count, "initial_sp": sp, "folder": folder}
    _write_text(spark, f"{store}/manifest.json", json.dumps(manifest))
    remove(spark, f"{folder}/lines")
    return manifest


def open_store(spark: SparkSession, log: str, store: str, spacing: int | None = None, effects: bool = True) -> tuple[Tables, dict]:
    """(tables, manifest) of a log; built only if the store has none that fits. ``effects``: whether a build writes the
    instructions at once, or their listing, from which they follow when they are asked for."""
    found = read_manifest(spark, store)
    known = fingerprint(spark, log)
    wanted = {"version": VERSION, "log": known, "spacing": spacing or checkpoint_spacing(known["size"])}
    if not found or any(found.get(k) != v for k, v in wanted.items()):
        found = build(spark, log, store, spacing, effects)
    return Tables(spark, found, log), found


def write_tsv(result: DataFrame, path: str) -> None:
    """A result with a header, tab-separated."""
    result.write.option("sep", "\t").option("header", True).csv(path)


def tsv_lines(result: DataFrame) -> DataFrame:
    """(line) of a result's rows, tab-separated; null is empty. The header is ``"\\t".join(result.columns)``."""
    return result.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in result.columns]).alias("line"))


def fixed_width_lines(rows: DataFrame) -> DataFrame:
    """(line) of grid rows (num, address, offset, mnemonic, operands, comment) in columns of fixed width."""
    widths = (("num", 6), ("address", 14), ("offset", 10), ("mnemonic", 8), ("operands", 40))
    return rows.select(F.concat_ws(" ", fixed_width(*[(F.col(c), n) for c, n in widths]), F.coalesce("comment", F.lit(""))).alias("line"))
