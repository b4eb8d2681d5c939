"""Where values come from: last writes, overlapping stores, backward taint slices and data provenance.

A taint slice is what a use reaches over ``def_use``. It is walked backwards on the driver, which reads
``def_use`` in windows of positions: one job for each window that holds a part of the slice. What the
driver holds is so bounded by ``max_steps`` and the width of a window, not by the trace.

Addresses are unsigned and wrap at 2^64, and accesses may be of any size."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.patterns import LABELS
from ..functions.registers import related, taint_name, taint_register
from ..functions.u64 import hex_text, little_endian, wrap_add, wrap_subtract
from ..sources.files import saved, scratch_folder
from .lookup import ranges_of, within
from .running import CHUNK, carried_last
from .tables import definitions_of, number_under, raw_bytes, unit_size

#: Bytes of a granule, by which accesses are matched; granules of one part of a wide access.
GRANULE, PART = 8, 1 << 14
#: Positions of one window in which a taint slice is read; those of many slices at once, and slices that a task walks at most.
WINDOW, SLICES_WINDOW, TOGETHER = 1 << 13, 1 << 15, 4096


def previous_write(writes: DataFrame, register: str, idx: int) -> DataFrame:
    """One row (idx): the last write to a register at or before ``idx``; none if there is none."""
    name = taint_name(register)
    rows = writes.where((F.col("analysis_reg") == name) & (F.col("idx") <= idx)) if name else writes.limit(0)
    return rows.agg(F.max("idx").alias("idx")).where("idx is not null")


def register_source(writes: DataFrame, register: str, idx: int) -> DataFrame:
    """As ``previous_write``, before ``idx``."""
    return previous_write(writes, register, idx - 1)


def _granules(rows: DataFrame) -> DataFrame:
    """``rows`` (addr, size, ...) once for each granule of memory that they touch, with ``granule`` (the address of its
    first byte over GRANULE), ``begin`` and ``end``, the bytes of it, and ``at``, which byte of the access is the first there."""
    inside = F.col("addr").bitwiseAND(F.lit(GRANULE - 1))
    count = F.shiftright(inside + F.col("size").cast("long") + (GRANULE - 1), 3)
    rows = rows.withColumns({"_inside": inside, "_count": count})
    # In two steps, so that no array is as long as a very wide access.
    rows = rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_count - 1) div {PART}"))))
    rows = rows.withColumn("_k", F.explode(F.sequence(F.col("_part") * PART, F.least(F.col("_count"), (F.col("_part") + 1) * PART) - 1)))
    granule = (F.shiftrightunsigned("addr", 3) + F.col("_k")).bitwiseAND(F.lit((1 << 61) - 1))
    begin = F.when(F.col("_k") == 0, F.col("_inside")).otherwise(0)
    end = F.least(F.lit(GRANULE).cast("long"), F.col("_inside") + F.col("size") - GRANULE * F.col("_k"))
    at = F.greatest(GRANULE * F.col("_k") - F.col("_inside"), F.lit(0))
    return rows.withColumns({"granule": granule, "begin": begin, "end": end, "at": at}).drop("_inside", "_count", "_part", "_k")


def _covers(byte: int) -> Column:
    return (F.col("begin") <= byte) & (F.col("end") > byte)


def _last_writes(accesses: DataFrame, chunk: int) -> DataFrame:
    """Each read once for each granule, with ``byte0`` and so on: the last write (write_idx, write_slot) of each byte.

    Memory is followed in granules, each with the last write of every byte, so the work grows with the bytes moved
    and not with pairs of reads and writes, and a granule that is used all the time is split by position."""
    rows = accesses.where(F.col("kind").isin("R", "W")).select("idx", "slot", "kind", "addr", F.greatest("size", F.lit(1)).alias("size"))
    # Reads see earlier instructions' writes only: at one position they come first.
    single = _granules(rows).withColumn("is_write", (F.col("kind") == "W").cast("int"))
    mark = F.struct(F.col("idx").alias("write_idx"), F.col("slot").alias("write_slot"))
    bytes_ = {f"byte{i}": F.when((F.col("is_write") == 1) & _covers(i), mark) for i in range(GRANULE)}
    return carried_last(single, ["granule"], "idx", ["idx", "is_write", "slot"], bytes_, chunk=chunk).where("is_write = 0")


def memory_def_use(accesses: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The table ``memory_def_use``: for each read and granule the last write of each of its bytes, from byte ``at`` of
    the read on; null where nothing was written before."""
    every = F.array(*[f"byte{i}" for i in range(GRANULE)])
    found = _last_writes(accesses, chunk).withColumn("last_writes", F.slice(every, (F.col("begin") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int")))
    return found.select("idx", "slot", "at", "last_writes")


def last_write_of(def_use: DataFrame, idx: int, slot: int, skip: int, size: int) -> DataFrame:
    """One row (write_idx, write_slot): the newest last write of any of ``size`` bytes of a read from byte ``skip`` on; none
    if nothing wrote them. A point read of the table ``memory_def_use``."""
    rows = def_use.where((F.col("idx") == idx) & (F.col("slot") == slot)).select("at", F.posexplode("last_writes").alias("k", "w"))
    rows = rows.where((F.col("at") + F.col("k")).between(skip, skip + size - 1) & F.col("w").isNotNull())
    return rows.agg(F.max("w").alias("w")).where("w is not null").select("w.write_idx", "w.write_slot")


def previous_overlapping_writes(accesses: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(idx, slot, addr, size, write_idx, write_slot): for each read the last write before it that shares a byte."""
    found = _last_writes(accesses, chunk)
    seen = F.greatest(*[F.when(_covers(i), F.col(f"byte{i}")) for i in range(GRANULE)])
    found = found.withColumn("seen", seen).groupBy("idx", "slot", "addr", "size").agg(F.max("seen").alias("seen"))
    return found.select("idx", "slot", "addr", "size", "seen.write_idx", "seen.write_slot")


def taint_slice(instruction: DataFrame, writes: DataFrame, def_use: DataFrame, register: str, from_idx: int, max_steps: int = 300, window: int = WINDOW) -> DataFrame:
    """(index, address, mnemonic, operands, hit_writes, read_regs, taint_before, taint_after), newest first, of the
    instructions that a register's value at ``from_idx`` follows from (that one included). Memory is not followed."""
    spark = instruction.sparkSession
    schema = "index long, hit_writes array<string>, read_regs array<string>, taint_before array<string>, taint_after array<string>"
    target = taint_name(register)
    # Positions still to be visited, and the registers for which they are.
    waiting: dict[int, set[str]] = {}
    if target and from_idx >= 0 and max_steps > 0 and (first := previous_write(writes, target, from_idx).first()):
        waiting[first[0]] = {target}
    uses: dict[int, list[tuple[str, int | None]]] = {}
    low, rows, tainted = None, [], {target}
    while waiting and len(rows) < max_steps:
        at = max(waiting)
        if low is None or at < low:
            low = max(0, at - window + 1)
            uses = {}
            for use in def_use.where(F.col("idx").between(low, at)).select("idx", "reg", "def_idx").collect():
                uses.setdefault(use["idx"], []).append((use["reg"], use["def_idx"]))
        hit, reads = waiting.pop(at), uses.get(at, [])
        for reg, before in reads:
            if before is not None:
                waiting.setdefault(before, set()).add(reg)
        read = {reg for reg, _ in reads}
        now, tainted = tainted, (tainted - hit) | read
        rows.append((at, sorted(hit), sorted(read), sorted(now), sorted(tainted)))
    found = spark.createDataFrame(rows, schema)
    known = instruction.where(F.col("idx").isin([r[0] for r in rows])) if rows else instruction.limit(0)
    out = known.select(F.col("idx").alias("index"), "address", "mnemonic", "operands").join(F.broadcast(found), "index")
    return out.select("index", "address", "mnemonic", "operands", "hit_writes", "read_regs", "taint_before", "taint_after").orderBy(F.desc("index"))


_STATE = "root long, defs array<long>, regs array<string>, tainted array<string>, taken int"
_VISITED = "root long, index long, hit_writes array<string>, read_regs array<string>, taint_before array<string>, taint_after array<string>"


def taint_slices(instruction: DataFrame, writes: DataFrame, def_use: DataFrame, roots: DataFrame, max_steps: int = 300, window: int = SLICES_WINDOW) -> DataFrame:
    """(root, ...) as ``taint_slice``, for every row of ``roots`` (root, register, idx), whose numbers ``root`` differ.

    All slices are walked at once, in rounds. What a slice still has to visit is one position for each register at
    most; a round takes every slice through the window of positions that holds its next one, in a task for each
    window and some thousands of slices, which is given the uses and definitions of that window alone. A slice ends
    when nothing is left or it has ``max_steps`` instructions; what it has are then its newest ones, because whatever
    leads to an instruction is newer than it. The driver counts slices and holds none."""
    spark = instruction.sparkSession
    wanted = roots.select("root", taint_register(F.col("register")).alias("reg"), (F.col("idx") + 1).alias("idx")).where("reg is not null and idx > 0")
    # A last write is looked for among the writes of the registers asked for.
    asked = F.broadcast(wanted.select(F.col("reg").alias("analysis_reg")).distinct())
    first = definitions_of(wanted.select("idx", "reg").distinct(), writes.join(asked, "analysis_reg", "left_semi")).where("def_idx is not null")
    one = F.array("reg")
    state = wanted.join(first, ["idx", "reg"]).select("root", F.array("def_idx").alias("defs"), one.alias("regs"), one.alias("tainted"), F.lit(0).alias("taken"))
    visited = scratch_folder(spark, "slices")
    spark.createDataFrame([], _VISITED).write.parquet(visited)
    state = saved(state.where(F.lit(max_steps > 0)), "slice-state")
    while True:
        at = F.array_max("defs")
        state = state.withColumn("window", F.expr(f"array_max(defs) div {window}"))
        windows = state.groupBy("window").agg(F.count("*").alias("n"))
        ranges = ranges_of(windows.select("window"), window)
        if not ranges:
            break
        # The slices of one window are dealt to parts, each with the window's uses.
        windows = windows.withColumn("parts", F.expr(f"n div {TOGETHER} + 1"))
        state = state.join(windows, "window").withColumn("part", F.pmod(F.xxhash64("root"), F.col("parts"))).select("window", "part", "root", "defs", "regs", "tainted", "taken", at.alias("at"))
        uses = def_use.where(within(F.col("idx"), ranges)).withColumn("window", F.expr(f"idx div {window}"))
        uses = uses.join(windows, "window").select("window", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "idx", "reg", "def_idx")

        def walk(key: tuple, slices: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
            return _walk_window(int(key[0]) * window, slices, near, max_steps)

        schema = f"{_VISITED}, {_STATE.removeprefix('root long, ')}"
        round_ = saved(state.groupBy("window", "part").cogroup(uses.groupBy("window", "part")).applyInPandas(walk, schema), "slice-round")
        round_.where("index is not null").select("root", "index", "hit_writes", "read_regs", "taint_before", "taint_after").write.mode("append").parquet(visited)
        state = round_.where("index is null").select("root", "defs", "regs", "tainted", "taken")
    found = spark.read.schema(_VISITED).parquet(visited)
    known = instruction.select(F.col("idx").alias("index"), "address", "mnemonic", "operands")
    return found.join(known, "index").select("root", "index", "address", "mnemonic", "operands", "hit_writes", "read_regs", "taint_before", "taint_after")


def _walk_window(low: int, slices: pd.DataFrame, near: pd.DataFrame, max_steps: int) -> pd.DataFrame:
    """Takes slices through one window of positions: a row for each instruction visited, one for what is left of a slice."""
    uses: dict[int, list[tuple[str, int | None]]] = {}
    # Positions in an array with gaps arrive as floating numbers, so gaps are told apart before.
    for at, reg, before, some in zip(near["idx"].tolist(), near["reg"].tolist(), near["def_idx"].fillna(-1).astype("int64").tolist(), near["def_idx"].notna().tolist(), strict=True):
        uses.setdefault(at, []).append((reg, before if some else None))
    out = []
    for root, defs, regs, tainted, taken in zip(*(slices[c].tolist() for c in ("root", "defs", "regs", "tainted", "taken")), strict=True):
        waiting: dict[int, set[str]] = {}
        for at, reg in zip(defs, regs, strict=True):
            waiting.setdefault(int(at), set()).add(reg)
        now = set(tainted)
        while waiting and taken < max_steps and (at := max(waiting)) >= low:
            hit, reads = waiting.pop(at), uses.get(at, [])
            for reg, before in reads:
                if before is not None:
                    waiting.setdefault(before, set()).add(reg)
            read = {reg for reg, _ in reads}
            old, now = now, (now - hit) | read
            taken += 1
            out.append((root, at, sorted(hit), sorted(read), sorted(old), sorted(now), None, None, None, None))
        if waiting and taken < max_steps:
            left = [(at, reg) for at, names in waiting.items() for reg in names]
            out.append((root, None, None, None, None, None, [at for at, _ in left], [reg for _, reg in left], sorted(now), taken))
    frame = pd.DataFrame(out, columns=["root", "index", "hit_writes", "read_regs", "taint_before", "taint_after", "defs", "regs", "tainted", "taken"])
    return frame.astype({"root": "int64", "index": "Int64", "taken": "Int32"})


#: What ``provenance`` says besides its events.
MESSAGES = {
    "position": "no such position", "no_load": "no load into the register near this position",
    "no_write": "no earlier store of these bytes was found", "ok": "ok",
}


#: What the kinds of events of ``provenance`` are called.
KINDS = {"load": "读取", "write": "写入", "calc": "计算"}


def event_kind(kind: Column) -> Column:
    """The label of an event's kind; others as they are, ``-`` for none."""
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), kind), kind)
    return F.coalesce(F.nullif(label, F.lit("")), F.lit("-"))


def load_context(instruction: DataFrame, register: str, from_idx: int, lookback: int = 120) -> DataFrame:
    """At most one row: the newest load in [from_idx - lookback, from_idx] that writes the register (at ``from_idx``
    any load), with the address, size and bytes of the register's share of it."""
    names = related(register)
    listed = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    rows = instruction.where(F.col("idx").between(max(0, from_idx - max(0, lookback)), from_idx))
    if names:
        rows = rows.where((F.col("idx") == from_idx) | F.exists("register_changes", lambda c: F.array_contains(listed, F.upper(c["register"]))))
    rows = rows.select("idx", "address", "mnemonic", "operands", F.explode("memory_ops").alias("o")).where("o.type = 'read'").withColumn("slot", F.col("o.slot"))
    rows = rows.withColumn("addr", parse.auto_value(F.col("o.address"))).where("addr is not null").orderBy(F.desc("idx"), "o.slot").limit(1)
    rows = rows.withColumns({"size": F.greatest("o.data_size", F.lit(1)), "value": F.col("o.data_value"), "targets": parse.target_registers(F.col("operands"))})
    rows = rows.withColumns({"pairs": parse.assignments(F.col("value")), "raw": raw_bytes(F.col("value"))})
    named = F.get(F.filter("targets", lambda t: F.array_contains(listed, t)), F.lit(0))
    rows = rows.withColumn("chosen", F.coalesce(named, F.get("targets", F.lit(0)), F.get(listed, F.lit(0))))
    before = F.slice("targets", F.lit(1), F.greatest(F.array_position("targets", F.col("chosen")).cast("int") - 1, F.lit(0)))
    rows = rows.withColumn("skip", F.aggregate(before, F.lit(0), lambda n, r: n + unit_size(F.col("mnemonic"), r)))
    unit = F.least(unit_size(F.col("mnemonic"), F.col("chosen")), F.greatest(F.lit(1), F.col("size") - F.col("skip")))
    rows = rows.withColumn("unit", F.when(F.col("chosen").isNull(), F.col("size")).otherwise(unit))
    every = F.transform(parse.named_in_order(F.col("pairs")), lambda r: F.struct(r.alias("r"), hex_text(parse.value_of(F.col("pairs"), r)).alias("v")))
    rows = rows.withColumn("other", F.get(F.filter(every, lambda u: u["v"].isNotNull()), F.lit(0)))
    own = little_endian(number_under(F.col("pairs"), F.col("chosen")), F.col("unit"))
    inside = 2 * F.col("skip") < F.length("raw")
    part = F.when(inside, F.substring("raw", 2 * F.col("skip") + 1, 2 * F.col("unit"))).otherwise(F.col("raw"))
    taken = F.coalesce(own, part, F.rpad(little_endian(F.col("other.v"), F.col("size")), 2 * F.col("size"), "0"))
    skip = F.when(own.isNotNull(), F.col("skip")).when(F.col("raw").isNotNull(), F.when(inside, F.col("skip")).otherwise(0)).when(F.col("other").isNotNull(), 0).otherwise(F.col("skip"))
    hit = F.when(own.isNull() & F.col("raw").isNull() & F.col("other").isNotNull(), F.col("other.r")).otherwise(F.col("chosen"))
    rows = rows.withColumns({"bytes": taken, "skip": skip, "hit": F.coalesce(hit, F.lit((register or "").upper()))})
    length = F.coalesce(F.nullif(F.length("bytes"), F.lit(0)) / 2, F.greatest(F.lit(1), F.col("size") - F.col("skip"))).cast("int")
    return rows.select("idx", "address", "mnemonic", "operands", wrap_add(F.col("addr"), F.col("skip").cast("long")).alias("addr"), length.alias("size"), "bytes", F.col("hit").alias("register"), "slot", F.col("skip").cast("long").alias("skip"))


def _signed(n: int) -> int:
    n %= 1 << 64
    return n - (1 << 64) if n >= 1 << 63 else n


def stores_near(accesses: DataFrame, buckets: DataFrame, addr: int, size: int) -> DataFrame:
    """The stores that may overlap ``size`` bytes from ``addr`` on: those of buckets whose stores reach there, by their
    directory, that begin no farther before it than the widest of these is wide. Both are pushed into the scan."""
    first = wrap_subtract(F.lit(_signed(addr)).cast("long"), F.col("widest").cast("long") - 1)
    last = F.lit(_signed(addr + size - 1)).cast("long")
    # Between two addresses, in signed numbers, which begin anew at 2^63.
    reach = F.when(first <= last, (F.col("highest") >= first) & (F.col("lowest") <= last)).otherwise((F.col("highest") >= first) | (F.col("lowest") <= last))
    found = buckets.where((F.col("n_writes") > 0) & reach).select("bucket", "widest").orderBy(F.desc("widest"), "bucket").limit(_BUCKETS + 1).collect()
    if not found:
        return accesses.limit(0)
    low, high = _signed(addr - found[0]["widest"] + 1), _signed(addr + size - 1)
    near = F.col("addr").between(low, high) if low <= high else (F.col("addr") >= low) | (F.col("addr") <= high)
    rows = accesses.where((F.col("kind") == "W") & near)
    return rows.where(F.col("bucket").isin([r["bucket"] for r in found])) if len(found) <= _BUCKETS else rows


#: Buckets that a scan is told by name at most.
_BUCKETS = 8


def previous_matching_write(accesses: DataFrame, start_idx: int, addr: int, size: int, value: str | None, max_scan: int = 20000, buckets: DataFrame | None = None) -> DataFrame:
    """At most one row: the store at or before ``start_idx`` that gave a range of memory its bytes.

    Of all stores that overlap it, the newest whose overlapping bytes are equal (or, if the bytes of the
    range are unknown, the newest). Failing that, the newest of the last ``max_scan`` instructions whose
    bytes are unknown. ``buckets``: the directory, if there is one, by which few stores are read."""
    accesses = accesses if buckets is None else stores_near(accesses, buckets, addr, size)
    rows = accesses.where((F.col("kind") == "W") & (F.col("idx") <= start_idx)).withColumn("size", F.greatest("size", F.lit(1)))
    # How far each begins behind the other, modulo 2^64; they overlap if one begins inside the other.
    rows = rows.withColumns({"_behind": wrap_subtract(F.col("addr"), F.lit(addr).cast("long")), "_ahead": wrap_subtract(F.lit(addr).cast("long"), F.col("addr"))})
    inside = F.col("_behind").between(0, size - 1)
    rows = rows.where(inside | ((F.col("_ahead") >= 0) & (F.col("_ahead") < F.col("size"))))
    at_value, at_store = F.when(inside, F.col("_behind")).otherwise(0), F.when(inside, 0).otherwise(F.col("_ahead"))
    shared = F.least(F.col("size") - at_store, size - at_value)
    # Bounded, because it may be computed of rows that are left out.
    place = lambda n: F.least(F.greatest(n, F.lit(0)), F.lit(1 << 30)).cast("int")
    part = lambda digits, begin: F.substring(digits, place(2 * begin + 1), place(2 * shared))
    label = lambda way: F.when((at_value == 0) & (shared == size), LABELS[f"{way}exact"]).otherwise(LABELS[f"{way}overlap"])
    if value is None:
        rows = rows.withColumns({"stage": F.lit(0), "match": F.lit(LABELS["address"])})
    else:
        equal = part(F.col("value_bytes"), at_store) == part(F.lit(value), at_value)
        unknown = F.col("value_bytes").isNull() & (F.col("idx") > start_idx - max_scan)
        rows = rows.where(equal | unknown).withColumns({"stage": F.when(equal, 0).otherwise(1), "match": F.when(equal, label("")).otherwise(LABELS["scan_address"])})
    slot = F.when(F.col("stage") == 0, -F.col("slot")).otherwise(F.col("slot"))
    return rows.orderBy("stage", F.desc("idx"), slot).limit(1).select("idx", "slot", "addr", "size", "value_bytes", "match", "source_registers")


def writer_of(accesses: DataFrame, load: Row, max_scan: int, memory_uses: DataFrame | None = None, buckets: DataFrame | None = None) -> Row | None:
    """The store that gave a load (of ``load_context``) its bytes, as ``previous_matching_write``.

    The last write of the load's bytes is that store if its bytes are the load's; the table ``memory_def_use`` says which
    it is. Only if they aren't (memory was changed unseen), earlier stores are searched."""
    if memory_uses is not None and (last := last_write_of(memory_uses, load["idx"], load["slot"], load["skip"], load["size"]).first()):
        near = accesses if buckets is None else stores_near(accesses, buckets, load["addr"], load["size"])
        one = near.where((F.col("idx") == last["write_idx"]) & (F.col("slot") == last["write_slot"]))
        found = previous_matching_write(one, load["idx"] - 1, load["addr"], load["size"], load["bytes"], max_scan).first()
        if found and found["match"] != LABELS["scan_address"]:
            return found
    return previous_matching_write(accesses, load["idx"] - 1, load["addr"], load["size"], load["bytes"], max_scan, buckets).first()


def provenance(instruction: DataFrame, writes: DataFrame, accesses: DataFrame, def_use: DataFrame, register: str, from_idx: int, max_scan: int = 20000, max_calc_steps: int = 120, memory_uses: DataFrame | None = None, buckets: DataFrame | None = None) -> tuple[DataFrame, str]:
    """Events (place, kind, index, instruction_address, instruction_text, memory_address, memory_size, value_hex, detail)
    from a load over the store that wrote its bytes to what the stored register follows from; and a message."""
    schema = "place int, kind string, index long, instruction_address string, instruction_text string, memory_address string, memory_size int, value_hex string, detail string"
    spark = instruction.sparkSession
    load = load_context(instruction, register, from_idx).first() if from_idx >= 0 else None
    if not load:
        return spark.createDataFrame([], schema), MESSAGES["no_load" if from_idx >= 0 else "position"]
    spaced = lambda digits: " ".join(digits[i : i + 2] for i in range(0, len(digits), 2)).upper() if digits else "?"
    text = lambda row: f"{row['mnemonic']} {row['operands']}".strip()
    shown = lambda addr: f"0x{addr % (1 << 64):x}"
    events = [(0, "load", load["idx"], load["address"], text(load), shown(load["addr"]), load["size"], spaced(load["bytes"]), f"read into {load['register']}")]
    store = writer_of(accesses, load, max_scan, memory_uses, buckets)
    if not store:
        return spark.createDataFrame(events, schema), MESSAGES["no_write"]
    by = instruction.where(F.col("idx") == store["idx"]).select("address", "mnemonic", "operands").first()
    source = list(store["source_registers"] or [])
    events.append((1, "write", store["idx"], by["address"], text(by), shown(store["addr"]), store["size"], spaced(store["value_bytes"]), f"{store['match']}, stored from {', '.join(source) or '-'}"))
    if source:
        chain = taint_slice(instruction, writes, def_use, source[0], max(0, store["idx"] - 1), max_calc_steps)
        for n, node in enumerate(chain.collect()):  # max_calc_steps rows at most
            said = f"writes {', '.join(node['hit_writes']) or '-'}, reads {', '.join(node['read_regs']) or '-'}"
            events.append((2 + n, "calc", node["index"], node["address"], text(node), "-", 0, "-", said))
    return spark.createDataFrame(events, schema), MESSAGES["ok"]
