"""Tables that follow from ``instruction``: register writes, memory accesses, mnemonics, definitions and uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.recipe import applied
from ..functions.registers import analysis_register, is_w, read_registers, related, state_register, taint_register, width_bytes
from ..functions.u64 import hex_text, hex_value, index_value, let, little_endian
from .running import CHUNK, carried_last


def register_writes(instruction: DataFrame) -> DataFrame:
    """The table ``register_write``; value is null where the text is no hexadecimal number."""
    rows = instruction.select("idx", F.explode("register_changes").alias("c"))
    name = F.col("c.register")
    return rows.select(
        "idx", F.col("c.ordinal").alias("ordinal"), name.alias("register"), state_register(name).alias("state_reg"),
        analysis_register(name).alias("analysis_reg"), is_w(name).alias("is_w"), hex_value(F.col("c.new_value")).alias("value"),
    )


def write_postings(writes: DataFrame) -> DataFrame:
    """(analysis_reg, idx), each once."""
    return writes.where("analysis_reg is not null").select("analysis_reg", "idx").distinct()


def write_counts(writes: DataFrame) -> DataFrame:
    """(analysis_reg, n): how many instructions write each register."""
    return write_postings(writes).groupBy("analysis_reg").agg(F.count("*").alias("n"))


def register_directory(writes: DataFrame) -> DataFrame:
    """The table ``register``: how many instructions write each register, the first and the last of them."""
    return write_postings(writes).groupBy("analysis_reg").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def unit_size(mnemonic: Column, register: Column) -> Column:
    """Bytes of one register's share of an access."""
    m = F.lower(mnemonic)
    return F.when(m.rlike("^(?:ldrb|strb)"), 1).when(m.rlike("^(?:ldrh|strh)"), 2).when(m.startswith("ldrsw"), 4).otherwise(width_bytes(register))


def raw_bytes(text: Column) -> Column:
    """The bytes (as lower-case digits) that a text of hexadecimal pairs gives; null if it is anything else."""
    compact = F.regexp_replace(F.regexp_replace(text, r"\s+", ""), "^0[xX]", "")
    return F.when(compact.rlike(r"^(?:[0-9a-fA-F]{2})+$"), F.lower(compact))


def number_under(pairs: Column, register: Column) -> Column:
    """32 digits of what ``pairs`` assign to a register under any of its names; null if no number."""
    number = F.substring(register, 2, 10)
    fixed = F.create_map(*[F.lit(x) for a in ("FP", "X29", "LR", "X30") for x in (a, related(a)[1])])
    twin = F.when(register.rlike(r"^X\d+$"), F.concat(F.lit("W"), number)).when(register.rlike(r"^W\d+$"), F.concat(F.lit("X"), number))
    names = (register, F.try_element_at(fixed, register), twin)
    found = F.array(*[parse.value_of(pairs, n) for n in names])
    return let(F.array_compact(F.transform(found, hex_text)), lambda some: F.get(some, F.lit(0)))


def with_store_bytes(rows: DataFrame) -> DataFrame:
    """Adds ``value_bytes`` (digits, in order of address; null if unknown) and ``source_registers`` of stores.

    Bytes are those stated, as written, or else each register's value, lowest byte first. Rows have
    mnemonic, operands, size and data_value."""
    rows = rows.withColumns({"_raw": raw_bytes(F.col("data_value")), "_pairs": parse.assignments(F.col("data_value")), "_targets": parse.target_registers(F.col("operands"))})
    units = F.transform("_targets", lambda r: F.struct(r.alias("r"), little_endian(number_under(F.col("_pairs"), r), unit_size(F.col("mnemonic"), r)).alias("b")))
    rows = rows.withColumn("_units", F.filter(units, lambda u: u["b"].isNotNull()))
    # Registers that the operands don't name: the first number is stored in full size.
    every = F.transform(parse.named_in_order(F.col("_pairs")), lambda r: F.struct(r.alias("r"), hex_text(parse.value_of(F.col("_pairs"), r)).alias("v")))
    rows = rows.withColumn("_first", F.get(F.filter(every, lambda u: u["v"].isNotNull()), F.lit(0)))
    size = F.greatest("size", F.lit(1))
    cut = lambda digits: F.substring(digits, F.lit(1), 2 * size)
    whole = F.rpad(little_endian(F.col("_first.v"), size), 2 * size, "0")
    value = F.when(F.col("_raw").isNotNull(), cut(F.col("_raw"))).when(F.size("_units") > 0, cut(F.array_join(F.transform("_units", lambda u: u["b"]), ""))).otherwise(whole)
    none = F.array().cast("array<string>")
    source = F.when(F.col("_raw").isNotNull(), none).when(F.size("_units") > 0, F.transform("_units", lambda u: u["r"])).when(F.col("_first").isNotNull(), F.array("_first.r")).otherwise(none)
    return rows.withColumns({"value_bytes": value, "source_registers": source}).drop("_raw", "_pairs", "_targets", "_units", "_first")


def address_bucket(addr_hex: Column) -> Column:
    """The first six digits of an address, zeros behind a shorter one."""
    return F.rpad(F.substring(addr_hex, 1, 6), 6, "0")


def memory_accesses(instruction: DataFrame, slots: int | None = None) -> DataFrame:
    """The table ``memory_access``: reads R, writes W, dump lines D and modified ones D*, by numeric address.

    ``slots``: how many operations, and how many dump lines, of one instruction are listed; all, if None."""
    base = instruction.select("idx", "mnemonic", "operands", F.explode("memory_ops").alias("o"))
    base = base.select(
        "idx", "mnemonic", "operands", F.col("o.slot").alias("slot"), F.when(F.col("o.type") == "read", "R").otherwise("W").alias("kind"),
        F.col("o.address").alias("address"), F.col("o.data_size").alias("size"), F.col("o.data_value").alias("data_value"),
    )
    stores = applied(base, with_store_bytes).withColumn("value_bytes", F.when(F.col("kind") == "W", F.col("value_bytes")))
    stores = stores.withColumn("source_registers", F.when(F.col("kind") == "W", F.col("source_registers"))).drop("mnemonic", "operands")
    dumps = instruction.select("idx", F.explode("memory_dump").alias("d")).select(
        "idx", F.col("d.slot").alias("slot"), F.when(F.col("d.is_modified"), "D*").otherwise("D").alias("kind"), F.col("d.address").alias("address"),
        F.size("d.data").alias("size"), F.array_join("d.data", " ").alias("data_value"), F.lit(None).cast("string").alias("value_bytes"), F.lit(None).cast("array<string>").alias("source_registers"),
    )
    rows = stores.unionByName(dumps)
    rows = (rows if slots is None else rows.where(F.col("slot") < slots)).withColumn("addr", index_value(F.col("address"))).where("addr is not null")
    rows = rows.withColumn("addr_hex", F.lower(F.hex("addr")))
    return rows.select("idx", "slot", "kind", "addr", "addr_hex", address_bucket(F.col("addr_hex")).alias("bucket"), "size", "address", "data_value", "value_bytes", "source_registers")


def bucket_directory(accesses: DataFrame) -> DataFrame:
    """The table ``bucket``: for each, its accesses and stores, where the stores begin (``lowest`` to ``highest``, as
    signed numbers) and how wide the widest of them is, and the first and last position."""
    store = F.col("kind") == "W"
    return accesses.groupBy("bucket").agg(
        F.count("*").alias("n"), F.count_if(store).alias("n_writes"), F.min(F.when(store, F.col("addr"))).alias("lowest"), F.max(F.when(store, F.col("addr"))).alias("highest"),
        F.max(F.when(store, F.greatest("size", F.lit(1)))).alias("widest"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"),
    )


def by_address(instruction: DataFrame) -> DataFrame:
    """The table ``by_address``: positions by an instruction's address in lower case, where its line writes it so."""
    address = F.lower("address")
    return instruction.where(F.col("raw_line").contains(address)).select(address.alias("address"), "idx")


def by_offset(instruction: DataFrame) -> DataFrame:
    """The table ``by_offset``: positions by module offset, where that is a number."""
    return instruction.where("offset_val is not null").select("offset_val", "idx")


def by_mnemonic(instruction: DataFrame) -> DataFrame:
    """The table ``by_mnemonic``: positions by mnemonic."""
    return instruction.select("mnemonic", "idx")


def mnemonic_counts(by_mnemonic: DataFrame) -> DataFrame:
    """The table ``mnemonic``: each one's count and first position."""
    return by_mnemonic.groupBy("mnemonic").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))


def write_sets(writes: DataFrame) -> DataFrame:
    """(idx, writes): the sorted registers that an instruction writes, as data flow sees them."""
    return writes.groupBy("idx").agg(F.array_sort(F.collect_set(taint_register(F.col("register")))).alias("writes"))


def register_uses(instruction: DataFrame) -> DataFrame:
    """(idx, reg): the registers that each instruction reads."""
    own = F.array_distinct(F.array_compact(F.transform("register_changes", lambda c: taint_register(c["register"]))))
    reads = read_registers(F.col("mnemonic"), F.col("operands"), own)
    return instruction.select("idx", F.explode(reads).alias("reg"))


def definitions_of(uses: DataFrame, writes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(idx, reg, def_idx): the last write of ``reg`` before each use, or null. Uses are (idx, reg)."""
    marks = write_postings(writes).select("idx", F.col("analysis_reg").alias("reg"), F.lit(1).alias("is_write"))
    # At one position the use comes before the write, which it doesn't see.
    both = uses.select("idx", "reg", F.lit(0).alias("is_write")).unionByName(marks)
    found = carried_last(both, ["reg"], "idx", ["idx", "is_write"], {"def_idx": F.when(F.col("is_write") == 1, F.col("idx"))}, chunk=chunk)
    return found.where("is_write = 0").select("idx", "reg", "def_idx")


def def_use(instruction: DataFrame, writes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The table ``def_use``: every use of a register and the write it sees."""
    return definitions_of(register_uses(instruction), writes, chunk)
