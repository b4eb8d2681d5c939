"""Register names: the three ways in which the analyses merge them, aliases, widths, and display order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .patterns import OPERAND_REGISTER, ZERO_REGISTERS
from .u64 import let, strip

#: Registers that a state display shows, in its order.
DISPLAYED = ("SP", "FP", "LR", *(f"X{n}" for n in range(30, -1, -1)))


def _x_name(name: Column) -> Column:
    return F.regexp_replace(name, r"^W(\d+)$", "X$1")


def is_w(name: Column) -> Column:
    return name.rlike(r"^W\d+$")


def state_register(name: Column) -> Column:
    """The cell that a write to ``name`` changes: Wn is the low half of Xn, all else stands for itself."""
    return _x_name(name)


def taint_register(name: Column) -> Column:
    """``name`` as data flow sees it: FP is X29, LR is X30, Wn is Xn; zero and other registers are NULL."""
    of = lambda n: F.when(n == "FP", "X29").when(n == "LR", "X30").when((n == "SP") | n.rlike(r"^X\d+$"), n)
    return let(_x_name(F.upper(strip(name))), of)


def analysis_register(name: Column) -> Column:
    """As ``taint_register``, for X0 to X30 and SP alone."""
    of = lambda n: F.when((n == "SP") | F.regexp_extract(n, r"^X0*(\d+)$", 1).rlike(r"^([0-9]|[12][0-9]|30)$"), n)
    return let(taint_register(name), of)


def alias_of(name: Column) -> Column:
    """Where a value is looked up if not under ``name``: Xn and Wn for each other, X29 for FP, X30 for LR."""
    number = F.substring(name, 2, 10)
    return (
        F.when(name == "FP", "X29").when(name == "LR", "X30")
        .when(name.rlike(r"^X\d+$"), F.concat(F.lit("W"), number)).when(name.rlike(r"^W\d+$"), F.concat(F.lit("X"), number))
    )


def related(name: str) -> list[str]:
    """Every name of the register, its own first."""
    name = (name or "").strip().upper()
    pairs = {"FP": "X29", "X29": "FP", "LR": "X30", "X30": "LR"}
    out = [name] if name else []
    out += [pairs[name]] if name in pairs else []
    if name[:1] in ("X", "W") and name[1:].isdigit():
        out.append(("W" if name[0] == "X" else "X") + name[1:])
    return out


def taint_name(name: str) -> str | None:
    """``taint_register`` of a name on the driver."""
    name = (name or "").strip().upper()
    name = {"FP": "X29", "LR": "X30"}.get(name, name)
    if name in ZERO_REGISTERS:
        return None
    if name[:1] in ("X", "W") and name[1:].isdigit():
        return f"X{name[1:]}"
    return name if name == "SP" else None


def width_bytes(name: Column) -> Column:
    """How many bytes a register holds, by its upper-case name."""
    first = F.substring(name, 1, 1)
    return (
        F.when(name.isin("SP", "FP", "LR") | name.rlike(r"^X\d+$"), 8).when(name.rlike(r"^W\d+$"), 4)
        .when(first == "Q", 16).when(first == "D", 8).when(first == "S", 4).when(first == "H", 2).when(first == "B", 1).otherwise(8)
    )


def operand_registers(operand: Column) -> Column:
    """The distinct registers that an operand names, as data flow sees them."""
    found = F.regexp_extract_all(operand, F.lit(OPERAND_REGISTER), 1)
    return F.array_distinct(F.array_compact(F.transform(found, taint_register)))


def read_registers(mnemonic: Column, operands: Column, writes: Column) -> Column:
    """Sorted registers that an instruction reads, given the array of those it writes.

    A register in a destination place that is written isn't read, even if it is a source as well."""
    tokens = F.filter(F.transform(F.split(operands, ","), strip), lambda t: t != "")
    return let(F.transform(tokens, operand_registers), lambda each: _read(mnemonic, each, writes))


def _read(mnemonic: Column, each: Column, writes: Column) -> Column:
    m = F.lower(mnemonic)
    places = F.when(m.startswith("st"), 0).when(m.startswith("ldp") | m.startswith("ldnp"), 2).otherwise(1)
    targets = F.flatten(F.slice(each, F.lit(1), F.least(places, F.size(each))))
    out = F.array_except(F.array_distinct(F.flatten(each)), F.array_intersect(targets, writes))
    return F.coalesce(F.array_sort(out), F.array().cast("array<string>"))


def display_order(name: Column) -> Column:
    """Sorts as a state display lists registers: SP, FP, LR, PC, X30 down to X0, zero registers, others."""
    number = F.when(name.rlike(r"^[XW]\d{1,9}$"), -F.regexp_extract(name, r"^[XW](\d{1,9})$", 1).cast("int"))
    special = F.array_position(F.array(*map(F.lit, ("SP", "FP", "LR", "PC"))), name).cast("int")
    group = F.when(special > 0, 0).when(number.isNotNull(), 1).when(name.isin("XZR", "WZR"), 2).otherwise(3)
    return F.struct(group.alias("group"), F.when(special > 0, special).otherwise(F.coalesce(number, F.lit(0))).alias("place"), F.when(group == 3, name).alias("name"))


def displayed_registers(spark: SparkSession) -> DataFrame:
    """(register) for the 34 registers of a state display."""
    return spark.createDataFrame([(r,) for r in DISPLAYED], "register string")
