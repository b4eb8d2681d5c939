"""Trace lines as columns: fields, register changes, snapshots and memory operations.

A set of assignments is a struct of two arrays, ``names`` and ``vals``, latest first, so that the first
entry of a name counts. Patterns follow Java's ASCII classes. What several results need is a column of its
own, and cheap tests stand before patterns, so that a line is looked through once for each kind of thing."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .registers import alias_of, width_bytes
from .u64 import auto_value, shift_left, sign_extend_32, strip, to_hex, with_numbers, wrap_add


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``; null if there is none."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def assigned(names: Column, vals: Column) -> Column:
    """From names and values, latest first."""
    return F.struct(names.alias("names"), vals.alias("vals"))


_NONE = "cast(named_struct('names', array(), 'vals', array()) as struct<names:array<string>,vals:array<string>>)"


def _pairs(text: Column, pattern: str, mark: str) -> Column:
    """Pairs of a pattern's two groups, names in upper case; without looking where a text has no ``mark``."""
    some = assigned(F.reverse(F.transform(_all(text, pattern, 1), F.upper)), F.reverse(_all(text, pattern, 2)))
    return F.when(text.contains(mark), some).otherwise(F.expr(_NONE))


def assignments(text: Column) -> Column:
    """``R=v`` pairs, names in upper case."""
    return _pairs(text, P.ASSIGNMENT, "=")


def string_hints(text: Column) -> Column:
    """``R=v (string: "...")`` pairs of register and string."""
    return _pairs(text, P.STRING_HINT, "(string:")


def named_in_order(pairs: Column) -> Column:
    """The distinct names of assignments, in the order in which they were first named."""
    return F.array_distinct(F.reverse(pairs["names"]))


def value_of(pairs: Column, name: Column) -> Column:
    """What the last assignment of ``name`` gives; null if there is none."""
    return F.try_element_at(pairs["vals"], F.nullif(F.array_position(pairs["names"], name).cast("int"), F.lit(0)))


def _held(name: Column, before: Column, after: Column) -> list[Column]:
    """What is known of a register: before the instruction under its name or its alias, then after it."""
    return [value_of(pairs, n) for pairs in (before, after) for n in (name, alias_of(name))]


def register_number(name: Column, before: Column, after: Column) -> Column:
    """The first of that which is a number."""
    return F.get(F.array_compact(F.transform(F.array(*_held(name, before, after)), auto_value)), F.lit(0))


FIELDS = "struct<address:string,offset:string,mnemonic:string,operands:string,comment:string>"


def _fields(*cols: Column) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip(cols, ("address", "offset", "mnemonic", "operands", "comment"), strict=True)])


def with_instruction_fields(rows: DataFrame, line: str = "line", where: Column | None = None) -> DataFrame:
    """Adds ``fields`` (address, offset, mnemonic, operands, comment) of instruction lines of either dialect; null for
    other lines, and where ``where`` doesn't hold."""
    text = strip(F.col(line)) if where is None else F.when(where, strip(F.col(line)))
    rows = rows.withColumn("_line", text)
    tabbed, bracket = F.startswith("_line", F.lit("0x")), F.startswith("_line", F.lit("["))
    rows = rows.withColumns({"_parts": F.when(tabbed, F.split("_line", r"\t+")), "_rest": F.when(bracket, F.regexp_replace("_line", P.BRACKETS, ""))})
    after = F.array_join(F.slice("_parts", F.lit(3), F.greatest(F.size("_parts"), F.lit(1))), "\t")
    quoted = F.when(F.col("_rest").rlike(P.QUOTED), F.substring_index(_after(F.col("_rest"), '"'), '"', 1))
    rows = rows.withColumn("_text", F.when(tabbed, F.when(F.size("_parts") >= 3, after)).otherwise(quoted))
    rows = rows.withColumn("_words", F.split(strip(F.when(tabbed, F.substring_index("_text", ";", 1)).otherwise(F.col("_text"))), r"\s+", 2))
    mnemonic, operands = F.get("_words", F.lit(0)), F.coalesce(F.get("_words", F.lit(1)), F.lit(""))
    comment = strip(F.coalesce(_after(F.col("_text"), ";"), F.lit("")))
    address, behind = F.substring_index("_rest", ":", 1), _after(_after(F.col("_rest"), '"'), '"')
    offset = F.coalesce(F.nullif(F.regexp_extract("_line", P.BRACKET_OFFSET, 1), F.lit("")), address)
    first, second = F.get("_parts", F.lit(0)), F.get("_parts", F.lit(1))
    found = F.when(tabbed, _fields(first, second, mnemonic, operands, comment)).otherwise(_fields(address, offset, mnemonic, operands, strip(behind)))
    return rows.withColumn("fields", F.when(F.col("_text").isNotNull(), found)).drop("_line", "_parts", "_rest", "_text", "_words")


def trace_part(line: Column) -> Column:
    """What follows the quoted instruction of a bracketed line, or the line itself."""
    return strip(F.regexp_replace(strip(line), P.BEFORE_TRACE_PART, ""))


CHANGES = "array<struct<register:string,old_value:string,new_value:string>>"


def _change(register: Column, old: Column, new: Column) -> Column:
    return F.struct(register.alias("register"), old.alias("old_value"), new.alias("new_value"))


def listed_changes(text: Column) -> Column:
    """``R=a -> b`` as an array of (register, old_value, new_value)."""
    part = lambda t, g: F.regexp_extract(t, P.LEGACY_CHANGE, g)
    return F.transform(_all(text, P.LEGACY_CHANGE, 0), lambda t: _change(F.upper(part(t, 1)), part(t, 2), part(t, 3)))


def changes_between(before: Column, after: Column) -> Column:
    """Registers whose text after the instruction isn't what it was before, in the order they are named."""
    change = lambda r: _change(r, F.coalesce(value_of(before, r), F.lit("")), value_of(after, r))
    one = F.get(after["names"], F.lit(0))
    differs = F.coalesce(value_of(before, one), F.lit("")) != value_of(after, one)
    several = F.filter(F.transform(named_in_order(after), change), lambda c: c["old_value"] != c["new_value"])
    none = F.array().cast(CHANGES)
    return F.when(F.size(after["names"]) == 0, none).when(F.size(after["names"]) == 1, F.when(differs, F.array(change(one)).cast(CHANGES)).otherwise(none)).otherwise(several)


def with_snapshots(rows: DataFrame, line: str = "raw_line") -> DataFrame:
    """Adds ``changes`` and four sets of pairs: assignments before and after the instruction (``_before``,
    ``_after``), and string hints before and after it (``_before_hints``, ``_after_hints``).

    Changes are those listed after a semicolon, or else those between both sides of ``=>``. Without ``=>``
    snapshots come from what follows the semicolon: each transition gives both its sides, and a bare assignment
    counts for both sides where no transition names its register."""
    rows = rows.withColumns({"_part": trace_part(F.col(line)), "_comment": _after(strip(F.col(line)), ";")})
    both = F.col("_part").contains("=>")
    rows = rows.withColumns({
        "_left": F.when(both, F.substring_index("_part", "=>", 1)), "_right": F.when(both, _after(F.col("_part"), "=>")),
        "_said": F.when(~both, F.coalesce("_comment", F.lit(""))),
    })
    rows = rows.withColumns({
        "_left_pairs": assignments(F.col("_left")), "_right_pairs": assignments(F.col("_right")),
        "_shifts": F.when(F.col("_said").contains("->"), _all(F.col("_said"), P.TRANSITION, 0)),
        "_bare": assignments(F.when(F.col("_said").contains("->"), F.regexp_replace("_said", P.TRANSITION, " ")).otherwise(F.col("_said"))),
        "_said_hints": string_hints(F.col("_said")),
    })
    of = lambda g: F.reverse(F.transform("_shifts", lambda t: F.regexp_extract(t, P.TRANSITION, g)))
    rows = rows.withColumns({"_names": F.transform(of(1), F.upper), "_olds": of(2), "_news": of(3)})
    # The first bare assignment of a name counts; transitions come before them, latest first.
    listed = lambda vals: F.when(F.col("_shifts").isNotNull(), assigned(F.concat("_names", F.reverse("_bare.names")), F.concat(vals, F.reverse("_bare.vals")))).otherwise(assigned(F.reverse("_bare.names"), F.reverse("_bare.vals")))
    side = lambda there, here: F.when(F.col("_left").isNotNull(), there).otherwise(here)
    none = F.array().cast(CHANGES)
    changes = F.when(F.col("_comment").isNotNull(), F.when(F.col("_comment").contains("->"), listed_changes(strip(F.col("_comment")))).otherwise(none)).otherwise(side(changes_between(F.col("_left_pairs"), F.col("_right_pairs")), none))
    return rows.withColumns({
        "changes": changes, "_before": side(F.col("_left_pairs"), listed(F.col("_olds"))), "_after": side(F.col("_right_pairs"), listed(F.col("_news"))),
        "_before_hints": side(string_hints(F.col("_left")), F.col("_said_hints")), "_after_hints": side(string_hints(F.col("_right")), F.col("_said_hints")),
    }).drop("_part", "_comment", "_left", "_right", "_said", "_left_pairs", "_right_pairs", "_shifts", "_bare", "_said_hints", "_names", "_olds", "_news")


def listed_tokens(text: Column) -> Column:
    """What stands between commas, without blanks around it; empty ones are left out."""
    return F.array_remove(F.split(strip(text), r"\s*,\s*"), "")


def target_registers(operands: Column) -> Column:
    """The registers before the bracket of a memory operand, in upper case."""
    left = strip(F.rtrim(strip(F.substring_index(operands, "[", 1)), F.lit(",")))
    return F.when(operands.contains("["), listed_tokens(F.upper(left))).otherwise(F.array().cast("array<string>"))


def access_size(mnemonic: Column, targets: Column) -> Column:
    """Bytes that a load or store moves, by its mnemonic and registers."""
    m, first = F.lower(mnemonic), F.get(targets, F.lit(0))
    starts = lambda *names: reduce(or_, (m.startswith(n) for n in names))
    second = F.get(targets, F.lit(1))
    pair = width_bytes(first) + F.when(second.isNotNull(), width_bytes(second)).otherwise(0)
    width = F.when(first.isNull(), 8).otherwise(width_bytes(first))
    return F.when(starts("ldp", "stp", "ldnp", "stnp") & first.isNotNull(), pair).when(starts("ldrb", "strb"), 1).when(starts("ldrh", "strh"), 2).when(starts("ldrsw"), 4).otherwise(width)


def with_effective_address(rows: DataFrame, before: Column, after: Column) -> DataFrame:
    """Adds ``_address``, the one in the brackets of ``_operands``: base and immediate, or base and shifted index,
    modulo 2^64; null if the base has no number."""
    rows = rows.withColumn("_tokens", listed_tokens(F.regexp_extract("_operands", r"\[([^\]]*)\]", 1)))
    second = F.get("_tokens", F.lit(1))
    extend = F.lower(F.array_join(F.slice("_tokens", F.lit(3), F.greatest(F.size("_tokens"), F.lit(1))), ","))
    rows = rows.withColumns({"_first": F.upper(F.get("_tokens", F.lit(0))), "_second": second, "_index": F.when(~F.startswith(second, F.lit("#")), F.upper(second)), "_extend": extend})
    # Mostly the first text that is known of a register is a number; if it isn't, the others are tried.
    rows = rows.withColumns({
        "_base_text": F.coalesce(*_held(F.col("_first"), before, after)), "_index_text": F.coalesce(*_held(F.col("_index"), before, after)),
        "_by_text": F.regexp_extract("_extend", P.SHIFT_AMOUNT, 1), "_plain_text": F.when(F.col("_index").isNull(), F.col("_second")),
    })
    rows = with_numbers(rows, {"_base": "_base_text", "_n": "_index_text", "_by": "_by_text", "_plain": "_plain_text"})
    none = F.lit(0).cast("long")
    again = lambda number, text, name: F.coalesce(number, F.when(text.isNotNull(), register_number(name, before, after)))
    rows = rows.withColumns({"_base": again(F.col("_base"), F.col("_base_text"), F.col("_first")), "_n": F.coalesce(again(F.col("_n"), F.col("_index_text"), F.col("_index")), none), "_by": F.coalesce("_by", none)})
    low = F.col("_n").bitwiseAND(F.lit(0xFFFFFFFF))
    number = F.when(F.col("_extend").contains("sxtw"), sign_extend_32(F.col("_n"))).when(F.col("_extend").contains("uxtw") | F.col("_index").rlike(r"^W\d+$"), low).otherwise(F.col("_n"))
    rows = rows.withColumn("_n", number)
    shifted = F.when(F.col("_by") > 0, shift_left(F.col("_n"), F.col("_by"))).otherwise(F.col("_n"))
    rows = rows.withColumn("_offset", F.when(F.col("_second").isNull(), none).when(F.col("_index").isNull(), F.coalesce("_plain", none)).otherwise(shifted))
    return rows.withColumn("_address", wrap_add(F.col("_base"), F.col("_offset"))).drop("_tokens", "_first", "_second", "_index", "_extend", "_base_text", "_index_text", "_by_text", "_plain_text", "_base", "_n", "_by", "_plain", "_offset")


def spaced_hex(text: Column) -> Column:
    """A text's UTF-8 bytes as upper-case pairs of digits with blanks between."""
    return F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)(?=.)", "$1 ")


def data_values(targets: Column, before: Column, after: Column, hints: Column, of: Column) -> Column:
    """``R=v`` of the first two registers, from ``of`` or any side that has a number, with string hints in hexadecimal."""

    def one(r: Column) -> Column:
        raw = F.nullif(value_of(of, r), F.lit(""))
        raw = F.coalesce(raw, to_hex(register_number(r, before, after)))
        hint = F.nullif(value_of(hints, r), F.lit(""))
        return F.concat(r, F.lit("="), raw, F.coalesce(F.concat(F.lit(" (string_hex: "), spaced_hex(hint), F.lit(")")), F.lit("")))

    return F.concat_ws(", ", *[F.when(F.get(targets, F.lit(i)).isNotNull(), one(F.get(targets, F.lit(i)))) for i in (0, 1)])


OPERATION = "struct<type:string,address:string,instruction_address:string,data_size:int,data_value:string>"


def _operation(kind: Column, address: Column, instruction: Column, size: Column, value: Column) -> Column:
    return F.struct(kind.alias("type"), address.alias("address"), instruction.alias("instruction_address"), size.cast("int").alias("data_size"), value.alias("data_value"))


def stated_operation(line: Column) -> Column:
    """The memory operation that a line of its own states, else null."""

    def one(pattern: str, kind: str) -> Column:
        part = lambda g: F.regexp_extract(line, pattern, g)
        size = F.coalesce(F.least(part(3).try_cast("long"), F.lit(0x7FFFFFFF)), F.lit(0x7FFFFFFF))
        return F.when(line.rlike(pattern), _operation(F.lit(kind), part(1), part(2), size, part(4)))

    return F.when(F.lower(line).contains("memory "), F.coalesce(one(P.MEMORY_WRITE, "write"), one(P.MEMORY_READ, "read")))


def dump_line(line: Column) -> Column:
    """(address, data, is_modified) of a memory dump line, else null."""
    line = strip(line)
    marked = F.startswith(line, F.lit("*"))
    parts = F.split(F.when(marked, strip(F.substring(line, 2, 1 << 30))).otherwise(line), r"\s+")
    bar = F.array_position(F.transform(parts, lambda p: F.startswith(p, F.lit("|"))), F.lit(True)).cast("int")
    upto = F.when(bar > 0, bar - 1).otherwise(F.size(parts))
    data = F.filter(F.slice(parts, F.lit(2), F.greatest(upto - 1, F.lit(0))), lambda p: p.rlike(P.DUMP_BYTE))
    # What is looked at in a dump line alone stands behind its tests.
    return F.when(line.contains("|") & line.rlike(P.DUMP_LINE), F.when(F.size(parts) >= 2, F.struct(F.get(parts, F.lit(0)).alias("address"), data.alias("data"), marked.alias("is_modified"))))


def with_effects(rows: DataFrame, line: str = "raw_line") -> DataFrame:
    """Adds ``changes``, the registers that an instruction's line says it changes, and ``inferred``, the memory
    operation of a load or store from its operands and the register values of its line; null where there is none.
    Rows have ``line``, mnemonic, operands and address."""
    rows = with_snapshots(rows, line)
    m = F.lower("mnemonic")
    is_read = m.startswith("ld")
    some = (F.size("_before.names") > 0) | (F.size("_after.names") > 0)
    applies = (is_read | m.startswith("st")) & F.col("operands").contains("[") & F.col("operands").rlike(r"(?s)\[[^\]]*\]") & some
    # Only such lines' operands are looked at.
    rows = rows.withColumn("_operands", F.when(applies, F.col("operands")))
    rows = rows.withColumn("_targets", F.when(F.col("_operands").isNotNull(), target_registers(F.col("_operands"))))
    before, after = F.col("_before"), F.col("_after")
    rows = with_effective_address(rows, before, after)
    side = lambda there, here: F.when(is_read, F.col(there)).otherwise(F.col(here))
    value = data_values(F.col("_targets"), before, after, side("_after_hints", "_before_hints"), side("_after", "_before"))
    found = _operation(F.when(is_read, "read").otherwise("write"), to_hex(F.col("_address")), F.col("address"), access_size(F.col("mnemonic"), F.col("_targets")), value)
    return rows.withColumn("inferred", F.when(F.col("_address").isNotNull(), found)).drop("_before", "_after", "_before_hints", "_after_hints", "_targets", "_address", "_operands")
