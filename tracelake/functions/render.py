"""How addresses, memory values and rows are shown. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parse import spaced_hex
from .patterns import ASSIGNMENT, STRING_HINT
from .u64 import index_value, let, strip, unsigned

#: Where an address that isn't hexadecimal sorts.
LAST = (1 << 63) - 1


def digits(address: Column) -> Column:
    """An address as text, trimmed, in lower case, without 0x."""
    return F.regexp_replace(F.lower(strip(F.coalesce(address, F.lit("")))), "^0x", "")


def shown_address(address: Column) -> Column:
    """An address in lower case with 0x; an empty one stays empty."""
    text = F.lower(strip(F.coalesce(address, F.lit(""))))
    return F.when((text == "") | F.startswith(text, F.lit("0x")), text).otherwise(F.concat(F.lit("0x"), text))


def address_order(address: Column) -> Column:
    return F.coalesce(unsigned(index_value(address)), F.lit(LAST).cast("decimal(20,0)"))


def instruction_text(mnemonic: Column, operands: Column) -> Column:
    return strip(F.concat(mnemonic, F.lit(" "), operands))


def _lowered(token: Column) -> Column:
    return F.when(token.rlike("^0[xX]"), F.lower(token)).otherwise(token)


def _prefixed(token: Column) -> Column:
    """As the memory panel shows a token: lower case, 0x before bare digits."""
    token = strip(token)
    return F.when(token.rlike("^0[xX]"), F.lower(token)).when(token.rlike("^[0-9a-fA-F]+$"), F.concat(F.lit("0x"), F.lower(token))).otherwise(token)


def memory_value(raw: Column, panel: bool = False) -> Column:
    """(value, detail): the assigned values of a text, or the text; detail is the text if it assigns any."""
    text, one = strip(raw), _prefixed if panel else _lowered
    values = F.regexp_extract_all(text, F.lit(ASSIGNMENT), 2)
    some = F.size(values) > 0
    value = F.when(F.coalesce(raw, F.lit("")) == "", "?").when(some, F.array_join(F.transform(values, one), ", ")).otherwise(one(text))
    return F.struct(value.alias("value"), F.when(some, text).otherwise("").alias("detail"))


def value_with_detail(raw: Column) -> Column:
    return let(memory_value(raw), _with_detail)


def _with_detail(shown: Column) -> Column:
    return F.when((shown["detail"] == "") | (shown["detail"] == shown["value"]), shown["value"]).otherwise(F.concat(shown["value"], F.lit(" ("), shown["detail"], F.lit(")")))


def memory_summary(operations: Column, dump: Column, comment: Column) -> Column:
    """(memory_address, data): the first three operations; else dump addresses and the first line's first
    16 bytes; else the comment. ``-`` stands for nothing, ``...`` for what is left out."""
    more = lambda rows, joined, sep: F.when(F.size(rows) > 3, F.concat(joined, F.lit(f"{sep}..."))).otherwise(joined)
    listed = lambda rows, f, sep: more(rows, F.array_join(F.transform(F.slice(rows, 1, 3), f), sep), sep)
    access = lambda o: F.concat(F.when(o["type"] == "read", "R:").otherwise("W:"), value_with_detail(o["data_value"]))
    first = F.get(dump, F.lit(0))["data"]
    held = F.concat(F.array_join(F.slice(first, 1, 16), " "), F.when(F.size(first) > 16, " ...").otherwise(""))
    said = strip(F.coalesce(comment, F.lit("")))
    either = lambda ops, dumped, none: F.when(F.size(operations) > 0, ops).when(F.size(dump) > 0, dumped).otherwise(none)
    or_dash = lambda text: F.when(text == "", "-").otherwise(text)
    return F.struct(
        either(listed(operations, lambda o: shown_address(o["address"]), ", "), listed(dump, lambda d: shown_address(d["address"]), ", "), F.lit("-")).alias("memory_address"),
        either(listed(operations, access, " | "), or_dash(held), or_dash(said)).alias("data"),
    )


def string_annotations(line: Column) -> Column:
    """Distinct ``R: "text" (bytes)`` of the string hints on a line."""
    zipped = F.arrays_zip(F.regexp_extract_all(line, F.lit(STRING_HINT), 1).alias("r"), F.regexp_extract_all(line, F.lit(STRING_HINT), 2).alias("s"))
    return F.array_distinct(F.transform(zipped, lambda z: F.concat(F.upper(z["r"]), F.lit(': "'), z["s"], F.lit('" ('), spaced_hex(z["s"]), F.lit(")"))))


def ascii_text(data: Column) -> Column:
    """Dump bytes (two digits each) as characters 32 to 126, others as dots."""

    def one(byte: Column) -> Column:
        code = F.conv(byte, 16, 10).cast("int")
        return F.when(code.between(32, 126), F.char(code)).otherwise(".")

    return F.array_join(F.transform(data, one), "")


def memory_panel(operations: Column, dump: Column, line: Column) -> Column:
    """What a memory panel lists: dump lines with their characters, else operations; then string annotations."""
    dumped = F.transform(dump, lambda d: F.concat(F.when(d["is_modified"], "*").otherwise(" "), shown_address(d["address"]), F.lit("  "), F.array_join(d["data"], " "), F.lit("  |"), ascii_text(d["data"]), F.lit("|")))
    listed = F.transform(operations, lambda o: F.concat(F.when(o["type"] == "read", "R ").otherwise("W "), shown_address(o["address"]), F.lit(" size "), o["data_size"].cast("string"), F.lit(": "), memory_value(o["data_value"], panel=True)["value"]))
    return F.array_join(F.concat(F.when(F.size(dump) > 0, dumped).otherwise(listed), string_annotations(line)), "\n")


def fixed_width(*cols: tuple[Column, int]) -> Column:
    """Columns cut or padded to widths, with a blank between."""
    return F.concat_ws(" ", *[F.rpad(F.substring(c.cast("string"), 1, n), n, " ") for c, n in cols])
