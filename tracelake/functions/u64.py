"""Unsigned 64-bit numbers as bit patterns of LONG, in built-in expressions only.

Text that is no number gives NULL; digits beyond 64 bits are dropped from the left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW = 0xFFFFFFFF
BLANKS = " \t\n\x0b\f\r"
_TWO_64 = "18446744073709551616"


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip(text: Column) -> Column:
    """``text`` without ASCII white space at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def _digits(hex_digits: Column) -> Column:
    """Hexadecimal digits (known to be such) as a bit pattern."""
    return F.conv(F.right(F.concat(F.lit("0"), hex_digits), F.lit(16)), 16, -10).cast("long")


def hex_value(text: Column) -> Column:
    """``text`` read in base 16 whether or not it begins with 0x; NULL if it isn't hexadecimal."""
    return _digits(F.nullif(F.regexp_extract(strip(text), r"^(?:0[xX])?([0-9a-fA-F]+)$", 1), F.lit("")))


def index_value(text: Column) -> Column:
    """As ``hex_value``, but NULL beyond 64 bits and for the largest number, as an index has it."""
    body = F.regexp_extract(strip(text), r"^(?:0[xX])?0*([0-9a-fA-F]+)$", 1)
    return let(body, lambda body: F.when((body != "") & (F.length(body) <= 16) & (F.lower(body) != "f" * 16), _digits(body)))


def auto_value(text: Column) -> Column:
    """``text`` as a number in the base that its prefix names (0x, 0o, 0b, else 10), with an optional sign,
    modulo 2^64; a trailing ``!`` and a leading ``#`` don't count. NULL if it isn't a number."""
    return let(_token(text), lambda token: let(_body(token), lambda body: _signed(_unsigned_number(body), token)))


def with_numbers(rows: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Adds ``auto_value`` of columns of text, for each new name the column that it is read from; step by step in columns
    of their own, which are compiled."""
    rows = rows.withColumns({f"_token_{n}": _token(F.col(c)) for n, c in texts.items()})
    rows = rows.withColumns({f"_body_{n}": _body(F.col(f"_token_{n}")) for n in texts})
    rows = rows.withColumns({f"_number_{n}": _unsigned_number(F.col(f"_body_{n}")) for n in texts})
    return rows.withColumns({n: _signed(F.col(f"_number_{n}"), F.col(f"_token_{n}")) for n in texts}).drop(*[f"_{k}_{n}" for n in texts for k in ("token", "body", "number")])


def _token(text: Column) -> Column:
    text = F.rtrim(strip(text), F.lit("!" + BLANKS))
    return F.lower(strip(F.when(text.startswith("#"), F.substring(text, 2, 1 << 30)).otherwise(text)))


def _body(token: Column) -> Column:
    return F.when(token.startswith("+") | token.startswith("-"), F.substring(token, 2, 1 << 30)).otherwise(token)


def _unsigned_number(body: Column) -> Column:
    begins = lambda mark: F.startswith(body, F.lit(mark))
    rest = F.substring(body, 3, 1 << 30)
    based = lambda digits, most, base: F.when(rest.rlike(f"^[{digits}]+$"), F.conv(F.right(rest, F.lit(most)), base, -10).cast("long"))
    wide = F.conv(F.pmod(body.cast("decimal(38,0)"), F.lit(_TWO_64).cast("decimal(38,0)")).cast("string"), 10, -10).cast("long")
    plain = F.when(body.rlike("^(?:0+|[1-9][0-9]{0,37})$"), F.when(F.length(body) <= 18, body.cast("long")).otherwise(wide))
    return F.when(begins("0x"), based("0-9a-f", 16, 16)).when(begins("0o"), based("0-7", 21, 8)).when(begins("0b"), based("01", 64, 2)).otherwise(plain)


def _signed(number: Column, token: Column) -> Column:
    return F.when(F.startswith(token, F.lit("-")), wrap_subtract(F.lit(0).cast("long"), number)).otherwise(number)


def to_hex(value: Column) -> Column:
    """``0x`` and lower-case digits."""
    return F.concat(F.lit("0x"), F.lower(F.hex(value)))


def wrap_add(a: Column, b: Column) -> Column:
    """a + b modulo 2^64, by halves: plain addition raises an error where it overflows. Both are written out several
    times, so they had better be columns."""
    mask = F.lit(LOW)
    low = a.bitwiseAND(mask) + b.bitwiseAND(mask)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high.bitwiseAND(mask), 32).bitwiseOR(low.bitwiseAND(mask))


def wrap_subtract(a: Column, b: Column) -> Column:
    """a - b modulo 2^64, by halves likewise."""
    mask = F.lit(LOW)
    low = a.bitwiseAND(mask) - b.bitwiseAND(mask)
    high = F.shiftrightunsigned(a, 32) - F.shiftrightunsigned(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high.bitwiseAND(mask), 32).bitwiseOR(low.bitwiseAND(mask))


def shift_left(value: Column, by: Column) -> Column:
    """value * 2^by modulo 2^64; zero from 64 on."""
    return F.when(by >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", value, by.cast("int")))


def sign_extend_32(value: Column) -> Column:
    return F.shiftright(F.shiftleft(value, 32), 32)


def unsigned(value: Column) -> Column:
    """A number that orders as the unsigned value does."""
    number = value.cast("decimal(20,0)")
    return F.when(value < 0, number + F.lit(_TWO_64).cast("decimal(20,0)")).otherwise(number)


def hex_text(token: Column) -> Column:
    """32 digits, most significant first, of a number of up to 128 bits in text; NULL if it isn't one."""
    def of(token: Column) -> Column:
        body = F.regexp_extract(token, r"^\+?0x([0-9a-f]+)$", 1)
        return F.when(body != "", F.lpad(F.right(body, F.lit(32)), 32, "0")).otherwise(_widened(auto_value(token), F.startswith(token, F.lit("-"))))

    return let(F.lower(strip(F.regexp_replace(strip(F.regexp_replace(strip(token), ",+$", "")), "^#", ""))), of)


def _widened(value: Column, negative: Column) -> Column:
    return F.concat(F.repeat(F.when(negative, "f").otherwise("0"), F.lit(16)), F.lpad(F.lower(F.hex(value)), 16, "0"))


def little_endian(digits: Column, size: Column) -> Column:
    """The lowest ``size`` bytes of 32 hexadecimal digits, lowest byte first."""
    pairs = F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), 1))
    return F.array_join(F.slice(pairs, F.lit(1), F.least(size, F.lit(16)).cast("int")), "")
