"""Search terms as a user types them: what kind they are, and their normal forms. Plain Python, on the driver."""

from __future__ import annotations

import re

_HEX = re.compile(r"[0-9a-f]+")


def _body(term: str, prefix: bool) -> str:
    """The hexadecimal digits of a term, which must (or may) begin with 0x; empty if it has others."""
    text = (term or "").strip().lower()
    if prefix and not text.startswith("0x"):
        return ""
    body = text.removeprefix("0x")
    return body if _HEX.fullmatch(body) else ""


def address_digits(term: str) -> str:
    """A memory address as typed, trimmed, in lower case and without 0x."""
    return (term or "").strip().lower().removeprefix("0x")


def exact_address(term: str) -> str:
    """``0x`` and eight digits or more; else empty."""
    body = _body(term, True)
    return f"0x{body}" if len(body) >= 8 else ""


def hex_term(term: str) -> str:
    """``0x`` and digits; else empty."""
    body = _body(term, True)
    return f"0x{body}" if body else ""


def is_address(term: str) -> bool:
    return len(_body(term, False)) >= 4


def is_offset(term: str) -> bool:
    return 0 < len(_body(term, True)) < 8


def is_mnemonic(term: str) -> bool:
    return bool(re.fullmatch(r"[a-z][a-z0-9.]*\*?", (term or "").strip().lower()))


def mnemonic_prefix(term: str) -> str:
    return (term or "").strip().lower().rstrip("*")


def data_term(term: str) -> str:
    """Lower case, with 0x before what is hexadecimal all through."""
    text = (term or "").strip().lower()
    return f"0x{text}" if _HEX.fullmatch(text) else text


def data_tokens(term: str) -> list[str]:
    """What a data search looks for: the term, and of a hexadecimal one its bytes with blanks between if the
    digits are even, else its bare digits."""
    text = data_term(term)
    body = _body(text, True)
    more = [] if not body else [" ".join(re.findall("..", body))] if len(body) % 2 == 0 else [body]
    return list(dict.fromkeys(t for t in (text, *more) if t))
