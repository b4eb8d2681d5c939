"""Searches over a trace: the next match after a position, and all matches of an address, offset, mnemonic or datum.

Searches look into the narrow tables first, where there are any: what those give bounds the positions at which the wide
table ``instruction`` is read, and the search's own condition is then tested on what was read."""

from __future__ import annotations

from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse, terms
from ..functions.patterns import SCOPES
from ..functions.recipe import applied
from ..functions.render import address_order, digits, instruction_text, memory_summary, shown_address, value_with_detail
from ..sources.files import saved
from . import grams, pages
from .lookup import ranges_of, rows_at, within


def _number(digit_text: str) -> int:
    """The bit pattern of hexadecimal digits; beyond 64 bits nothing matches, so -1 (which no index holds)."""
    value = int(digit_text, 16)
    return -1 if value >= 1 << 64 else value - (1 << 64) if value >= 1 << 63 else value


def next_of(matches: DataFrame, start: int) -> DataFrame:
    """One row (idx): the smallest position at or after ``start``, or else the smallest of all. No match, no row."""
    order = F.struct((F.col("idx") < start).alias("before"), F.col("idx").alias("idx"))
    return matches.agg(F.min_by("idx", order).alias("idx")).where("idx is not null")


def next_by_address(instruction: DataFrame, term: str, start: int, by_address: DataFrame | None = None) -> DataFrame:
    """The next instruction at an address (0x and eight digits or more) that its line writes in lower case.

    ``by_address``: the narrow table, which is sorted by address and has Bloom filters of it, so that a file is read
    only where it may hold the address."""
    text = terms.exact_address(term)
    if by_address is not None:
        return next_of(by_address.where(F.lit(bool(text)) & (F.col("address") == text)).select("idx"), start)
    rows = instruction.where(F.lit(bool(text)) & (F.lower("address") == text) & F.col("raw_line").contains(text))
    return next_of(rows.select("idx"), start)


def at_offset(instruction: DataFrame, term: str) -> DataFrame:
    """The rows at a module offset, by its number; of ``instruction`` or of the narrow table ``by_offset``."""
    text = terms.hex_term(term)
    return instruction.where(F.col("offset_val") == _number(text)) if text else instruction.limit(0)


def next_by_offset(instruction: DataFrame, term: str, start: int) -> DataFrame:
    return next_of(at_offset(instruction, term).select("idx"), start)


def with_address_prefix(accesses: DataFrame, term: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Accesses whose address begins with the digits of ``term``, as a number and as the log writes it; of some kinds
    (R, W, D, D*) or of all."""
    text = terms.address_digits(term)
    accesses = accesses.where(F.col("kind").isin(*kinds)) if kinds else accesses
    rows = accesses.where(F.col("addr_hex").startswith(text) & digits(F.col("address")).startswith(text) & F.lit(bool(text)))
    # The bucket follows from the prefix; it lets a store by bucket be pruned.
    return rows.where(F.col("bucket") == text[:6]) if len(text) >= 6 else rows


def next_by_memory_address(accesses: DataFrame, term: str, start: int) -> DataFrame:
    text = terms.address_digits(term)
    return next_of(accesses.where(F.col("addr_hex").startswith(text)).select("idx"), start)


def memory_address_contains(term: str) -> Column:
    """Whether any memory address of an instruction contains the term, as typed or without 0x."""
    lowered, text = (term or "").lower(), terms.address_digits(term)

    def hit(address: Column) -> Column:
        value = F.lower(F.trim(address))
        found = value.contains(lowered)
        return (value != "") & (found | F.regexp_replace(value, "^0x", "").contains(text) if text else found)

    return F.exists("memory_ops", lambda o: hit(o["address"])) | F.exists("memory_dump", lambda d: hit(d["address"]))


def next_by_text(instruction: DataFrame, term: str, start: int) -> DataFrame:
    """The next instruction whose address, offset or (for an address-like term) memory addresses contain the term."""
    lowered = (term or "").lower()
    hit = F.lower("address").contains(lowered) | F.lower("offset").contains(lowered)
    if terms.is_address(term):
        hit = hit | memory_address_contains(term)
    return next_of(instruction.where(hit).select("idx"), start)


def find_next(instruction: DataFrame, accesses: DataFrame, term: str, start: int, by_offset: DataFrame | None = None, by_address: DataFrame | None = None) -> DataFrame:
    """One row (idx, how) for a free term: by exact address, then module offset, then memory address, then text.

    An address-like term with 0x is not sought as text. ``by_offset``, ``by_address``: the narrow tables, if there are any."""
    term, start = (term or "").strip(), max(0, start)
    ways: list[tuple[str, DataFrame]] = []
    if terms.exact_address(term):
        ways.append(("address", next_by_address(instruction, term, start, by_address)))
    if term.lower().startswith("0x"):
        ways.append(("offset", next_by_offset(instruction if by_offset is None else by_offset, term, start)))
    if terms.is_address(term):
        ways.append(("memory", next_by_memory_address(accesses, term, start)))
    if term and not (terms.is_address(term) and term.lower().startswith("0x")):
        ways.append(("text", next_by_text(instruction, term, start)))
    rows = instruction.select("idx").limit(0).select("idx", F.lit(0).alias("place"), F.lit("").alias("how"))
    for place, (how, found) in enumerate(ways):
        rows = rows.unionByName(found.select("idx", F.lit(place).alias("place"), F.lit(how).alias("how")))
    return rows.agg(F.min_by("idx", "place").alias("idx"), F.min_by("how", "place").alias("how")).where("idx is not null")


def _described(rows: DataFrame) -> DataFrame:
    summary = memory_summary(F.col("memory_ops"), F.col("memory_dump"), F.col("comment"))
    return rows.select(
        F.col("idx").alias("index"), (F.col("idx") + 1).alias("line"), shown_address(F.col("address")).alias("instruction_address"), shown_address(F.col("offset")).alias("offset"),
        "mnemonic", instruction_text(F.col("mnemonic"), F.col("operands")).alias("instruction_text"), *[c for c in ("match_scope", "place") if c in rows.columns], summary.alias("s"),
    ).select("*", "s.memory_address", "s.data").drop("s")


def all_by_address(instruction: DataFrame, accesses: DataFrame, term: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Every access whose address begins with ``term``: index, line, instruction_address, access, memory_address, data."""
    hits = with_address_prefix(accesses, term, kinds).select("idx", F.col("kind").alias("access"), F.col("address").alias("memory"), "data_value")
    rows = hits.join(instruction.select("idx", "address"), "idx")
    data = F.when(F.col("access").isin("R", "W"), value_with_detail(F.col("data_value"))).otherwise(F.col("data_value"))
    out = rows.select(F.col("idx").alias("index"), (F.col("idx") + 1).alias("line"), shown_address(F.col("address")).alias("instruction_address"), "access", shown_address(F.col("memory")).alias("memory_address"), data.alias("data"))
    return out.orderBy(address_order(F.col("memory_address")), address_order(F.col("instruction_address")), "line", "access")


def candidates_by_address(buckets: DataFrame, term: str) -> DataFrame:
    """One row (n, first_idx, last_idx): how many accesses lie in the buckets that a prefix touches, and where, by their directory."""
    touched = buckets.where(F.col("bucket").startswith(terms.address_digits(term)[:6]))
    return touched.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("first_idx").alias("first_idx"), F.max("last_idx").alias("last_idx"))


def all_by_offset(instruction: DataFrame, term: str, by_offset: DataFrame | None = None) -> DataFrame:
    """Every instruction at a module offset, in trace order. ``by_offset``: the narrow table, if there is one."""
    if by_offset is not None:
        instruction = rows_at(instruction, at_offset(by_offset, term).select("idx"))
    return _described(at_offset(instruction, term)).orderBy("index")


def count_by_offset(by_offset: DataFrame, term: str, ranks: DataFrame | None = None) -> DataFrame:
    """(n), from the directory ``offset_rank`` if there is one."""
    return at_offset(by_offset, term).agg(F.count("*").alias("n")) if ranks is None else at_offset(ranks, term).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def nth_by_offset(by_offset: DataFrame, term: str, n: int, ranks: DataFrame | None = None) -> DataFrame:
    """(idx) of the n-th instruction (from 0) at an offset. ``ranks``: the directory ``offset_rank``, else it is computed."""
    return _postings_by_offset(by_offset, ranks, term, n, 1).select("idx")


def page_by_offset(instruction: DataFrame, by_offset: DataFrame, term: str, top: int, count: int, ranks: DataFrame | None = None) -> DataFrame:
    """Rows ``top`` (from 0) to ``top + count`` of ``all_by_offset``, without those before them."""
    return _page(instruction, _postings_by_offset(by_offset, ranks, term, top, count))


def _postings_by_offset(by_offset: DataFrame, ranks: DataFrame | None, term: str, top: int, count: int) -> DataFrame:
    text, by_offset = terms.hex_term(term), at_offset(by_offset, term)
    ranks = pages.ranks(by_offset, "offset_val") if ranks is None else at_offset(ranks, term)
    keys = by_offset.sparkSession.createDataFrame([(_number(text), 0)] if text else [], "offset_val long, place long")
    return pages.postings_between(by_offset, ranks, keys, top, count)


def _page(instruction: DataFrame, postings: DataFrame) -> DataFrame:
    """The instructions at (idx, number), which are as many as a page has, in the order of number."""
    found = [tuple(r) for r in postings.collect()]
    spark = instruction.sparkSession
    rows = instruction.where(within(F.col("idx"), ranges_of(spark.createDataFrame([(i,) for i, _ in found], "idx long"))))
    place = spark.createDataFrame(found, "idx long, place long")
    return _described(rows.join(F.broadcast(place), "idx")).orderBy("place").drop("place")


def matching_mnemonics(mnemonics: DataFrame, term: str) -> DataFrame:
    """The rows of the table ``mnemonic`` that begin with a prefix, which may end in ``*``."""
    prefix = terms.mnemonic_prefix(term)
    return mnemonics.where(F.lower("mnemonic").startswith(prefix) & F.lit(bool(prefix)))


def count_by_mnemonic(mnemonics: DataFrame, term: str) -> DataFrame:
    return matching_mnemonics(mnemonics, term).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def all_by_mnemonic(instruction: DataFrame, mnemonics: DataFrame, term: str, ranks: DataFrame | None = None) -> DataFrame:
    """Every instruction whose mnemonic has a prefix, by first appearance of the mnemonic, then trace order.

    ``ranks``: the directory ``mnemonic_rank``, by which only those chunks of positions are read that hold some."""
    wanted = matching_mnemonics(mnemonics, term).select("mnemonic", F.col("first_idx").alias("place"))
    if ranks is not None:
        instruction = rows_at(instruction, ranks.join(F.broadcast(wanted), "mnemonic").select("chunk"), pages.RANK_CHUNK)
    prefix = terms.mnemonic_prefix(term)
    rows = instruction.where(F.lower("mnemonic").startswith(prefix)).join(wanted, "mnemonic")
    return _described(rows).orderBy("place", "index").drop("place")


def nth_by_mnemonic(by_mnemonic: DataFrame, mnemonics: DataFrame, term: str, n: int, ranks: DataFrame | None = None) -> DataFrame:
    """(idx) of the n-th match (from 0) in that order. ``ranks``: the directory ``mnemonic_rank``, else it is computed."""
    return _postings_by_mnemonic(by_mnemonic, ranks, mnemonics, term, n, 1).select("idx")


def page_by_mnemonic(instruction: DataFrame, by_mnemonic: DataFrame, mnemonics: DataFrame, term: str, top: int, count: int, ranks: DataFrame | None = None) -> DataFrame:
    """Rows ``top`` (from 0) to ``top + count`` of ``all_by_mnemonic``, without those before them."""
    return _page(instruction, _postings_by_mnemonic(by_mnemonic, ranks, mnemonics, term, top, count))


def _postings_by_mnemonic(by_mnemonic: DataFrame, ranks: DataFrame | None, mnemonics: DataFrame, term: str, top: int, count: int) -> DataFrame:
    keys = matching_mnemonics(mnemonics, term).select("mnemonic", F.col("first_idx").alias("place"))
    by_mnemonic = by_mnemonic.where(F.lower("mnemonic").startswith(terms.mnemonic_prefix(term)))
    ranks = pages.ranks(by_mnemonic, "mnemonic") if ranks is None else ranks
    return pages.postings_between(by_mnemonic, ranks, keys, top, count)


def _scopes(term: str, operations: str = "memory_ops") -> dict[str, Column]:
    """Whether a datum occurs in the comment, operands, memory data, dump and raw line."""
    tokens = terms.data_tokens(term)
    compact, spaced = [t for t in tokens if " " not in t], [t for t in tokens if " " in t]
    bare = [t for t in compact if not t.startswith("0x")]

    def any_of(text: Column, wanted: list[str]) -> Column:
        hit = F.lit(False)
        for token in wanted:
            hit = hit | F.coalesce(F.lower(text).contains(token), F.lit(False))
        return hit

    dumped = F.exists("memory_dump", lambda d: any_of(F.array_join(d["data"], " "), spaced) | any_of(F.array_join(d["data"], ""), bare))
    memory = F.exists(operations, lambda o: any_of(o["data_value"], compact))
    return {"comment": any_of(F.col("comment"), compact), "operands": any_of(F.col("operands"), compact), "memory": memory, "dump": dumped, "raw": any_of(F.col("raw_line"), tokens)}


def match_scope(term: str) -> Column:
    """Where a datum occurs: comment, operands, memory data, dump, joined by `` / ``; the raw line if nowhere else."""
    scopes = _scopes(term)
    raw = scopes.pop("raw")
    found = F.array_compact(F.array(*[F.when(hit, SCOPES[name]) for name, hit in scopes.items()]))
    return F.when(F.size(found) > 0, F.array_join(found, " / ")).when(raw, SCOPES["raw"])


def _contains(token: str, line: Column) -> Column:
    return line.contains(token)


def all_by_data(instruction: DataFrame, term: str, by_gram: DataFrame | None = None, gram: DataFrame | None = None) -> DataFrame:
    """Every instruction in whose lines a datum's tokens occur (in lower case), with ``match_scope``, in trace order.

    ``by_gram``, ``gram``: the index over the text of lines, by which only blocks that may hold a token are read. All lines
    are read without it, or where a token is too short for it."""
    rows = _with_data(instruction, term, by_gram, gram).withColumn("match_scope", match_scope(term)).where("match_scope is not null")
    return _described(rows).orderBy("line", address_order(F.col("instruction_address")))


def _with_data(rows: DataFrame, term: str, by_gram: DataFrame | None, gram: DataFrame | None) -> DataFrame:
    """The rows in whose lines a datum's tokens occur."""
    tokens = terms.data_tokens(term)
    blocks = grams.candidate_blocks(by_gram, gram, tokens) if by_gram is not None and gram is not None else None
    if blocks is not None:
        rows = rows_at(rows, blocks, grams.BLOCK)
    hit = F.lit(False)
    for token in tokens:
        hit = hit | F.exists("raw_lines", partial(_contains, token))
    return rows.where(hit)


def places_by_data(rows: DataFrame, term: str, by_gram: DataFrame | None = None, gram: DataFrame | None = None) -> DataFrame:
    """(idx) of the instructions that ``all_by_data`` finds, in no order; ``rows`` are of ``instruction`` or ``listing``.

    Of a listing's rows those are written that have a hit, and what they imply follows for those alone whose hit is in no
    column that they have."""
    whole = "memory_ops" in rows.columns
    scopes = _scopes(term, "memory_ops" if whole else "stated")
    # The line first: mostly it tells.
    found = reduce(or_, (scopes[name] for name in ("raw", "comment", "operands", "dump", "memory")))
    hits = _with_data(rows, term, by_gram, gram)
    if whole:
        return hits.where(found).select("idx")
    implied = F.when(~found, F.struct("raw_line", "mnemonic", "operands", "address"))
    hits = saved(hits.where(found | (F.size("stated") == 0)).select("idx", implied.alias("of")), "hits")
    sure, open_ = hits.where("of is null").select("idx"), hits.where("of is not null").select("idx", "of.*")
    if open_.isEmpty():
        return sure
    # Written, because a condition on what follows in so many steps would be worked out for each of its terms.
    rest = saved(applied(open_, parse.with_effects).select("idx", F.array_compact(F.array("inferred")).alias("memory_ops")), "implied")
    return sure.unionByName(rest.where(_scopes(term)["memory"]).select("idx"))


def limited(matches: DataFrame, n: int | None) -> tuple[DataFrame, bool]:
    """The first ``n`` matches (all, if None) and whether more were left out."""
    if n is None:
        return matches, False
    return matches.limit(n), len(matches.limit(n + 1).select(F.lit(1)).collect()) > n


def sorted_by(matches: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """A result in the order of one column: numbers and addresses as such, texts in lower case; equal ones in trace order."""
    kind = dict(matches.dtypes)[column]
    key = F.lower(column) if kind == "string" else F.col(column)
    key = address_order(F.col(column)) if "address" in column or column == "offset" else key
    return matches.orderBy(key.desc() if descending else key.asc(), *[c for c in ("index",) if c in matches.columns])


def result_page(matches: DataFrame, top: int, count: int) -> DataFrame:
    """``count`` rows of an ordered result from row ``top`` (from 0) on."""
    return matches.offset(max(0, top)).limit(count)


def page(instruction: DataFrame, top: int, count: int) -> DataFrame:
    """(num, address, offset, mnemonic, operands, comment) of ``count`` instructions from ``top`` on."""
    rows = instruction.where(F.col("idx").between(max(0, top), max(0, top) + count - 1)).orderBy("idx")
    return rows.select((F.col("idx") + 1).alias("num"), "address", "offset", "mnemonic", "operands", "comment")
