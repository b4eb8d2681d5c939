"""How each table of a trace follows from others. ``of`` gives a table by its name; ``listing`` has those columns of
``instruction`` that the log states, and may be that table itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import grams, lineage, pages, tables

Of = Callable[[str], DataFrame]

DERIVED: dict[str, Callable[[Of], DataFrame]] = {
    "listing": lambda of: of("instruction"),
    "register_write": lambda of: tables.register_writes(of("instruction")),
    "register": lambda of: tables.register_directory(of("register_write")),
    "memory_access": lambda of: tables.memory_accesses(of("instruction")),
    "bucket": lambda of: tables.bucket_directory(of("memory_access")),
    "memory_def_use": lambda of: lineage.memory_def_use(of("memory_access")),
    "by_address": lambda of: tables.by_address(of("listing")),
    "by_offset": lambda of: tables.by_offset(of("listing")),
    "offset_rank": lambda of: pages.ranks(of("by_offset"), "offset_val"),
    "by_mnemonic": lambda of: tables.by_mnemonic(of("listing")),
    "mnemonic": lambda of: tables.mnemonic_counts(of("by_mnemonic")),
    "mnemonic_rank": lambda of: pages.ranks(of("by_mnemonic"), "mnemonic"),
    "by_gram": lambda of: grams.by_gram(of("listing")),
    "gram": lambda of: grams.gram_counts(of("by_gram")),
    "def_use": lambda of: tables.def_use(of("instruction"), of("register_write")),
}
