"""A trace as one object: its tables and every question about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.render import memory_panel
from ..operators import lineage, offsets, pages, search, state
from ..operators.derived import DERIVED
from ..sources import logs, store

#: How many instructions a taint slice shows, and how far provenance looks.
TAINT_STEPS, PROVENANCE_SCAN, PROVENANCE_STEPS = 500, 30000, 160


class Trace:
    """Tables of a trace by name, as attributes: those of a store, or, without one, those that follow from ``instruction``
    as they are asked for. Searches look into a store's indexes; without a store they read all instructions once."""

    def __init__(self, instruction: DataFrame | None, tables: dict[str, DataFrame] | None = None, spacing: int = 0, initial_sp: str | None = None, size: int | None = None):
        self.spacing, self.initial_sp, self._size = spacing, initial_sp, size
        self.stored = tables is not None
        self._tables = tables if self.stored else {"instruction": instruction}

    @classmethod
    def open(cls, spark: SparkSession, log: str, folder: str, spacing: int | None = None, effects: bool = True) -> Trace:
        """The trace of a log, from the store in ``folder``, which is built if it doesn't fit the log.

        Without ``effects`` a build leaves out what lines imply, which takes most of its time, until it is asked for."""
        found, manifest = store.open_store(spark, log, folder, spacing, effects)
        return cls(None, found, manifest["spacing"], manifest["initial_sp"], manifest["count"])

    @classmethod
    def of(cls, instruction: DataFrame) -> Trace:
        """A trace whose other tables follow from ``instruction`` as they are asked for."""
        return cls(instruction)

    @property
    def instruction(self) -> DataFrame:
        return self.table("instruction")

    def table(self, name: str) -> DataFrame:
        """A table by its name in ``schema.TABLES``."""
        if not self.stored and name not in self._tables:
            self._tables[name] = DERIVED[name](self.table)
        return self._tables[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in DERIVED or name in ("checkpoint", "file_part") and self.stored:
            return self.table(name)
        raise AttributeError(name)

    def _index(self, *names: str) -> list[DataFrame | None]:
        return [self.table(n) if self.stored else None for n in names]

    @classmethod
    def load(cls, spark: SparkSession, log: str) -> Trace:
        """The trace of a log without a store."""
        instruction, sp = logs.read_trace(spark, log)
        trace = cls.of(instruction)
        trace.initial_sp = sp.first()[0]
        return trace

    def count(self) -> int:
        return self.instruction.count() if self._size is None else self._size

    def at(self, idx: int) -> DataFrame:
        return self.instruction.where(F.col("idx") == idx)

    def page(self, top: int, count: int) -> DataFrame:
        return search.page(self.instruction, top, count)

    def line(self, number: int) -> DataFrame:
        """The instruction on a line, counted from 1; no row out of range."""
        return self.at(number - 1)

    def at_byte(self, offset: int, path: str | None = None) -> DataFrame:
        """(idx) of the instruction that a byte of a log file belongs to: of the first file if none is named."""
        return offsets.instruction_at(self.instruction, self.file_part, offset, path) if self.stored else logs.instruction_at_offset(self.instruction, offset)

    def at_bytes(self, asked: DataFrame) -> DataFrame:
        """(path, at, idx) for every byte ``at`` of a log file of ``asked`` (path, at), by the parts of a store's files."""
        return offsets.instructions_at(self.instruction, self.file_part, asked)

    def memory_panel(self, idx: int) -> DataFrame:
        return self.at(idx).select(memory_panel(F.col("memory_ops"), F.col("memory_dump"), F.col("raw_line")).alias("text"))

    def search(self, term: str, selected: int = -1) -> tuple[str, DataFrame]:
        """What a free term asks for, and the answer: a line number, all of a mnemonic, all at a module offset, or the
        next match after the selected position."""
        term = (term or "").strip()
        if term.isdecimal():
            return "line", self.line(int(term))
        if terms.is_mnemonic(term) and not terms.is_address(term):
            return "mnemonic", self.all_by_mnemonic(term)
        if terms.is_offset(term):
            return "offset", self.all_by_offset(term)
        return "next", self.find_next(term, selected + 1)

    def find_next(self, term: str, start: int = 0) -> DataFrame:
        return search.find_next(self.instruction, self.memory_access, term, start, self.by_offset, *self._index("by_address"))

    def all_by_address(self, term: str, kinds: tuple[str, ...] = ()) -> DataFrame:
        """Needs four hexadecimal digits or more."""
        if not terms.is_address(term):
            raise ValueError("an address search needs at least four hexadecimal digits")
        return search.all_by_address(self.instruction, self.memory_access, term, kinds)

    def all_by_offset(self, term: str) -> DataFrame:
        """Needs 0x and fewer than eight digits."""
        if not terms.is_offset((term or "").strip()):
            raise ValueError("an offset search needs 0x and one to seven hexadecimal digits")
        return search.all_by_offset(self.instruction, term, *self._index("by_offset"))

    def count_by_offset(self, term: str) -> DataFrame:
        return search.count_by_offset(self.by_offset, term, *self._index("offset_rank"))

    def nth_by_offset(self, term: str, n: int) -> DataFrame:
        return search.nth_by_offset(self.by_offset, term, n, *self._index("offset_rank"))

    def page_by_offset(self, term: str, top: int, count: int) -> DataFrame:
        """``count`` rows of ``all_by_offset`` from row ``top`` (from 0) on."""
        return search.page_by_offset(self.instruction, self.by_offset, term, top, count, *self._index("offset_rank"))

    def all_by_mnemonic(self, term: str) -> DataFrame:
        """Needs a letter first; may end in an asterisk."""
        if not terms.is_mnemonic(term):
            raise ValueError("a mnemonic search needs a mnemonic or the beginning of one")
        return search.all_by_mnemonic(self.instruction, self.mnemonic, term, *self._index("mnemonic_rank"))

    def nth_by_mnemonic(self, term: str, n: int) -> DataFrame:
        return search.nth_by_mnemonic(self.by_mnemonic, self.mnemonic, term, n, *self._index("mnemonic_rank"))

    def page_by_mnemonic(self, term: str, top: int, count: int) -> DataFrame:
        """``count`` rows of ``all_by_mnemonic`` from row ``top`` (from 0) on."""
        return search.page_by_mnemonic(self.instruction, self.by_mnemonic, self.mnemonic, term, top, count, *self._index("mnemonic_rank"))

    def candidates_by_address(self, term: str) -> DataFrame:
        """How many accesses an address search has to look at, and where, by the buckets' directory."""
        return search.candidates_by_address(self.bucket, term)

    def result(self, matches: DataFrame, *order: Column | str) -> pages.SavedResult:
        """A result in an order (by ``index`` if none is given), written so that any page of it is read by itself."""
        return pages.SavedResult(matches, *order)

    def all_by_data(self, term: str) -> DataFrame:
        """Needs anything but blanks."""
        if not terms.data_term(term):
            raise ValueError("a data search needs a value or text")
        return search.all_by_data(self.instruction, term, *self._index("by_gram", "gram"))

    def places_by_data(self, term: str) -> DataFrame:
        """(idx) of what ``all_by_data`` finds, in no order; of a store it needs the listing alone."""
        if not terms.data_term(term):
            raise ValueError("a data search needs a value or text")
        return search.places_by_data(self.table("listing"), term, *self._index("by_gram", "gram"))

    def _checkpointed(self) -> dict:
        return {"checkpoints": self.table("checkpoint"), "interval": self.spacing} if self.stored else {}

    def state_at(self, idx: int) -> DataFrame:
        return state.state_at(self.register_write, idx, **self._checkpointed())

    def states_at(self, positions: DataFrame) -> DataFrame:
        """(idx, register, value) for every position of ``positions`` (idx)."""
        return state.states_at(self.register_write, positions, **self._checkpointed())

    def state_for_display(self, idx: int) -> DataFrame:
        return state.state_for_display(self.register_write, idx, **self._checkpointed())

    def register_source(self, register: str, idx: int) -> DataFrame:
        return lineage.register_source(self.register_write, register, idx)

    def taint(self, register: str, idx: int, max_steps: int = TAINT_STEPS) -> DataFrame:
        return lineage.taint_slice(self.instruction, self.register_write, self.def_use, register, idx, max_steps)

    def taints(self, roots: DataFrame, max_steps: int = TAINT_STEPS) -> DataFrame:
        """The slices of many roots (root, register, idx) at once."""
        return lineage.taint_slices(self.instruction, self.register_write, self.def_use, roots, max_steps)

    def provenance(self, register: str, idx: int, max_scan: int = PROVENANCE_SCAN, max_steps: int = PROVENANCE_STEPS) -> tuple[DataFrame, str]:
        return lineage.provenance(self.instruction, self.register_write, self.memory_access, self.def_use, register, idx, max_scan, max_steps, *self._index("memory_def_use", "bucket"))
