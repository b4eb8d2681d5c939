"""Steps that add columns to any rows, built once in a session.

Parsing takes some thousand expressions, and building each is a call to the JVM; so the steps are recorded
with their columns, which name what they read and belong to no table, and applied to each table anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

_recorded: dict[tuple, tuple[object, Recipe]] = {}


class Recipe:
    """Takes the place of rows while steps are recorded."""

    def __init__(self):
        self.steps: list[tuple[str, tuple]] = []

    def _step(self, name: str, *args) -> Recipe:
        self.steps.append((name, args))
        return self

    def withColumn(self, name: str, column: Column) -> Recipe:  # noqa: N802
        return self._step("withColumns", {name: column})

    def withColumns(self, columns: dict[str, Column]) -> Recipe:  # noqa: N802
        return self._step("withColumns", columns)

    def drop(self, *names: str) -> Recipe:
        return self._step("drop", *names)

    def on(self, rows: DataFrame) -> DataFrame:
        for name, args in self.steps:
            rows = getattr(rows, name)(*args)
        return rows


def applied(rows: DataFrame, steps: Callable[..., Recipe], *args) -> DataFrame:
    """``steps(rows, *args)``, whose steps depend on ``args`` alone and are recorded when they are first applied."""
    context = rows.sparkSession.sparkContext
    key = (steps.__module__, steps.__qualname__, *args)
    if key not in _recorded or _recorded[key][0] is not context:
        _recorded[key] = (context, steps(Recipe(), *args))
    return _recorded[key][1].on(rows)
