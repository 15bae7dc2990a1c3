"""Small helpers over array columns that Spark's built-ins leave open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    Repeating an expensive expression (a regex scan, a digest) inside a deep
    expression tree would evaluate it again at each use.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def empty_array(element_type: str) -> Column:
    return F.expr(f"cast(array() AS array<{element_type}>)")


def sql_literal(value: str | int | float) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value}D" if isinstance(value, float) else str(value)


def literal_array(values: list[str] | list[int]) -> Column:
    """A constant array, handed over as one expression instead of one per entry."""
    return F.expr(f"array({', '.join(map(sql_literal, values))})")


def literal_map(entries: dict[str, str]) -> Column:
    return F.expr(f"map({', '.join(sql_literal(x) for pair in entries.items() for x in pair)})")


def blocks(items: Column, size: int = BLOCK) -> Column:
    """The array cut into arrays of ``size`` elements (the last may be shorter)."""
    count = F.ceil(F.size(items) / size).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1), lambda b: F.slice(items, b * size + 1, F.lit(size))
    )


def running_starts(lengths: Column) -> Column:
    """Where each piece starts if pieces of these lengths stand in a row.

    A fold that collects its results copies them at every step, so the sums are
    taken within blocks, and over the block totals, instead: a text with many
    thousands of pieces stays affordable.
    """

    def total(some: Column) -> Column:
        return F.aggregate(some, F.lit(0), lambda acc, n: acc + n)

    def within(some: Column, offset: Column) -> Column:
        return F.transform(some, lambda _, i: offset + total(F.slice(some, F.lit(1), i)))

    def across(parts: Column) -> Column:
        return bind(
            F.transform(parts, total),
            lambda totals: F.flatten(
                F.transform(parts, lambda part, b: within(part, total(F.slice(totals, F.lit(1), b))))
            ),
        )

    return F.when(F.size(lengths) <= BLOCK, within(lengths, F.lit(0))).otherwise(
        bind(blocks(lengths), across)
    )
