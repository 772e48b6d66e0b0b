"""Array helpers for Spark columns, linear in the array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one fold appends to at a time; keeps prefix sums far from quadratic.
FOLD_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(array: Column, i: Column) -> Column:
    """The element at 0-based ``i``, null outside."""
    return F.get(array, i)


def _fold(array: Column) -> Column:
    """0, a0, a0 + a1, ...: one element more than ``array``."""
    zero = F.array(F.lit(0).cast("int"))
    return F.aggregate(array, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def prefix_sums(array: Column) -> Column:
    """Sums of the elements before each element of an int array, in two levels."""

    def of(a: Column) -> Column:
        last_block = F.floor((F.size(a) - 1) / F.lit(FOLD_BLOCK)).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), last_block), lambda k: _fold(F.slice(a, k * FOLD_BLOCK + 1, FOLD_BLOCK))
        )
        return let(
            blocks,
            lambda b: F.flatten(
                F.zip_with(
                    b,
                    F.slice(_fold(F.transform(b, lambda x: F.element_at(x, -1))), 1, F.size(b)),
                    lambda inner, base: F.transform(F.slice(inner, 1, F.size(inner) - 1), lambda x: x + base),
                )
            ),
        )

    return let(array, lambda a: F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(of(a)))


def fold_emitting(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], element: str) -> Column:
    """Folds an array from the left and gathers what the steps emit: ``struct<state, out>``.

    ``step`` gives the next state and an array of what it emits, of type ``element``. Outputs are gathered in
    blocks, so the cost is far from quadratic in their number.
    """
    none = F.array().cast(f"array<{element}>")

    def one(acc: Column, x: Column) -> Column:
        state, put = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], put).alias("out"))

    def of(a: Column) -> Column:
        def block(acc: Column, k: Column) -> Column:
            zero = F.struct(acc["state"].alias("state"), none.alias("out"))
            inner = F.aggregate(F.slice(a, k * FOLD_BLOCK + 1, FOLD_BLOCK), zero, one)
            joined = lambda i: F.struct(i["state"].alias("state"), F.concat(acc["out"], F.array(i["out"])).alias("out"))
            return let(inner, joined)

        steps = F.sequence(F.lit(0), F.greatest(F.floor((F.size(a) - 1) / F.lit(FOLD_BLOCK)), F.lit(0)).cast("int"))
        zero = F.struct(start.alias("state"), F.array().cast(f"array<array<{element}>>").alias("out"))
        flat = lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["out"]).alias("out"))
        return F.aggregate(steps, zero, block, flat)

    return let(items, of)


def neighbours_equal(a: Column, key: Callable[[Column], Column]) -> Column:
    """Elements of a sorted array whose key another element has too."""

    def shared(x: Column, i: Column) -> Column:
        same = lambda other: F.coalesce(key(other) == key(x), F.lit(False))
        return same(F.get(a, i + 1)) | same(F.get(a, i - 1))

    return F.filter(a, shared)
