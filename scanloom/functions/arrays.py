"""Column helpers for arrays and for values used more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once per row.

    Inside the lambda of a higher-order function Spark works an expression out
    again for each element and each mention; a lambda variable it does not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_fields(rows: DataFrame, value: Column) -> DataFrame:
    """Adds the fields of a struct as columns that are worked out exactly once.

    A plain projection may be merged into what reads it, and a filter on one of
    its columns is pushed below it, with a copy of the whole expression for each
    mention. Neither goes through a generator, and a generator of one row costs
    next to nothing beside a pass over a text.
    """
    return rows.select("*", F.inline(F.array(value)))


#: Elements of an array that a fold takes at a time: what it gives out is appended within a block, and blocks to each other.
BLOCK = 64


def fold(items: Column, state: Column, step: Callable[[Column, Column], Column], out_type: str) -> Column:
    """What ``step`` gives out for each element of an array, in one pass from left to right.

    ``step(state, item)`` returns a struct of ``state``, the next one, and ``out``, of
    ``out_type``; an ``out`` of NULL is left out. An accumulator that grows by one
    element at a time would be copied as often as there are elements; here only that
    of a block is, and the blocks' results are appended to each other.
    """
    last = lambda x: F.floor((F.size(x) - 1) / BLOCK).cast("int")
    cut = lambda x: F.transform(F.sequence(F.lit(0), last(x)), lambda i: F.slice(x, i * BLOCK + 1, F.lit(BLOCK)))
    blocks = let(items, lambda x: F.when(F.size(x) <= BLOCK, F.array(x)).otherwise(cut(x)))
    none = F.array().cast(f"array<{out_type}>")

    def within(acc: Column, item: Column) -> Column:
        return let(
            step(acc["state"], item),
            lambda r: F.struct(r["state"].alias("state"), F.when(r["out"].isNull(), acc["outs"]).otherwise(F.concat(acc["outs"], F.array(r["out"]))).alias("outs")),
        )

    def over(acc: Column, block: Column) -> Column:
        return let(
            F.aggregate(block, F.struct(acc["state"].alias("state"), none.alias("outs")), within),
            lambda r: F.struct(r["state"].alias("state"), F.concat(acc["outs"], F.array(r["outs"])).alias("outs")),
        )

    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{out_type}>>").alias("outs"))
    return F.flatten(F.aggregate(blocks, start, over, lambda acc: acc["outs"]))
