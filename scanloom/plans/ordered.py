"""Running values over the rows of a group in order, without one task per group.

A window over a group runs in one task, and a group may hold a third of all
rows. Here rows are cut into blocks of consecutive numbers: windows run within
blocks, one summary row per block goes through a window of its own, and what it
gives is joined back. A group of a billion rows has 100,000 block summaries.

Rows are shuffled once: the summaries come from the same exchange as the rows,
which Spark then reuses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 10_000


def running(rows: DataFrame, key: str, order: str, sums: dict[str, Column], lasts: dict[str, Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds all the ``sums`` and ``lasts`` in one go; ``order`` numbers the rows of each group.

    A sum runs up to and with each row. A last is ``struct<value, at, ..>`` of the last
    row at or before each whose value is not NULL: the value, the number of that row,
    and what each of the sums was there. Rows without a key or number are left out.
    """

    def moved(last: Column) -> Column:
        """A last of this block, its sums counted from the begin of the group."""
        return F.when(last.isNotNull(), F.struct(last["value"].alias("value"), last["at"].alias("at"), *[(last[s] + F.col(f"_before_{s}")).alias(s) for s in sums]))

    # One partitioning serves the windows, the summaries and the join.
    blocks = rows.withColumn("_block", F.floor(F.col(order) / block_rows)).where(F.col(key).isNotNull() & F.col("_block").isNotNull())
    blocks = blocks.repartition(key, "_block")
    within = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocks.withColumns({s: F.sum(v).over(within) for s, v in sums.items()})
    told = {n: F.when(v.isNotNull(), F.struct(v.alias("value"), F.col(order).alias("at"), *sums)) for n, v in lasts.items()}
    local = local.withColumns({n: F.last(v, True).over(within) for n, v in told.items()})

    ends = local.groupBy(key, "_block").agg(F.max_by(F.struct(*sums, *lasts), order).alias("_end"))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.withColumns({f"_before_{s}": F.coalesce(F.sum(F.col("_end")[s]).over(earlier), F.lit(0)) for s in sums})
    before = before.withColumns({f"_before_{n}": F.last(moved(F.col("_end")[n]), True).over(earlier) for n in lasts}).drop("_end")

    joined = local.join(before, [key, "_block"])
    joined = joined.withColumns({n: F.coalesce(moved(F.col(n)), F.col(f"_before_{n}")) for n in lasts})
    joined = joined.withColumns({s: F.col(s) + F.col(f"_before_{s}") for s in sums})
    return joined.drop("_block", *[f"_before_{n}" for n in (*sums, *lasts)])
