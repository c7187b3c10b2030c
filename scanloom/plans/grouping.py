"""Lists per group whose size is bounded without losing a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.plans.joins import join_lookup
from scanloom.session import cut_lineage

ITEMS_PER_PART = 20_000


def collect_in_parts(
    rows: DataFrame, keys: list[str], items: list[str], *, max_items: int = ITEMS_PER_PART
) -> DataFrame:
    """``keys, part, parts, items``: the rows of each group as sorted arrays.

    The rows of a group stand in the order of ``items`` and are cut into parts of
    ``max_items`` rows; put one after the other the parts hold every row in that
    order, also of a group whose key is null. Equal rows are counted before the
    shuffle, and their copies may lie in several parts. Running numbers are summed
    over the values of the first item (a file) and then within each, so no task
    sorts the rows of a whole group.
    """
    # Written once: the sums and the lists read it, and finding the rows is the costly part.
    equal = cut_lineage(rows.groupBy(*keys, *items).agg(F.count(F.lit(1)).alias("_copies")))
    group = [*keys, items[0]]
    first = equal.groupBy(*group).agg(F.sum("_copies").alias("_size"))
    of_group = Window.partitionBy(*keys).orderBy(items[0])
    first = first.select(
        *group,
        F.coalesce(F.sum("_size").over(of_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy(*keys)).alias("_all"),
    )
    inside = Window.partitionBy(*group).orderBy(*items[1:]) if items[1:] else Window.partitionBy(*group).orderBy(items[0])
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = join_lookup(equal, first, group, "inner", salt_on=items)
    at = F.col("_before") + F.coalesce(F.sum("_copies").over(inside), F.lit(0))
    placed = placed.withColumn("_at", at).withColumn("_end", F.col("_at") + F.col("_copies"))
    part = F.sequence(F.floor(F.col("_at") / max_items), F.floor((F.col("_end") - 1) / max_items))
    placed = placed.withColumn("part", F.explode(part)).withColumn("part", F.col("part").cast("int"))
    own = F.least("_end", (F.col("part") + 1) * max_items) - F.greatest("_at", F.col("part") * max_items)
    parts = F.ceil(F.col("_all") / max_items).cast("int")
    item = F.struct(*[F.col(c) for c in items])
    return placed.withColumn("parts", parts).withColumn("_n", own.cast("int")).groupBy(*keys, "part", "parts").agg(
        F.sort_array(F.flatten(F.collect_list(F.array_repeat(item, F.col("_n"))))).alias("items")
    )
