"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import drop_settled, settle


def _fresh(mins: DataFrame) -> DataFrame:
    """The same rows under a key that Spark doesn't know to be dealt out: the join then deals both sides anew and can split a node with very many edges."""
    return mins.select(F.col("u").bitwiseXOR(F.lit(0).cast("long")).alias("u"), "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    mins = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    out = both.join(_fresh(mins), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them; every u is above its v."""
    mins = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(_fresh(mins), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(mins.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component): the smallest node that each node of ``edges`` can reach.

    ``edges`` holds pairs of longs in any order, repeated or not; pairs with a null
    and pairs of equal nodes say nothing. Alternates large and small stars until
    nothing changes: each round is a few narrow shuffles with partial minima, and
    the number of rounds grows with the logarithm of the longest chain. Every
    round is written to the shared folder and the round before it deleted. An
    empty table gives an empty table.
    """
    pairs = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    now = settle(pairs.where(F.col("u") > F.col("v")).where(f"{a} is not null and {b} is not null").distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        step = settle(_small_star(settle_large := settle(_large_star(now), "edges")), "edges")
        drop_settled(now)
        drop_settled(settle_large)
        now = step
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
