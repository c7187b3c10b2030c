"""Joins of a large table to a table with one row per key, safe under skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.session import cut_lineage

BROADCAST_BYTES = 32 * 1024 * 1024
#: Bytes of the left side that a key may have before it is spread over copies; a copy for each so many of them.
BYTES_PER_SALT = 64 * 1024 * 1024
#: Copies of every key where nothing is known of their weights.
SALTS = 32


def join_lookup(
    left: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "left",
    *,
    salt_on: list[str],
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``left`` to ``lookup``, which holds one short row per ``on`` key.

    ``lookup`` is computed once and measured. Up to ``broadcast_bytes`` it is
    broadcast and ``left`` does not move. Beyond that the bytes of ``left`` are summed
    for each key: one that is heavy has as many copies in ``lookup`` as its weight
    asks for, and its rows are spread over them by a hash of ``salt_on``, so a key
    that holds a third of ``left`` still runs in many tasks and all others are joined
    as they are. Both ways give the same rows. A null key meets a null key.
    """
    lookup = cut_lineage(lookup)
    per_row = F.lit(64) + F.coalesce(F.octet_length(F.to_json(F.struct(*lookup.columns))), F.lit(0))
    size = lookup.agg(F.coalesce(F.sum(per_row), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        return _null_safe(left, F.broadcast(_named(lookup, on)), on, how)
    return salted_join(left, lookup, on, how, salt_on=salt_on, heavy=heavy_keys(left, on))


def heavy_keys(left: DataFrame, on: list[str], bytes_per_salt: int = BYTES_PER_SALT) -> DataFrame:
    """Keys of more than ``bytes_per_salt`` bytes with the number of their copies, ``_salts``; partial sums come before the shuffle."""
    width = F.lit(0)
    for name, kind in left.dtypes:
        width = width + (F.coalesce(F.octet_length(name), F.lit(0)) if kind in ("string", "binary") else F.lit(16))
    weights = left.groupBy(*on).agg(F.sum(width.cast("long")).alias("_weight")).filter(F.col("_weight") > bytes_per_salt)
    return cut_lineage(weights.select(*on, F.ceil(F.col("_weight") / bytes_per_salt).cast("int").alias("_salts")))


def _named(lookup: DataFrame, on: list[str]) -> DataFrame:
    return lookup.withColumnsRenamed({k: f"_of_{k}" for k in on})


def _null_safe(left: DataFrame, lookup: DataFrame, on: list[str], how: str) -> DataFrame:
    same = F.lit(True)
    for k in on:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return left.join(lookup, same, how).drop(*[f"_of_{k}" for k in on])


def salted_join(left: DataFrame, lookup: DataFrame, on: list[str], how: str, *, salt_on: list[str], heavy: DataFrame | None = None) -> DataFrame:
    """Join over copies: as many of a key as ``heavy`` (``on``, ``_salts``) says and one of others, or ``SALTS`` of every key without it."""
    if heavy is None:
        left, lookup = left.withColumn("_salts", F.lit(SALTS)), lookup.withColumn("_salts", F.lit(SALTS))
    else:
        # There are at most as many heavy keys as ``left`` has times their least weight.
        few = F.broadcast(_named(heavy, on)) if heavy.count() <= 200_000 else _named(heavy, on)
        left, lookup = _null_safe(left, few, on, "left"), _null_safe(lookup, few, on, "left")
    copies = F.coalesce("_salts", F.lit(1))
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), copies).cast("int")).drop("_salts")
    copied = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_salts")
    return _null_safe(salted, _named(copied, [*on, "_salt"]), [*on, "_salt"], how).drop("_salt")
