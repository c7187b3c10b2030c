"""Parquet tables of a folder, one file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame, rows: int | None = None) -> DataFrame:
    """A scan over all cores, where its files give fewer splits than there are cores.

    A table in one small file is read by one task, and all that follows without
    a shuffle would run in that task. Scans with enough splits, which is every
    large one, are left as they are. Where narrow rows become much work, ``rows`` bounds
    those of a task, whatever the splits of the files are: splits go by bytes. Give it a
    plain scan, before any shuffle.
    """
    tasks = scan.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        tasks = max(tasks, -(-scan.count() // rows))  # from the footers of the files
    return scan.repartition(tasks) if scan.rdd.getNumPartitions() < tasks else scan
