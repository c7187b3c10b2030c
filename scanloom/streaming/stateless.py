"""Scans of streams: the stateless operators on ``readStream`` tables.

Filters, secret detection, redaction and line rules look at one row at a time,
so they run on a stream as they are. What a project is used to is learned in
batch and joined as a static table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scanloom.operators import issues, rewrite, rules, secrets
from scanloom.operators.filters import scannable

FILES_SCHEMA = "project_id string, path string, content string, length long"


def read_files(spark: SparkSession, folder: str, *, schema: str = FILES_SCHEMA, files_per_batch: int = 1000) -> DataFrame:
    """A files table that grows: parquet files put into ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def secrets_of(files: DataFrame) -> DataFrame:
    return secrets.find_file_secrets(scannable(files))


def redacted(files: DataFrame) -> DataFrame:
    return rewrite.redact_secrets(scannable(files))


def rule_hits(files: DataFrame) -> DataFrame:
    return rules.match_rules(scannable(files))


def issue_rows(files: DataFrame, learned_summary: DataFrame) -> DataFrame:
    """Issues of streamed files; ``learned_summary`` is the static output of ``learning.summarise``."""
    joined = scannable(files).join(learned_summary, "project_id", "left")
    return issues.explode_issues(issues.with_issues(joined))


def write(rows: DataFrame, folder: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Append rows to parquet, exactly once per checkpoint folder."""
    writer = rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start()


def redact_text_column(rows: DataFrame, column: str) -> DataFrame:
    """Plain redaction of one text column of any stream."""
    return rows.withColumn(column, rewrite.redact_text(F.col(column)))
