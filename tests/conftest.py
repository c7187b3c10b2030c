from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from scanloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "scanloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """Files table from ``{path: content}`` or ``{(project, path): content}``."""

    def make(tree: dict):
        rows = [(*(k if isinstance(k, tuple) else ("p", k)), v) for k, v in tree.items()]
        df = spark.createDataFrame(rows, "project_id string, path string, content string")
        return df.withColumn("length", F.octet_length("content").cast("long"))

    return make


def issue_set(df):
    return {(r.path, r.line, r.issue_type) for r in df.collect()}
