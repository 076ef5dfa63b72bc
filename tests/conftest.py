from __future__ import annotations

import os
import sys
import tempfile
import uuid
from datetime import UTC, datetime

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.context import Context, configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


@pytest.fixture
def folder():
    return f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/{uuid.uuid4().hex}"


@pytest.fixture
def ctx():
    return Context(now=datetime(2026, 3, 10, 12, 0, tzinfo=UTC))


def utc(*parts: int) -> datetime:
    return datetime(*parts, tzinfo=UTC)
