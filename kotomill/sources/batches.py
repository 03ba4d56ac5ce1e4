"""Bounds on the Arrow batches in which texts travel to Python."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: A worker holds a batch several times over, as Arrow, as strings and as results that may be larger than the texts.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1024


_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches; smaller bounds that are set stay."""
    for key, most, unit in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES, "b"), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS, "")):
        now = re.fullmatch(r"(\d+)([a-z]*)", (spark.conf.get(key, None) or "").lower())
        if not (now and now[2] in _UNITS and 0 < int(now[1]) * _UNITS[now[2]] <= most):
            spark.conf.set(key, f"{most}{unit}")
