"""The rules on a stream: every rule works within its row, so findings need no state and no watermark."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lint import analyze
from ..operators.report import report


def documents(spark: SparkSession, folder: str, schema: str, files: int = 64) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def findings(stream: DataFrame, config: Any, key: str = "doc_id", text: str = "text") -> DataFrame:
    return analyze(stream, config, key, text)


def reports(stream: DataFrame, config: Any, key: str = "doc_id", text: str = "text") -> DataFrame:
    return report(stream, config, key, text)


def counts(stream: DataFrame, config: Any, arrived: str, late: str = "10 minutes", window: str = "5 minutes", text: str = "text") -> DataFrame:
    """(window, rule_id, n): findings per rule and arrival window; rows later than the watermark are dropped by Spark."""
    rows = analyze(stream.withWatermark(arrived, late), config, arrived, text)
    return rows.groupBy(F.window(arrived, window).alias("window"), "rule_id").agg(F.count("*").alias("n"))


def write(rows: DataFrame, path: str, checkpoint: str):
    """Appends to Parquet, exactly once, and stops when the folder's present files are done."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
