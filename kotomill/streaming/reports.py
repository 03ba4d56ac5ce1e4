"""Runs over files of envelopes, as a batch or as a stream: reports, a quarantine for what breaks the contract, and one exit code.

Files hold one envelope a line, which Spark splits however large a file is, or one envelope each. A run writes ``reports`` (one canonical JSON
line a report) and ``quarantine`` (JSON lines of doc_id, value and error) under its folder, both compressed by gzip. A stream writes both for every micro-batch in a
folder of the batch's number, which a repeated batch replaces, so each envelope is reported once.

The exit code of a run is the greatest of its envelopes': 2 if any is in quarantine, else 1 if any report has an error, else 0, also for no
envelopes at all. Empty lines are no envelopes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import envelopes
from ..sources.written import Written


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(F.input_file_name().alias("doc_id"), "value").where("trim(value) <> ''")


def _put(rows: DataFrame, folder: str) -> int:
    """Writes the checked rows under the folder; the exit code of these rows."""
    checked = Written(rows.withColumn("value", F.when(F.col("error").isNotNull(), F.col("value"))), "checked")  # with a report its envelope is not needed any more
    checked.df.where("error is null").select(F.col("report").alias("value")).write.mode("overwrite").text(f"{folder}/reports", compression="gzip")
    checked.df.where("error is not null").select("doc_id", "value", "error").write.mode("overwrite").json(f"{folder}/quarantine", compression="gzip")
    code = checked.df.agg(F.max("exit_code")).first()[0] or 0
    checked.drop()
    return code


def run(spark: SparkSession, path: str, folder: str, lines: bool = True) -> int:
    """Reports on the envelopes of the files at ``path`` and gives the exit code of the run."""
    return _put(envelopes.reports_of(_named(spark.read.text(path, wholetext=not lines))), folder)


def stream(spark: SparkSession, path: str, folder: str, state: str, lines: bool = True, files: int = 1000) -> StreamingQuery:
    """The same for the files that are there and come later to ``path``, up to ``files`` a micro-batch, until all that are there are done."""
    rows = _named(spark.readStream.option("maxFilesPerTrigger", files).text(path, wholetext=not lines))

    def put(batch: DataFrame, number: int) -> None:
        _put(envelopes.reports_of(batch), f"{folder}/{number:08d}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()


def results(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(value of every report, doc_id, value and error of everything in quarantine) of a run or a stream."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-*")
    kind = "doc_id string, value string, error string"
    reported, refused = _all(spark, folder, "reports"), _all(spark, folder, "quarantine")
    return read.text(reported) if reported else spark.createDataFrame([], "value string"), read.schema(kind).json(refused) if refused else spark.createDataFrame([], kind)


def _all(spark: SparkSession, folder: str, name: str) -> list[str]:
    """The folders of that name of a run, or of each micro-batch of a stream."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(folder)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop.Path(f"{folder}/{{{name},*/{name}}}"))
    return [x.getPath().toString() for x in found]
