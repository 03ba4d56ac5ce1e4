"""Reading texts, envelopes, saved cases and tables; writing findings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one whole UTF-8 file per row, identified by its path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def envelopes(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(doc_id, value): JSON envelopes, one per file or one per line."""
    return spark.read.text(path, wholetext=not lines).select(F.input_file_name().alias("doc_id"), "value")


CASES = (
    "ruleId string, meaning string, credentialRequired boolean, source string, cases array<struct<fixtureId:string,input:string,context:map<string,string>,"
    "expected:struct<ruleId:string,status:string,range:struct<start:int,end:int>,evidence:array<string>,reason:string,confidence:double,suggestedAction:string>,"
    "expectedStatus:string,observedStatus:string,relationLabels:array<string>,antecedentCandidates:array<string>>>"
)


def cases(spark: SparkSession, path: str) -> DataFrame:
    """One row per case of saved fixture or evaluation files; the schema is fixed, nothing is inferred."""
    rows = spark.read.schema(CASES).json(path, multiLine=True)
    return rows.select(F.col("ruleId"), F.inline("cases"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(spark: SparkSession, path: str) -> int:
    """The bytes of a file, or of all files of a folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def write_lines(rows: DataFrame, path: str, column: str = "json") -> None:
    """One JSON line per row."""
    rows.select(F.col(column).alias("value")).write.text(path)


def quarantine(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with a text, rows without one)."""
    return docs.where(F.col(text).isNotNull()), docs.where(F.col(text).isNull())


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local master may use a temporary one, deleted at exit."""
    import atexit
    import shutil
    import tempfile

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="kotomill-")
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def temporary(spark: SparkSession, name: str) -> str:
    """A new folder's path under scratch(), deleted when the JVM ends."""
    import uuid

    path = f"{scratch(spark)}/kotomill/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
