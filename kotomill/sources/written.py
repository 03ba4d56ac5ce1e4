"""Tables written to the shared folder: cut points that survive lost executors, with a checked size for broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import temporary

#: A side of a join is broadcast if its rows take at most this much, by rows and lengths of strings; above it the same join shuffles.
BROADCAST_BYTES = 32 << 20


class Written:
    """A DataFrame's rows as Parquet under spark.checkpoint.dir; the folder is deleted when the JVM ends, or by drop()."""

    def __init__(self, rows: DataFrame, name: str):
        self.spark, self.schema = rows.sparkSession, rows.schema
        self.path = temporary(self.spark, name)
        rows.write.parquet(self.path)

    def _path(self):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def small(self, limit: int | None = None) -> bool:
        """Whether all rows, counted and measured, take at most the limit (BROADCAST_BYTES)."""
        text = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in self.schema if f.dataType.typeName() in ("string", "struct", "array", "map", "binary")]
        per_row = F.lit(48 + 8 * len(self.schema))
        for t in text:
            per_row = per_row + t
        taken = self.df.agg(F.sum(per_row.cast("long"))).first()[0] or 0
        return taken <= (BROADCAST_BYTES if limit is None else limit)

    def side(self) -> DataFrame:
        """The rows as a side of a join, marked for broadcast only if they are small."""
        return F.broadcast(self.df) if self.small() else self.df

    def drop(self) -> None:
        self._files().delete(self._path(), True)
