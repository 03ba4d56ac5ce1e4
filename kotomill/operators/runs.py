"""Maximal runs of equal labels over rows, however long a document is.

The rows are sorted by ranges of (key, order), so a document may lie in several partitions and several documents in one. Each
partition is read once, in order, and gives its runs; a run at either end of a partition may go on beyond it. Only these border runs, two a partition, meet again and
are joined where they are neighbours of one key and one label in different partitions.

Defined edge cases: a row with a null label belongs to no run and ends one; a null key is a key of its own, the last one; equal orders
keep the order of start and end; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.written import Written

PIECE = "part int, at long, doc_id long, label string, start int, end int, length long, border boolean"
_FIELDS = (("part", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("length", pa.int64()), ("border", pa.bool_()))


def _changes(batch: pa.RecordBatch, last: tuple | None) -> np.ndarray:
    """The rows of a batch where a run begins; ``last`` is the row before."""
    keys, labels = (batch.column(k).dictionary_encode() for k in (0, 1))
    k, w = (np.where(np.asarray(c.is_null()), -1, np.asarray(c.indices.fill_null(0))) for c in (keys, labels))
    begins = np.ones(batch.num_rows, bool)
    begins[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1]) | (w[1:] < 0)
    if last is not None and batch.num_rows:
        begins[0] = last[1] is None or last != (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
    return np.flatnonzero(begins)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of a partition in order; the first and the last are borders, and a row without a label is a run of its own there."""
    part, at, open_ = TaskContext.get().partitionId(), 0, None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])

    for batch in batches:
        if not batch.num_rows:
            continue
        begins = _changes(batch, open_[:2] if open_ else None).tolist()
        rows, cuts = [], [*begins, batch.num_rows]
        starts, ends = batch.column(2), batch.column(3)
        if open_:  # the run that was open goes on up to the first cut
            key, label, start, end, n = open_
            if cuts[0]:
                open_ = (key, label, start, ends[cuts[0] - 1].as_py(), n + cuts[0])
        for a, b in zip(cuts, cuts[1:], strict=False):
            if open_:
                if open_[1] is not None or at == 0:
                    rows.append((part, at, *open_, at == 0))
                at += 1
            open_ = (batch.column(0)[a].as_py(), batch.column(1)[a].as_py(), starts[a].as_py(), ends[b - 1].as_py(), b - a)
        if rows:
            yield out(rows)
    if open_:
        yield out([(part, at, *open_, True)])


def runs(rows: DataFrame, key: str = "doc_id", order: str = "n", label: str = "label", start: str = "start", end: str = "end", parts: int | None = None) -> DataFrame:
    """(key, label, start, end, length) of every maximal run; start is that of its first row and end that of its last."""
    plain = rows.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{label}`").cast("string").alias("w"), F.col(f"`{start}`").cast("int").alias("s"), F.col(f"`{end}`").cast("int").alias("e"), F.col(f"`{order}`").alias("o"))
    by = F.asc_nulls_last("k"), F.asc("o"), F.asc("s"), F.asc("e")
    held = Written(plain, "labels")  # the ranges are found in a sample, which reads the rows once more
    dealt = (held.df.repartitionByRange(parts, *by) if parts else held.df.repartitionByRange(*by)).sortWithinPartitions(*by).select("k", "w", "s", "e")
    pieces = Written(dealt.mapInArrow(_pieces, PIECE), "runs")
    held.drop()
    turn = W.orderBy("part", "at")  # two rows a partition at most
    edge = pieces.df.where("border")
    before = F.struct("doc_id", "label")
    fresh = edge.withColumn("fresh", F.when(F.col("label").isNotNull() & (F.lag(before).over(turn) == before) & (F.lag("part").over(turn) != F.col("part")), 0).otherwise(1))
    merged = fresh.withColumn("run", F.sum("fresh").over(turn)).groupBy("run").agg(F.min_by("doc_id", F.struct("part", "at")).alias("doc_id"), F.first("label").alias("label"), F.min_by("start", F.struct("part", "at")).alias("start"), F.max_by("end", F.struct("part", "at")).alias("end"), F.sum("length").alias("length"))
    every = pieces.df.where("not border").select("doc_id", "label", "start", "end", "length").unionByName(merged.drop("run"))
    return every.where("label is not null").withColumnRenamed("doc_id", key).withColumnRenamed("label", label)
