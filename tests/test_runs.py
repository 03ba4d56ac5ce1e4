"""Runs over rows against a plain scan, over any number of partitions."""

import itertools
import random

import pytest

from kotomill.operators import runs

SCHEMA = "doc_id long, n int, label string, start int, end int, extra int"


def plain(rows):
    out = []
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[4]))
    for (key, label), group in itertools.groupby(ordered, key=lambda r: (r[0], r[2])):
        group = list(group)
        if label is not None:
            out.append((key, label, group[0][3], group[-1][4], len(group)))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("kinds", [1, 2, 4])
def test_against_a_scan(spark, parts, kinds):
    """Runs that cross one border and many, rows without labels at borders, empty partitions."""
    rng = random.Random(parts * 10 + kinds)
    rows = [(rng.choice([1, 1, 1, 2, None]), k, rng.choice([*"abc"[:kinds], None] if rng.random() < 0.2 else "a"), 10 * k, 10 * k + 5, 0) for k in range(300)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((tuple(r) for r in runs.runs(table, parts=parts).select("doc_id", "label", "start", "end", "length").collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(rows)


def test_edges(spark):
    table = spark.createDataFrame([(1, 0, None, 0, 5, 0), (1, 1, None, 6, 9, 0)], SCHEMA)
    assert runs.runs(table).count() == 0 and runs.runs(table.where("false")).count() == 0
