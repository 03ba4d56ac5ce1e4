"""Spans outside of ranges: each row is shuffled once, and nothing is lost at the borders of blocks."""

import random

import pytest

from kotomill.operators import intervals
from kotomill.plans import relations

SCHEMA = "doc_id long, start long, end long, n int"


@pytest.mark.parametrize("base", [0, -(1 << 40), (1 << 62) + 1])
def test_blocks_and_large_places(spark, base):
    rng = random.Random(base)
    size = 1 << intervals.BLOCK
    place = lambda: base + rng.choice([0, 1, size - 1, size, size + 1, 3 * size, rng.randrange(5 * size)])
    rows = lambda n, far: [(rng.choice([1, 2, None]), a := place(), a + rng.choice([0, 1, 2, size, rng.randrange(far)]), k) for k in range(n)]
    spans, ranges = [*rows(300, 50), (1, None, 5, 0), (1, 5, None, 0), (None, None, None, 0)], rows(12, 2 * size)
    sound = lambda x: None not in x[1:3] and x[1] < x[2]
    tests = {intervals.CONTAINED: lambda a, b: b[1] <= a[1] and a[2] <= b[2], intervals.OVERLAPPING: lambda a, b: a[1] < b[2] and a[2] > b[1]}
    for how, test in tests.items():
        left = intervals.outside(spark.createDataFrame(spans, SCHEMA), spark.createDataFrame(ranges, SCHEMA), how)
        want = [a for a in spans if not any(sound(a) and sound(b) and a[0] == b[0] and test(a, b) for b in ranges)]
        assert 3 < len(want) < len(spans) and sorted(map(tuple, left.collect()), key=str) == sorted(want, key=str)


def test_rows_are_not_multiplied_by_levels(spark):
    """sentences_outside_code: ranges of many lengths made each span a row for each power of two among them, and joins on these wrote them to disk."""
    plan = relations.sentences_outside_code(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
