"""Interval joins against all pairs, and a document with very many ranges."""

import random

import pytest

from kotomill.operators import intervals

SCHEMA = "doc_id long, start int, end int, n int, range string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def some(rng, n, longest):
    return [(rng.choice([1, 2, None]), s := rng.randrange(200), s + rng.choice([0, 1, 1, 2, 3, rng.randrange(longest)]), k, "x") for k in range(n)]


@pytest.mark.parametrize("longest", [2, 20, 300])
def test_against_all_pairs(spark, longest):
    rng = random.Random(longest)
    spans, ranges = some(rng, 120, 20), some(rng, 90, longest)
    spans += [spans[3], (1, None, 5, 0, "x"), (1, 5, None, 0, "x")]
    ranges += [ranges[4], (1, None, 5, 0, "x")]
    sound = lambda x: x[1] is not None and x[2] is not None and x[1] < x[2]
    inside = lambda a, b: sound(a) and sound(b) and a[0] == b[0] and b[1] <= a[1] and a[2] <= b[2]
    over = lambda a, b: sound(a) and sound(b) and a[0] == b[0] and a[1] < b[2] and a[2] > b[1]
    s, r = table(spark, spans), table(spark, ranges)
    first = [tuple(x[:5]) + ((x[5].n, x[5].start, x[5].end) if x[5] else (None,)) for x in intervals.first_containing(s, r, "n").collect()]
    want = [a + (min((b[3], b[1], b[2]) for b in ranges if inside(a, b)) if any(inside(a, b) for b in ranges) else (None,)) for a in spans]
    assert sorted(first, key=str) == sorted(want, key=str)
    for how, test in ((intervals.OVERLAPPING, over), (intervals.CONTAINED, inside)):
        left = sorted(map(tuple, intervals.outside(s, r, how).collect()), key=str)
        assert left == sorted((a for a in spans if not any(test(a, b) for b in ranges)), key=str)
        found = sorted((x.k, x.s, x.e, x.range.n) for x in intervals.pairs(s.where("doc_id is not null"), r, how).collect())
        assert found == sorted({(*a[:3], k, b[3]) for a in spans if a[0] for k, b in enumerate(ranges) if test(a, b)} and [(a[0], a[1], a[2], b[3]) for a in {x[:3] for x in spans if x[0]} for b in ranges if test((*a, 0, ""), b)])


def test_empty_sides(spark):
    s = table(spark, [(1, 0, 5, 0, "x")])
    assert intervals.first_containing(s, s.where("false"), "n").first()[5] is None
    assert intervals.outside(s, s.where("false")).count() == 1 and intervals.outside(s.where("false"), s).count() == 0
    assert intervals.pairs(s.where("false"), s, intervals.OVERLAPPING).count() == 0


def test_a_document_with_very_many_ranges(spark):
    """10^6 ranges of one document: stretches of it are spread over tasks, and rows meet only near each other."""
    ranges = spark.range(1_000_000).selectExpr("1L as doc_id", "cast(id * 10 as int) as start", "cast(id * 10 + 7 as int) as end", "cast(id as int) as n", "'x' as range")
    spans = spark.range(300_000).selectExpr("1L as doc_id", "cast(id * 33 as int) as start", "cast(id * 33 + 2 as int) as end", "cast(id as int) as n", "'x' as range")
    found = intervals.first_containing(spans, ranges, "n", into="home")
    assert found.where("home is not null").count() == sum(33 * k % 10 <= 5 for k in range(300_000))
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    assert intervals.outside(spans, ranges).count() == sum(33 * k % 10 > 6 and 33 * k % 10 + 2 <= 10 for k in range(300_000))


def test_no_side_is_broadcast_by_the_size_of_its_files(spark):
    """Ranges take far less in Parquet than in the driver's memory."""
    rows = spark.createDataFrame([(1, 0, 3, 0), (1, 5, 9, 1)], "doc_id long, start int, end int, n int")
    found = intervals.outside(rows, rows.where("n = 1"))
    assert [r.n for r in found.collect()] == [0]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
