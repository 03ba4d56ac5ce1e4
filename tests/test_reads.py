"""How often texts and rows are read: replacements that share a pattern, and rows that are sorted by ranges."""

import random

import pytest
from pyspark.sql import functions as F

from kotomill.operators import runs
from kotomill.plans import built


def in_turn(text, pairs):
    for a, b in pairs.items():
        text = text.replace(a, b)
    return text


def test_pairs_that_share_a_pattern_give_what_they_give_in_turn(spark):
    """h107_rows: the text is not read once for each of its 138 pairs."""
    pairs = built.RUNS["h107_runs"][1]
    rng = random.Random(1)
    texts = ["".join(rng.choice("。！？ 。 AJaxyまた、k") for _ in range(200)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", built.line().alias("line"), built._swapped(pairs).alias("text"))
    assert [r.text for r in docs.collect()] == [in_turn(r.line, pairs) for r in docs.collect()]
    assert docs._jdf.queryExecution().optimizedPlan().toString().count("replace(") < 12


def test_pairs_that_may_meet_are_replaced_in_turn(spark):
    """An insertion that makes a key, keys inside keys, keys of two lengths, and replacements that insert nothing."""
    for pairs in ({"xy": "xay", "xa": "xba"}, {"xx": "xax", "xb": "xab"}, {"xyz": "xycz", "yc": "yac"}, {"ab": "acb", "ac": "adc"}, {"ab": "b"}, {"ab": "axab"}, {"a": "ba"}):
        assert built._insertions(pairs) is None
        docs = spark.createDataFrame([(0, "xyz xxab xaxx yc aba")], "doc_id long, text string")
        assert docs.select(built._swapped(pairs)).first()[0] == in_turn("xyz xxab xaxx yc aba", pairs)


def test_special_characters_are_no_pattern(spark):
    pairs = {"か]": "か$1\\]", "か\\": "か$1\\\\", "か-": "か$1\\-"}
    docs = spark.createDataFrame([(0, "か]か-か。か")], "doc_id long, text string").select(built._swapped(pairs).alias("t"), built.line().alias("l"))
    assert [r.t for r in docs.collect()] == [in_turn(r.l, pairs) for r in docs.collect()]


def test_runs_read_their_rows_once(spark):
    """The ranges that rows are sorted by come from a sample; what makes the rows does not run for it again."""
    read = spark.sparkContext.accumulator(0)

    def told(label):
        read.add(1)
        return label

    rows = spark.range(100).select(F.lit(1).alias("doc_id"), F.col("id").alias("n"), F.udf(told)(F.lit("a")).alias("label"), F.col("id").alias("start"), F.col("id").alias("end"))
    assert [r.length for r in runs.runs(rows, parts=3).collect()] == [100]
    assert read.value == 100


@pytest.mark.parametrize("name", ["sentences", "paragraphs", "markdown_paragraphs", "markdown_notes", "sentences_in_pairs"])
def test_texts_go_to_python_once(spark, name):
    """A filter on an array's size, as explode() brings, would send them twice."""
    from kotomill.plans import catalog

    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
