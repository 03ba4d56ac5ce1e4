"""Brackets over pieces of texts: equal to the stack over whole texts at random cuts."""

import random

import pytest

from kotomill.config import PAIRS
from kotomill.operators import nesting
from kotomill.operators.scans import brackets
from kotomill.operators.structure import FILLER

SCHEMA = "doc_id long, n int, text string, offset int, code boolean, mark string"


def cut(rng, doc, text, pieces):
    """Random pieces of a text; runs of filler are code."""
    at = sorted({0, len(text), *(rng.randrange(len(text) + 1) for _ in range(pieces)), *(i for i in range(1, len(text)) if (text[i] == FILLER) != (text[i - 1] == FILLER))})
    return [(doc, 3 * k, text[a:b], a, text[a] == FILLER, "x") for k, (a, b) in enumerate(zip(at, at[1:], strict=False))]


def depth(text):
    now = most = 0
    for c in text:
        now += (c in dict(PAIRS)) - (c in dict(PAIRS).values())
        most = max(most, now)
    return most


@pytest.mark.parametrize("fan", [2, 64])
def test_random_cuts(spark, monkeypatch, fan):
    monkeypatch.setattr(nesting, "FAN", fan)
    rng = random.Random(fan)
    texts = ["".join(rng.choice(f"（）「」『』x{FILLER if k % 2 else 'x'}") for _ in range(rng.randrange(1, 80))) for k in range(60)]
    texts += ["（「" * 20 + "」）" * 20, "「" * 30 + "）" * 40, "x"]
    rows = [r for k, t in enumerate(texts) for r in cut(rng, None if k == 7 else k, t, rng.choice([0, 3, 30]))]
    found, depths = nesting.nested(spark.createDataFrame(rows, SCHEMA).repartition(4), code="code")
    want = [(None if k == 7 else k, m, s) for k, t in enumerate(texts) for m, s, _ in brackets(t, PAIRS)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    bad = {w[0] for w in want}
    assert sorted(map(tuple, depths.collect()), key=str) == sorted(((k, None if k in bad else depth(t)) for k, t in ((None if k == 7 else k, t) for k, t in enumerate(texts))), key=str)


def test_edges(spark):
    table = spark.createDataFrame([(1, 0, None, 0, False, "x"), (1, 1, "（）", 0, False, "x")], SCHEMA)
    found, depths = nesting.nested(table)
    assert found.count() == 0 and [tuple(r) for r in depths.collect()] == [(1, 1)]
    found, depths = nesting.nested(table.where("false"))
    assert found.count() == 0 and depths.count() == 0
    with pytest.raises(ValueError, match="single"):
        nesting.nested(table, pairs=(("<<", ">>"),))


def test_many_short_documents_without_a_call_for_each(spark, monkeypatch):
    """The stretches of a document are combined in batches of many documents."""

    def refuse(*_):
        raise AssertionError("a pandas call for each document")

    monkeypatch.setattr("pyspark.sql.group.GroupedData.applyInPandas", refuse)
    rng = random.Random(5)
    texts = ["".join(rng.choice("（）「」x") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    rows = [r for k, t in enumerate(texts) for r in cut(rng, k, t, 3)]
    found, _ = nesting.nested(spark.createDataFrame(rows, SCHEMA).repartition(4), code="code")
    assert sorted(map(tuple, found.collect())) == sorted((k, m, s) for k, t in enumerate(texts) for m, s, _ in brackets(t, PAIRS))
