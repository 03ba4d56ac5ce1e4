"""Markdown projection, sentences and UTF-16 arithmetic."""

import pytest
from pyspark.sql import functions as F

from kotomill.functions import utf16
from kotomill.functions.markdown import parse
from kotomill.functions.sentences import split

PROJECTIONS = [
    ("* 朝食を取る。\n* 駅へ行く。\n\n  電車に乗る。", ["朝食を取る。", "駅へ行く。", "電車に乗る。"]),
    ("> 雨が降る。\n> 傘を差す。\n>\n> 風も強い。", ["雨が降る。\n傘を差す。", "風も強い。"]),
    ("## 天気\n\n晴れる。\n\n~~~\nprint(1)\n~~~\n\n    x = 1\n\n| 日 | 気温 |\n| :-- | --: |\n| 月 | 20 |\n\n<section>枠</section>", ["晴れる。"]),
    ("__太字__ [地図](https://maps.test/a \"t\") 駅前<b>広場</b>!", ["太字 地図 駅前広場!"]),
    ("[港](/p) ![船](ship.png) `cmd x` &lt;海&gt;", ["港 船 cmd x <海>"]),
    ("1. 起きる。\n2. 寝る。\n\n> 夢。\n>\n> 朝。", ["起きる。", "寝る。", "夢。", "朝。"]),
    ("東。  \n西。\\\n南。\n北。", ["東。西。南。\n北。"]),
    ("山<i>と川。</i>谷。", ["山と川。谷。"]),
    ("+ *坂。*\n\n> 橋<u>と</u>道。\n\n町。", ["坂。", "橋と道。", "町。"]),
    ("[k]: http://y\n\n[k] [m][k] [n]", ["k m [n]"]),
    ("表紙\n---\n\n中身", ["中身"]),
    ("---\nk: v\n---\n中身", ["中身"]),
    ("", []),
]


@pytest.mark.parametrize(("text", "expected"), PROJECTIONS)
def test_projection(text, expected):
    assert [p for p, *_ in parse(text).paragraphs] == expected


def test_ranges():
    assert [p[1:] for p in parse("> 雨が降る。\n> 傘を差す。").paragraphs] == [(2, 15)]
    assert [p[1:] for p in parse("# 題\n\n一つ。\n\n二つ。").paragraphs] == [(5, 8), (10, 13)]
    assert [c[2] for c in parse("k `v` w\n\n~~~\nq\n~~~\n\n    r\n").code] == [False, True, True]


@pytest.mark.parametrize(
    ("text", "count"),
    [("春。夏。秋。冬。朝。昼。夕。夜。端", 9), ("上\n下", 1), ("「右。左。」中。", 1), ("地図。 駅。", 2), ("海 & 空。", 1), ("", 0), ("  \n", 0), ("x 3.14 is. ok", 2), ("「右。左。", 2)],
)
def test_sentence_counts(text, count):
    assert len(split(text)) == count


@pytest.mark.parametrize("depth", [1, 23, 24, 25, 31, 32, 33, 100, 2000])
def test_nesting_has_no_limit(depth):
    """Pair marks, quotes and lists count at any depth, mixed kinds too."""
    opens, closes = "「（" * depth, "）」" * depth
    assert len(split(f"{opens}甲。乙。{closes}丙。")) == 1
    assert len(split("「" + "（" * depth + "甲。」乙。")) == 1  # a closer finds its opener below any number of others
    assert parse("> " * depth + "abc").paragraphs == [("abc", 2 * depth, 2 * depth + 3)]
    assert parse("- " * depth + "abc").paragraphs == [("abc", 2 * depth, 2 * depth + 3)]
    assert [p for p, *_ in parse("> - " * depth + "abc\n" + "> " * depth + "\nout").paragraphs] == ["abc", "out"]
    assert [p for p, *_ in parse("> " * depth + "abc\nlazy\n> more").paragraphs] == ["abc\nlazy\nmore"]


@pytest.mark.parametrize("text", ["> " * 20000, "[" * 20000, "**" * 20000, "（" * 30000, "a\n" * 50000, "- " * 20000, "- " * 20000 + "x-", "> " * 100000 + "x\n" + "> " * 100000, "<" * 20000])
def test_long_texts_stay_linear(text):
    parse(text)
    split(text)


def test_utf16(spark):
    rows = spark.createDataFrame([("A😀e\u0301Z", 1, 2), ("A😀e\u0301Z", 2, 4), ("a", 1, 1), ("a", 0, 2), ("　a﻿ \n", 0, 1)], "t string, s int, e int")
    got = rows.select(utf16.to_range(F.col("t"), F.col("s"), F.col("e")).alias("r"), utf16.length(F.col("t")).alias("n"), utf16.trim(F.col("t")).alias("trim")).collect()
    assert [(r.r and (r.r.start, r.r.end)) for r in got] == [(1, 3), (3, 5), None, None, (0, 1)]
    assert [r.n for r in got] == [6, 6, 1, 1, 5]
    assert got[-1].trim == "a"


def test_batches_are_bounded(spark):
    """Texts reach Python in batches of bounded rows and bytes, whatever the session had."""
    from kotomill.operators.structure import structure
    from kotomill.sources.batches import BATCH_BYTES, BATCH_ROWS

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "256m")
    structure(spark.createDataFrame([(1, "a")], "doc_id long, text string"), fields=("sentences",))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{BATCH_BYTES}b"
