"""The scans of the structure pass: literal terms, brackets, and repeated word groups."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .structure import FILLER

SPANS = "array<struct<start:int,end:int>>"
JAR = Path(__file__).parents[1] / "jvm" / "word-segments.jar"
SEGMENTS, REPEATS = "kotomill_word_segments", "kotomill_repeated_groups"


def brackets(text: str, pairs: tuple[tuple[str, str], ...]) -> list[tuple[str, int, int]]:
    """(mark, start, end) of the marks without a partner, in order; code (filler) leaves all open ones alone."""
    partner = dict(pairs)
    by_length = lambda marks: sorted(dict.fromkeys(marks), key=lambda m: -len(m.encode("utf-16-le")))
    scan = re.compile("|".join([*map(re.escape, by_length(partner)), *map(re.escape, by_length(partner.values())), f"{FILLER}+"]))
    waiting: list[tuple[str, int, int]] = []
    out: list[tuple[str, int, int]] = []
    for m in scan.finditer(text):
        mark = m[0]
        if mark[0] == FILLER:
            out += waiting
            waiting = []
        elif mark in partner:
            waiting.append((mark, m.start(), m.end()))
        else:
            mate = waiting.pop() if waiting else None
            if mate is None or partner[mate[0]] != mark:
                out.append((mark, m.start(), m.end()))
    return sorted(out + waiting, key=lambda x: x[1:])


@dataclass(frozen=True)
class Brackets:
    """The scan for marks without a partner."""

    pairs: tuple[tuple[str, str], ...]

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        return brackets(text, self.pairs)


@cache
def kana_script(c: str) -> str | None:
    """Hiragana or Katakana for a character of either script."""
    return next((script for script in ("Hiragana", "Katakana") if regex.match(rf"\p{{Script={script}}}", c)), None)


@cache
def _alternatives(words: tuple[str, ...], bounded: bool):
    """The words, the longest first, as a pattern; bounded: not continued by their edges' own kana script."""
    longest = sorted(dict.fromkeys(words), key=lambda w: -len(w.encode("utf-16-le")))
    edges = [(kana_script(w[0]), kana_script(w[-1])) if bounded else (None, None) for w in longest]
    if not any(map(any, edges)):
        return re.compile("|".join(map(re.escape, longest)))
    before = lambda script: rf"(?<!\p{{Script={script}}})" if script else ""
    after = lambda script: rf"(?!\p{{Script={script}}})" if script else ""
    return regex.compile("|".join(f"{before(left)}{regex.escape(w)}{after(right)}" for w, (left, right) in zip(longest, edges, strict=True)))


@dataclass(frozen=True)
class Terms:
    """The scan for literal words, leftmost and longest first."""

    words: tuple[str, ...]
    bounded: bool = False

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        return [(m[0], m.start(), m.end()) for m in _alternatives(self.words, self.bounded).finditer(text)] if self.words else []


def register(spark: SparkSession) -> None:
    """Makes the JVM's word segmentation and scan for repeated word groups known to the session."""
    known = _registered()
    if id(spark) not in known:
        spark.sql(f"ADD JAR '{JAR}'")
        spark.udf.registerJavaFunction(SEGMENTS, "kotomill.WordSegments", "array<string>")
        spark.udf.registerJavaFunction(REPEATS, "kotomill.RepeatedGroups", SPANS)
        known[id(spark)] = spark


@cache
def _registered() -> dict:
    return {}


def segments(text: Column) -> Column:
    """The words of a text and what lies between them, in order, each behind w (a word) or o."""
    return F.call_udf(SEGMENTS, text)


def repeated(text: Column, code: Column, most: int) -> Column:
    """Ranges of the copies beyond ``most`` of word groups that follow each other outside code; time is n log n in the words of a text."""
    return F.call_udf(REPEATS, text, code, F.lit(most))
