"""UTF-16 arithmetic as column expressions: Spark counts code points, ranges count UTF-16 units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ECMAScript white space as a Java character class body.
SPACE = r"\t\n\x0B\f\r \xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: inside lambdas Spark evaluates every mention of an expression anew."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def offset(text: Column, code_points: Column) -> Column:
    """The UTF-16 offset of a code point offset."""
    return length(F.substring(text, F.lit(1), code_points))


def to_range(text: Column, start: Column, end: Column) -> Column:
    """The UTF-16 range of a code point range; null if it is not 0 <= start < end <= length."""
    ok = (start >= 0) & (start < end) & (end <= F.length(text))
    return F.when(ok, F.struct(offset(text, start).alias("start"), offset(text, end).alias("end")))


def is_range(start: Column, end: Column, text: Column) -> Column:
    return F.coalesce((start >= 0) & (start < end) & (end <= length(text)), F.lit(False))
