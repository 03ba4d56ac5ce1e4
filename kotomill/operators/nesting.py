"""Brackets of documents whose text lies in many rows: marks without a partner, and the deepest nesting.

A stretch of text acts on what is open before it in one way only: it closes some marks, and leaves some open. So it is told by the closers that find nothing
open within it, by the openers that it leaves, by its net and greatest depth, and, if it holds code, by what lies before the first and behind the last code, as
code takes all that is open. Two neighbours combine: the right one's closers take the left one's openers, the last one first, whatever their kinds; a
closer of another kind is reported. The stretches of a document combine FAN at a time, so a document of n rows takes log n rounds and no task gets more than FAN
stretches of it; reported marks leave at once, only what is still unmatched travels on.

Marks are single characters, and the rows of a document are numbered from 0 on, gaps allowed. Defined edge cases: null texts are empty; a null key is a key of its own; rows of
one document with equal numbers are taken in the order of their offsets; an empty table gives empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PAIRS
from ..sources.batches import small_batches
from ..sources.written import Written

FAN = 64
MARKS = "array<struct<mark:string,start:long>>"
FIELDS = {"closers": MARKS, "code": "boolean", "openers": MARKS, "found": MARKS, "net": "long", "most": "long"}
STRUCT = f"struct<{', '.join(f'{name}: {kind}' for name, kind in FIELDS.items())}>"
_MARKS = pa.list_(pa.struct([("mark", pa.string()), ("start", pa.int64())]))
Stretch = tuple[list, bool, list, list, int, int]  # closers, code, openers, found, net, most


@cache
def _marks(pairs: tuple[tuple[str, str], ...]) -> re.Pattern:
    return re.compile("|".join(re.escape(m) for p in pairs for m in p) or r"(?!)")


def stretch(text: str, offset: int, code: bool, pairs: dict[str, str]) -> Stretch:
    """What a piece of text does; a piece of code takes all that is open."""
    if code:
        return [], True, [], [], 0, 0
    closers, openers, found, depth, most = [], [], [], 0, 0
    for m in _marks(tuple(pairs.items())).finditer(text):
        c, at = m[0], offset + m.start()
        if c in pairs:
            openers.append((c, at))
            depth += 1
            most = max(most, depth)
        else:
            depth -= 1
            if not openers:
                closers.append((c, at))
            elif pairs[openers.pop()[0]] != c:
                found.append((c, at))
    return closers, False, openers, found, depth, most


def combined(a: Stretch, b: Stretch, pairs: dict[str, str]) -> Stretch:
    """What two neighbours do together."""
    open_, closers, found = list(a[2]), list(a[0]), [*a[3], *b[3]]
    for c, at in b[0]:
        if open_:
            if pairs[open_.pop()[0]] != c:
                found.append((c, at))
        elif a[1]:
            found.append((c, at))  # the code before it took all that was open
        else:
            closers.append((c, at))
    if b[1]:
        # what is open before the right one's code is reported if this stretch began it
        found += open_
        open_ = []
    return closers, a[1] or b[1], [*open_, *b[2]], found, a[4] + b[4], max(a[5], a[4] + b[5])


def _arrays(rows: list[Stretch]) -> pa.StructArray:
    held = lambda k: pa.array([[{"mark": m, "start": s} for m, s in r[k]] for r in rows], _MARKS)
    plain = lambda k, t: pa.array([r[k] for r in rows], t)
    return pa.StructArray.from_arrays([held(0), plain(1, pa.bool_()), held(2), held(3), plain(4, pa.int64()), plain(5, pa.int64())], list(FIELDS))


def _merge(pairs: dict[str, str]):
    """An Arrow function of lists of neighbours in order: what those of a list do together."""

    def run(lists: pa.Array) -> pa.Array:
        plain = lambda marks: [(m["mark"], m["start"]) for m in marks]
        part = lambda r: (plain(r["closers"]), r["code"], plain(r["openers"]), [], r["net"], r["most"])
        return _arrays([reduce(lambda a, b: combined(a, b, pairs), map(part, x.as_py())) for x in lists])

    return F.arrow_udf(run, STRUCT)


def _started(pairs: dict[str, str]):
    def run(texts: pa.Array, offsets: pa.Array, codes: pa.Array) -> pa.Array:
        return _arrays([stretch(t or "", o or 0, bool(c), pairs) for t, o, c in zip(texts.to_pylist(), offsets.to_pylist(), codes.to_pylist(), strict=True)])

    return F.arrow_udf(run, STRUCT)


def nested(pieces: DataFrame, key: str = "doc_id", order: str = "n", text: str = "text", offset: str = "offset", code: str | None = None, pairs: tuple[tuple[str, str], ...] = PAIRS) -> tuple[DataFrame, DataFrame]:
    """((key, mark, start) of every mark without a partner, (key, depth) of every document: null if it has such a mark)."""
    if any(len(m) != 1 for p in pairs for m in p):
        raise ValueError("marks of texts in pieces are single characters")
    small_batches(pieces.sparkSession)
    partner = dict(pairs)
    state = _started(partner)(F.col(f"`{text}`"), F.col(f"`{offset}`").cast("long"), F.col(f"`{code}`") if code else F.lit(False))
    begun = pieces.select(F.col(f"`{key}`").alias("k"), F.col(f"`{order}`").cast("long").alias("n"), F.col(f"`{offset}`").cast("long").alias("o"), state.alias("s"))
    now = Written(begun.select("k", "n", F.coalesce("o", F.lit(0)).alias("o"), "s.*"), "stretches")
    told = [now.df.select("k", F.explode("found").alias("m"))]
    most = now.df.agg(F.max("n")).first()[0] or 0
    ties = bool(now.df.groupBy("k", "n").count().where("count > 1").limit(1).count())
    while most > 0 or ties:
        ties = False
        row = F.struct("n", "o", *(c for c in FIELDS if c != "found"))
        lists = now.df.groupBy("k", F.floor(F.col("n") / FAN).alias("g")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
        now = Written(lists.select("k", F.col("g").alias("n"), F.col("rows")[0]["o"].alias("o"), _merge(partner)("rows").alias("s")).select("k", "n", "o", "s.*"), "stretches")
        told.append(now.df.select("k", F.explode("found").alias("m")))
        most //= FAN
    told.append(now.df.select("k", F.explode(F.concat("closers", "openers")).alias("m")))
    findings = reduce(DataFrame.unionByName, told).select("k", "m.mark", "m.start")
    bad = findings.groupBy("k").agg(F.count("*").alias("bad"))
    depths = now.df.alias("d").join(bad.alias("b"), F.col("d.k").eqNullSafe(F.col("b.k")), "left").select(F.col("d.k").alias(key), F.when(F.col("bad").isNull(), F.col("most")).alias("depth"))
    return findings.withColumnRenamed("k", key), depths
