"""Look-up of a table of terms in texts: leftmost first, of the terms at a place the longest that its guards let pass.

A term matches outside code only and, if ``bounded``, not where its first or last character continues a run of its own kana script. If the longest term at
a place is refused, a shorter one may match; the search goes on behind a match.

A table of terms that is small, counted and measured, is broadcast and becomes an Aho-Corasick automaton in each worker, which finds all
terms in one pass over a text, however many they are. A larger table stays distributed. No match reaches over a character that no term has, so texts are cut
at those characters into segments; equal segments between equal neighbours (of kana, which guards read) have the same matches and are searched once. Every term is filed under its first 2^k
characters, 2^k being the most that it has, every place of a segment asks for the 2^k characters that stand there if that many
terms begin so, and an equi-join brings both together with the characters that a term may need beyond; a beginning with many terms or places is split by the join.
Only hits are gathered again, by segment, and join the places where the segment stands. Both ways give the same rows.

Defined edge cases: null and empty texts and terms match nothing; repeated terms count once; a null key is a key; repeated
documents each have their matches; ranges are UTF-16 units.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.batches import small_batches
from ..sources.written import Written
from .scans import kana_script
from .structure import FILLER, Offsets, masked_text

#: Characters of a piece of a segment; places are asked for within pieces, as a substring's cost grows with its distance from the start.
PIECE = 512
HIT = "array<struct<term:string,start:int,end:int>>"


def chosen(found: list[tuple[int, int]], text: str, bounded: bool) -> list[tuple[int, int]]:
    """Of all (start, end) where terms stand: leftmost, then longest, none that a guard refuses, without overlap."""
    out, at = [], 0
    for start, end in sorted(found, key=lambda x: (x[0], -x[1])):
        if start < at or (bounded and (_joined(text, start - 1, start) or _joined(text, end - 1, end))):
            continue
        out.append((start, end))
        at = end
    return out


def _joined(text: str, a: int, b: int) -> bool:
    """Whether two neighbours are kana of one script."""
    return a >= 0 and b < len(text) and (script := kana_script(text[b])) is not None and kana_script(text[a]) == script


_held: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, words) -> ahocorasick.Automaton:
    """The automaton of the broadcast words; a worker keeps the last one."""
    if name not in _held:
        found = ahocorasick.Automaton()
        for word in words.value:
            found.add_word(word, len(word))
        found.make_automaton()
        _held.clear()
        _held[name] = found
    return _held[name]


def _scan(name: str, words, bounded: bool):
    """An Arrow function of texts: their matches, by the broadcast words."""

    def run(texts: pa.Array) -> pa.Array:
        automaton, out = _automaton(name, words), []
        for text in texts.to_pylist():
            if not text or not len(automaton):
                out.append([])
                continue
            masked, at = masked_text(text), Offsets(text)
            spans = chosen([(e + 1 - n, e + 1) for e, n in automaton.iter(masked)], masked, bounded)
            out.append([{"term": masked[s:e], "start": at(s), "end": at(e)} for s, e in spans])
        return pa.array(out, pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return F.arrow_udf(run, HIT)


def matches(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", term: str = "term", bounded: bool = False, broadcast_bytes: int | None = None) -> DataFrame:
    """(key, term, start, end) of every match. ``broadcast_bytes`` is the most that a broadcast table of terms may take."""
    small_batches(docs.sparkSession)
    words = Written(terms.select(F.col(f"`{term}`").alias("term")).where("term <> ''").distinct(), "terms")
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    if words.small(broadcast_bytes):
        held = docs.sparkSession.sparkContext.broadcast(tuple(sorted(r.term for r in words.df.collect())))  # at most the limit's bytes
        found = rows.select("k", F.explode(_scan(words.path, held, bounded)(F.col("t"))).alias("m"))
    else:
        found = _joined_matches(rows, words, bounded)
    return found.select(F.col("k").alias(key), "m.term", "m.start", "m.end")


PARTS = "array<struct<segment:string,starts:array<int>>>"


def _segments(letters: str, bounded: bool):
    """An Arrow function of texts: their different segments, each between its neighbours, and where they start."""
    run_of = re.compile(f"[{re.escape(letters)}]+")

    def beside(text: str, i: int) -> str:
        """The neighbour that a guard may read, else FILLER."""
        return text[i] if bounded and 0 <= i < len(text) and kana_script(text[i]) else FILLER

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            text = text or ""
            masked, at, held = masked_text(text), Offsets(text), {}
            for m in run_of.finditer(masked):
                held.setdefault(beside(masked, m.start() - 1) + m[0] + beside(masked, m.end()), []).append(at(m.start()))
            out.append([{"segment": x, "starts": starts} for x, starts in held.items()])
        return pa.array(out, pa.list_(pa.struct([("segment", pa.string()), ("starts", pa.list_(pa.int32()))])))

    return F.arrow_udf(run, PARTS)


def _choose(bounded: bool):
    """An Arrow function of segments between their neighbours and their candidate spans; ranges count from a segment's own start."""

    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts.to_pylist(), found.to_pylist(), strict=True):
            at = Offsets(text[1:])
            out.append([{"term": text[s:e], "start": at(s - 1), "end": at(e - 1)} for s, e in chosen([(x >> 32, x & 0xFFFFFFFF) for x in spans], text, bounded)])
        return pa.array(out, pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return F.arrow_udf(run, HIT)


def _joined_matches(rows: DataFrame, words: Written, bounded: bool) -> DataFrame:
    """The matches by a join of terms and places, for tables of terms of any size."""
    letters = "".join(sorted(r.c for r in words.df.select(F.explode(F.array_distinct(F.regexp_extract_all("term", F.lit("(?s)."), F.lit(0)))).alias("c")).distinct().collect() if r.c != FILLER))  # at most Unicode's
    if not letters:
        return rows.select("k", F.explode(F.array().cast(HIT)).alias("m"))
    parts = Written(rows.select("k", _segments(letters, bounded)(F.col("t")).alias("parts")), "segments")
    texts = Written(parts.df.select(F.explode("parts.segment").alias("t")).distinct().select(F.monotonically_increasing_id().alias("n"), "t"), "different-segments")
    width = F.pow(F.lit(2), F.floor(F.log2(F.length("term")))).cast("int")
    filed = Written(words.df.select("term", width.alias("w")).select("w", F.substring("term", F.lit(1), F.col("w")).alias("head"), F.expr("substring(term, w + 1)").alias("tail")), "filed-terms")
    widths = sorted(r.w for r in filed.df.select("w").distinct().collect())  # powers of two: as many as the bits of the longest term's length
    most = 2 * max(widths, default=1)
    pieces = texts.df.select("n", F.expr("length(t)").alias("size"), F.explode(F.expr(f"transform(sequence(1, length(t), {PIECE}), b -> struct(b, substring(t, b, {PIECE + most}) AS t))")).alias("p"))
    places = pieces.select("n", "size", "p.b", "p.t", F.explode(F.array(*map(F.lit, widths))).alias("w")).select("n", "b", "t", "w", F.explode(F.expr(f"sequence(1, greatest(1, least({PIECE}, size - b + 2 - w)))")).alias("i")).where("length(t) >= i + w - 1")
    asked = places.select("n", (F.col("b") + F.col("i") - 1).alias("s"), "w", F.expr("substring(t, i, w)").alias("head"), F.expr("substring(t, i + w, w - 1)").alias("after")).where(~F.col("head").contains(FILLER))
    heads = Written(filed.df.select("w", "head").distinct(), "heads")
    asked = asked.join(heads.side(), ["w", "head"], "left_semi")
    hits = asked.join(filed.side(), ["w", "head"]).where(F.expr("startswith(after, tail)"))
    per_text = hits.groupBy("n").agg(F.collect_list(F.shiftleft((F.col("s") - 1).cast("long"), 32) + F.col("s") - 1 + F.col("w") + F.length("tail")).alias("spans"))
    found = Written(texts.df.join(per_text, "n").select(F.col("t").alias("segment"), _choose(bounded)(F.col("t"), F.col("spans")).alias("found")).where("size(found) > 0"), "segment-matches")
    placed = parts.df.select("k", F.explode("parts").alias("p")).select("k", "p.segment", "p.starts").join(found.side(), "segment")
    each = placed.select("k", "starts", F.explode("found").alias("f")).select("k", "f", F.explode("starts").alias("at"))
    return each.select("k", F.struct("f.term", (F.col("at") + F.col("f.start")).alias("start"), (F.col("at") + F.col("f.end")).alias("end")).alias("m"))
