"""The one pass over the text: Markdown structure, sentences, paragraphs, NFC candidates and scans.

Every rule reads from this pass's struct; it is the only place where the text leaves the JVM, once, in Arrow
batches, and only the columns that are asked for are computed and sent back. All offsets come out in
UTF-16 units.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Mapping
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown, sentences
from ..sources.batches import small_batches

#: Stands for one character of code where texts are scanned.
FILLER = "\ufdd0"
_WIDE = regex.compile("[\U00010000-\U0010ffff]")
_COMBINED = regex.compile(r"\P{M}\p{M}+")

_SPAN = (("start", pa.int32()), ("end", pa.int32()))
_SENTENCE = (("text", pa.string()), *_SPAN, ("paragraph", pa.int32()))
#: What each field of the struct holds. "sentences" are those of the whole text, "outside" those of the parts between code blocks.
FIELDS = {
    "code": (*_SPAN, ("block", pa.bool_())),
    "sentences": _SENTENCE,
    "outside": _SENTENCE,
    "paragraphs": (("text", pa.string()), ("raw", pa.string()), *_SPAN, ("sentences", pa.int32())),
    "decomposed": _SPAN,
}
#: What fills optional members: the texts of sentences, their paragraphs, the raw texts and sentence counts of paragraphs.
DETAILS = ("texts", "homes", "raw", "counts")
_SCAN = (("text", pa.string()), *_SPAN)
Scan = Callable[[str], list[tuple[str, int, int]]]


class Offsets:
    """UTF-16 offsets of code point offsets; texts without wide characters need no table."""

    def __init__(self, text: str):
        plain = text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
        self.wide = [] if plain else [m.start() for m in _WIDE.finditer(text)]

    def __call__(self, i: int) -> int:
        return i + bisect_left(self.wide, i) if self.wide else i


def _marks(text: str) -> Iterator[tuple[int, int]]:
    """Sequences of a base character and combining marks that NFC would change."""
    from unicodedata import normalize

    return ((m.start(), m.end()) for m in _COMBINED.finditer(text) if normalize("NFC", m[0]) != m[0])


def _mask(text: str, code: list[tuple[int, int, bool]]) -> str:
    parts, last = [], 0
    for s, e, _ in code:
        if e > last:
            parts += [text[last : max(s, last)], FILLER * (e - max(s, last))]
            last = e
    return "".join([*parts, text[last:]]) if parts else text


def masked_text(text: str) -> str:
    """The text with FILLER for every character of code."""
    return _mask(text, markdown.parse(text, False).code) if markdown.may_hold_code(text) else text


def describe(text: str, wanted: frozenset[str] = frozenset((*FIELDS, *DETAILS)), scans: Mapping[str, Scan] = {}) -> dict[str, list[tuple]]:
    """The wanted fields of one text as rows of tuples, and what the scans find outside code."""
    at, out = Offsets(text), {}
    laid_out = not wanted.isdisjoint(("paragraphs", "homes"))
    coded = bool(scans) or not wanted.isdisjoint(("code", "outside", "decomposed"))
    if laid_out or (coded and markdown.may_hold_code(text)):
        parsed = markdown.parse(text, "paragraphs" in wanted)
        code, homes = parsed.code, [(s, e) for _, s, e in parsed.paragraphs]
    else:
        code, homes = [], []

    def found(start: int, end: int) -> list[tuple]:
        rows, k = [], 0
        for s, e in sentences.split(text[start:end] if end - start < len(text) else text):
            s, e = s + start, e + start
            while k < len(homes) and homes[k][1] < e:
                k += 1
            inside = k < len(homes) and homes[k][0] <= s and e <= homes[k][1]
            rows.append((text[s:e] if "texts" in wanted else None, at(s), at(e), k if inside else None))
        return rows

    if "code" in wanted:
        out["code"] = [(at(s), at(e), block) for s, e, block in code]
    if "sentences" in wanted:
        out["sentences"] = found(0, len(text))
    if "outside" in wanted:
        rows, cursor = [], 0
        for s, e in [*sorted((s, e) for s, e, block in code if block), (len(text), len(text))]:
            if s > cursor:
                rows += found(cursor, s)
            cursor = max(cursor, e)
        out["outside"] = rows
    if "paragraphs" in wanted:
        count = lambda t: len(sentences.split(t)) if "counts" in wanted else None
        out["paragraphs"] = [(t, text[s:e] if "raw" in wanted else None, at(s), at(e), count(t)) for t, s, e in parsed.paragraphs]
    if "decomposed" in wanted:
        loose = [] if text.isascii() else _marks(text)
        out["decomposed"] = [(at(s), at(e)) for s, e in loose if not any(cs <= s and e <= ce for cs, ce, _ in code)]
    if scans:
        masked = _mask(text, code)
        for name, scan in scans.items():
            out[name] = [(t, at(s), at(e)) for t, s, e in scan(masked)]
    return out


def _lists(rows: list[list[tuple] | None], members: tuple) -> pa.Array:
    """The rows' lists as an Arrow array, column by column; None gives null."""
    flat = [x for r in rows if r for x in r]
    columns = zip(*flat, strict=True) if flat else ((),) * len(members)
    items = pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, members, strict=True)], [name for name, _ in members])
    ends = pa.array(accumulate((len(r or ()) for r in rows), initial=0), pa.int32())
    return pa.ListArray.from_arrays(ends, items, mask=pa.array([r is None for r in rows], pa.bool_()))


_DDL = {pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean"}


def structured(text: Column, wanted: tuple[str, ...], scans: Mapping[str, Scan] = {}) -> Column:
    """A struct of the wanted fields and one field per scan, each an array; a null text has null arrays."""
    chosen = frozenset(wanted)
    kinds = {name: FIELDS[name] for name in FIELDS if name in chosen} | dict.fromkeys(scans, _SCAN)

    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for start in range(0, max(1, len(texts)), 64):
            rows = [None if x is None else describe(x, chosen, scans) for x in texts[start : start + 64].to_pylist()]
            parts.append(pa.StructArray.from_arrays([_lists([r and r[name] for r in rows], kind) for name, kind in kinds.items()], list(kinds)))
        return pa.concat_arrays(parts)

    ddl = ", ".join(f"{name}: array<struct<{', '.join(f'{m}: {_DDL[k]}' for m, k in kind)}>>" for name, kind in kinds.items())
    return F.arrow_udf(run, f"struct<{ddl}>")(text)


def fresh(names: list[str], like: str) -> str:
    """A column name that no column of the input has."""
    held = {n.lower() for n in names}
    while like in held:
        like += "_"
    return like


def structure(docs: DataFrame, text: str = "text", fields: tuple[str, ...] = (*FIELDS, *DETAILS)) -> DataFrame:
    """The same rows with the chosen structure columns added; a null text has null structure."""
    small_batches(docs.sparkSession)
    name = fresh(docs.columns, "structure")
    return docs.withColumn(name, structured(F.col(f"`{text}`"), fields)).select(*(F.col(f"`{c}`") for c in docs.columns), f"{name}.*")


def rows_of(docs: DataFrame, field: str, *columns: str, place: str | None = None) -> DataFrame:
    """The columns with one row for each item of an array, the item under ``field`` and its place under ``place``; documents without items have no rows.

    explode() would make Spark filter on the array's size first, and so pass all texts to Python once more for the filter.
    """
    item = F.explode_outer(field).alias(field) if place is None else F.posexplode_outer(field).alias(place, field)
    return docs.select(*columns, item).where(F.col(field).isNotNull())
