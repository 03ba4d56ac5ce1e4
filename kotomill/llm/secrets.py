"""Secrets: fixed patterns, plus sliding-window Shannon entropy per character class with an allow-list.

For each character class, candidate strings are the runs of that class of at least a window's length.
A window slides over the run; its counts and the sum of c*log2(c) change by one step per character, so
a run costs time in proportion to its length. Windows over the class's threshold join into one span of
kind ``entropy``. What the allow-list names inside a candidate is cut out of it first, and only what remains on either side is
measured; a remainder of letters or of digits alone is none. The base kinds are never suppressed.

Defined edge cases: a null or empty text has no spans; texts of any length are scanned whole; repeated
rows give repeated results; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, tidy
from .pii import digest

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "entropy")
RANK = {kind: i for i, kind in enumerate(KINDS)}

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")

#: Class: its characters, the window, and the entropy in bits that a window must reach.
CLASSES = {
    "hex": (re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}+"), 20, 3.0),
    "base64": (re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"), 20, 3.7),
}
# What looks random but is known not to be secret, wherever it stands, and as a whole.
ALLOW = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|EXAMPLE|example|PLACEHOLDER|placeholder|[xX]{4,}+|0123456789(?:abcdef)?|abcdefghij[a-z]*+")
ALLOW_WHOLE = (
    re.compile(r"(?:[A-Za-z]+[/_-])*[A-Za-z]+"),  # words, paths and names of letters only
    re.compile(r"[0-9_/+-]+"),  # numbers, dates
)


def windows(run: str, width: int, least: float) -> Iterator[tuple[int, int]]:
    """Maximal spans of the run covered by windows whose entropy is at least ``least`` bits."""
    if len(run) < width:
        return
    cost = [0.0, *(c * math.log2(c) for c in range(1, width + 1))]
    top = cost[width]  # width * log2(width)
    counts: dict[str, int] = {}
    total, start, end = 0.0, -1, -1
    for i, c in enumerate(run):
        if i >= width:
            gone = run[i - width]
            k = counts[gone]
            total += cost[k - 1] - cost[k]
            counts[gone] = k - 1
        k = counts.get(c, 0)
        total += cost[k + 1] - cost[k]
        counts[c] = k + 1
        if i >= width - 1 and (top - total) / width >= least - 1e-9:
            if end < i - width + 1:
                if start >= 0:
                    yield start, end
                start = i - width + 1
            end = i + 1
    if start >= 0:
        yield start, end


def entropy_spans(text: str) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for pattern, width, least in CLASSES.values():
        for m in pattern.finditer(text):
            cuts = [m.start(), *(at for a in ALLOW.finditer(text, m.start(), m.end()) for at in a.span()), m.end()]
            for start, end in zip(cuts[::2], cuts[1::2], strict=True):
                run = text[start:end]
                if end - start >= width and any(c in "0123456789" for c in run) and not any(a.fullmatch(run) for a in ALLOW_WHOLE):
                    found += [(start + s, start + e) for s, e in windows(run, width, least)]
    merged: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return merged


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans by start, then kind in the listed order; an entropy span inside a base span adds nothing and is left out."""
    if not text:
        return []
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    base = sorted((s, e) for _, s, e in found)
    reach = list(accumulate((e for _, e in base), max))
    for s, e in entropy_spans(text):
        k = bisect_right(base, (s, len(text)))  # the base spans that start no later
        if not k or reach[k - 1] < e:
            found.append(("entropy", s, e))
    found.sort(key=lambda x: (x[1], RANK[x[0]]))
    return found


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): the spans of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(x.as_py())] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["key", "spans"])

    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidy(run), f"key {kind}, spans array<struct<kind:string,start:int,end:int>>").withColumnRenamed("key", key)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the contract, one row per document."""
    return digest(spans(table(spark, sf_dir, "documents")), BASE)


QUERIES = {"op6_secrets": op6_secrets}
ORACLES: dict[str, str] = {}
