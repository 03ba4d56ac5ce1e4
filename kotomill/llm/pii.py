"""Personal data: regular expressions propose spans, checksums confirm them, context words move the score.

``spans(docs)`` gives an array of (kind, start, end, score) per document, offsets in code points,
end exclusive. ``redact(docs)`` replaces the spans whose score reaches ``threshold``.

A span's score is its kind's prior, raised by a word nearby that speaks for the kind and lowered by one that speaks against it.
Either can decide: a number like a national phone number (kind ``tel``) or an IBAN of a country without a known length counts only
with a word for it, and an ip or a phone number beside "version" or "order" is not redacted. The base kinds of the
contract are reported whatever their score; the others from the threshold on.

Defined edge cases: a null text has no spans (and stays null when redacted), an empty text has none,
texts of any length are scanned whole in linear time, repeated rows give repeated results, an empty
table gives an empty table, and further columns of any name pass through ``redact`` untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, small_batches, table, tidy

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "tel")
RANK = {kind: i for i, kind in enumerate(KINDS)}

# Possessive repeats and one-character look-behinds keep every scan linear on long runs; the
# matches are those of the plain greedy patterns, as the character after each run is outside it.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")

# Words near a span that speak for a kind, or against it.
FOR = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono"),
    "tel": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone", "handy"),
    "iban": ("iban", "bank", "account", "transfer", "konto", "cuenta", "compte", "bic"),
}
AGAINST = ("example", "sample", "dummy", "test", "version", "isbn", "order", "serial", "build")
# The lengths of IBANs by country.
IBAN_LENGTH = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
#: Score of a span by kind after its validator passed, and of an IBAN whose country has no known length.
PRIOR, UNKNOWN_IBAN = {"email": 0.9, "ip": 0.8, "card": 0.85, "phone": 0.8, "iban": 0.8, "tel": 0.4}, 0.45
#: Characters looked at on either side, and what one supporting or opposing word adds.
NEAR, STEP = 48, 0.25
#: Spans from here on are redacted, and spans beyond the base kinds are reported.
THRESHOLD = 0.6
#: A word of its own: no part of an address or a path.
WORDS = re.compile(r"(?<![\w@./-])[^\W\d_][\w-]*+(?![@/]|\.\w)")
TEL = re.compile(r"(?<![\w+.-])\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,5}){2,4}(?![\w-]|\.[0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 13616: the first four characters move to the end, letters count from 10."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in DOMAIN.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            last = m.end()
            yield start, last


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in IBAN.finditer(text):
        end = m.end()
        while end - m.start() >= 15:
            code = text[m.start() : end].replace(" ", "")
            if len(code) < 15:
                break
            follows = text[end : end + 1]
            if text[end - 1] != " " and not (follows.isascii() and follows.isalnum()) and IBAN_LENGTH.get(code[:2], len(code)) == len(code) and mod97(code):
                yield m.start(), end
                break
            end -= 1


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All confirmed spans by start, then kind in the listed order."""
    if not text:
        return []
    found = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    found += [("iban", s, e) for s, e in _ibans(text)]
    taken = sorted((s, e) for _, s, e in found)
    k, last = 0, 0
    for m in TEL.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            k, last = k + 1, max(last, taken[k][1])
        if last <= m.start() and 7 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append(("tel", m.start(), m.end()))
    found.sort(key=lambda x: (x[1], RANK[x[0]]))
    return found


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, moved by context words within NEAR characters."""
    near = {w.lower() for w in WORDS.findall(text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR])}
    prior = UNKNOWN_IBAN if kind == "iban" and text[start : start + 2] not in IBAN_LENGTH else PRIOR[kind]
    value = prior + STEP * any(w in near for w in FOR[kind]) - STEP * any(w in near for w in AGAINST)
    return round(min(1.0, max(0.0, value)), 2)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): every confirmed span with its score; no threshold is applied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            texts = (x.as_py() for x in batch.column(1))
            found = [[{"kind": k, "start": s, "end": e, "score": score(t, k, s, e)} for k, s, e in scan(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["key", "spans"])

    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidy(run), f"key {kind}, spans {SPANS}").withColumnRenamed("key", key)


def masked(text: str | None, threshold: float = THRESHOLD) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for k, s, e in scan(text):
        if e > at and score(text, k, s, e) >= threshold:
            # an overlapping later span only hides what the earlier one left
            out += [text[at : max(at, s)], f"[{k.upper()}]"] if s >= at else []
            at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The same rows and columns; spans at or over the threshold are replaced by their kind in brackets."""

    @F.pandas_udf("string")
    def hide(values):
        out = values.map(lambda x: masked(x, threshold), na_action="ignore")
        released()
        return out

    small_batches(docs.sparkSession)
    return docs.withColumn(text, hide(F.col(text)))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the contract, one row per document, with the spans' scores."""
    found = spans(table(spark, sf_dir, "documents"))
    sure = F.filter("spans", lambda x: x["kind"].isin(*BASE) | (x["score"] >= THRESHOLD))
    scores = F.array_join(F.transform("spans", lambda x: F.format_number(x["score"], 2)), ",")
    return digest(found.withColumn("spans", sure), BASE, scores.alias("scores"))


def digest(found: DataFrame, base: tuple[str, ...], *more: Column) -> DataFrame:
    """Counts per base kind, the hash of the base spans and all spans as text; the spans come in the contract's order."""
    one = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    basic = F.filter("spans", lambda x: x["kind"].isin(*base))
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in base]
    line = lambda spans: F.array_join(F.transform(spans, one), ",")
    return found.select("doc_id", *counts, F.sha2(line(basic).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), *more)


def base_digest(text: str | None) -> str:
    """The hash of one text, for tests."""
    return hashlib.sha256(joined([x for x in scan(text) if x[0] in BASE]).encode()).hexdigest()


QUERIES = {"op5_pii": op5_pii}
ORACLES: dict[str, str] = {}
