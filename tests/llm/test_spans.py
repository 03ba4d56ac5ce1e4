"""Personal data, secrets and licences: scanners against plain definitions, and their edge cases."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kotomill.llm import licences, pii, secrets

PIECES = ["a", "b.", "@", ".", "-", "1", "25", "300", " ", "+", "(", ")", "4111111111111111", "AKIA", "ABCDEFGH12345678", "token", "=", ":", '"', "abcdef0123456789", "api_", "key", "PassWord", "é", "😀"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=25).map("".join)


def luhn(digits):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1])) % 10 == 0


def plain_pii(t):
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(((k, m.start(), m.end()) for k, m in found), key=lambda x: (x[1], pii.RANK[x[0]]))


def plain_secrets(t):
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    found = [("assign", m) for m in re.finditer(rf"({key})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 6]
    found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [("hex", m) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(((k, m.start(), m.end()) for k, m in found), key=lambda x: (x[1], secrets.RANK[x[0]]))


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_base_spans(text):
    assert [x for x in pii.scan(text) if x[0] in pii.BASE] == plain_pii(text)
    assert [x for x in secrets.scan(text) if x[0] in secrets.BASE] == plain_secrets(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1Z", max_size=40), st.integers(2, 8), st.floats(0.5, 2.5))
def test_windows_against_entropy(run, width, least):
    def entropy(s):
        return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s))

    inside = set()
    for i in range(len(run) - width + 1):
        if entropy(run[i : i + width]) >= least - 1e-9:
            inside |= set(range(i, i + width))
    covered = [i for s, e in secrets.windows(run, width, least) for i in range(s, e)]
    assert sorted(inside) == sorted(set(covered)) and len(covered) == len(set(covered))


def test_methods():
    assert [k for k, *_ in pii.scan("pay to DE89 3704 0044 0532 0130 00 now")] == ["iban"]
    assert [k for k, *_ in pii.scan("pay to DE88 3704 0044 0532 0130 00 now")] == []
    assert pii.score("my card 4111111111111111", "card", 8, 24) > pii.score("an example 4111111111111111", "card", 11, 27)
    assert pii.masked("mail a@b.cd, call +1 (555) 555-0100") == "mail [EMAIL], call [PHONE]"
    assert pii.masked(None) is None and pii.masked("") == ""
    assert "entropy" in [k for k, *_ in secrets.scan("x aZ3kP9qLx7Vw2Rt8Ybn4Mc6Gd1 y")]
    for known in ("123e4567-e89b-12d3-a456-426614174000", "some/path/with/letters/only/here", "2024-01-01-00-00-00-000000000", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1"):
        assert "entropy" not in [k for k, *_ in secrets.scan(known)]


@pytest.mark.parametrize(
    ("text", "kind", "passes"),
    [
        ("call 030 1234 5678 now", "tel", True), ("it was 030 1234 5678 then", "tel", False), ("order 030 1234 5678, phone us", "tel", False),
        ("account XX89 3704 0044 0532 0130 04", "iban", None), ("host 10.2.3.4", "ip", True), ("in version 10.2.3.4", "ip", False), ("a sample a@b.cd", "email", True),
        ("mail x@example.com, 10.2.3.4", "ip", True), ("order +1 (555) 555-0100", "phone", False), ("order, call +1 (555) 555-0100", "phone", True), ("test 4111111111111111", "card", True),
    ],
)
def test_context_decides(text, kind, passes):
    """The score crosses the threshold either way; words inside addresses do not count."""
    found = {k: pii.score(text, k, s, e) for k, s, e in pii.scan(text)}
    assert found.get(kind) is None if passes is None else (found[kind] >= pii.THRESHOLD) == passes
    assert (f"[{kind.upper()}]" in pii.masked(text)) == bool(passes)


def test_iban_countries():
    """A known country needs its length; another country's checksum alone is not enough without a word for it."""
    unknown = next(f"QX{c:02d}12345678901234567" for c in range(2, 99) if pii.mod97(f"QX{c:02d}12345678901234567"))
    at = lambda t: [(k, round(pii.score(t, k, s, e), 2) >= pii.THRESHOLD) for k, s, e in pii.scan(t) if k == "iban"]
    assert at(f"x {unknown} y") == [("iban", False)] and at(f"bank {unknown} y") == [("iban", True)]
    short = next(f"DE{c:02d}1234567890123" for c in range(2, 99) if pii.mod97(f"DE{c:02d}1234567890123"))
    assert at(f"bank {short}") == [] and at("DE89370400440532013000") == [("iban", True)]


def test_allow_list_cuts_only_what_it_names():
    secret = "aZ3kP9qLx7Vw2Rt8Ybn4Mc6Gd1"
    spans = lambda t: [(s, e) for k, s, e in secrets.scan(t) if k == "entropy"]
    assert spans(f"{secret}xxxx{secret}") == [(0, 26), (30, 56)] and spans(f"0123456789{secret}") == [(10, 36)]
    assert spans("123e4567-e89b-12d3-a456-426614174000") == [] and spans(f"123e4567-e89b-12d3-a456-426614174000-{secret}") == [(36, 63)]
    many = " ".join(f"token={secret}{k}" for k in range(20_000))
    assert len([x for x in secrets.scan(many) if x[0] == "assign"]) == 20_000 and not spans(many)


@pytest.mark.parametrize("text", ["030 12 " * 70_000, "12 " * 160_000, "a" * 500_000, "1" * 500_000, "1." * 250_000, "+1" + " " * 500_000, "a@" * 250_000, "AB12" * 100_000, "token" + " " * 300_000, "AKIA" * 100_000])
def test_long_texts(text):
    pii.scan(text)
    secrets.scan(text)


ROWS = [(1, "a@b.cd token=abcdef1", "x"), (1, "a@b.cd token=abcdef1", "x"), (None, None, "y"), (3, "", None), (4, "😀 1.2.3.4", "z")]


def test_tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, spans string")
    rows = {(r.doc_id, r.spans): r for r in pii.digest(pii.spans(docs), pii.BASE).collect()}
    assert rows[4, "ip:2:9"].n_ip == 1 and rows[3, ""].n_email == 0 and rows[None, ""].base_sha256 == pii.base_digest(None)
    assert pii.digest(pii.spans(docs), pii.BASE).count() == 5
    assert rows[1, "email:0:6"].base_sha256 == pii.base_digest("a@b.cd")
    assert sorted(r.spans for r in pii.digest(secrets.spans(docs), secrets.BASE).collect()) == ["", "", "", "assign:7:20", "assign:7:20"]
    masked = pii.redact(docs).collect()
    assert sorted(str(r.text) for r in masked) == sorted(["[EMAIL] token=abcdef1"] * 2 + ["None", "", "😀 [IP]"]) and masked[0].spans == "x"
    assert pii.spans(docs.where("false")).count() == 0 and secrets.spans(docs.where("false")).count() == 0


def test_licences_held_out():
    """Sentences that were not templates, and text without licences."""
    prose = ["the rivers of the land were said to follow the old roads down to the sea", "nothing here is about rights or works at all", "und die kleine Stadt lag still am Fluss"]
    model = licences.train([p.split() for p in prose] * 50)
    found = lambda t: [h["family"] for h in licences.scan(t, model)]
    assert found("This module is licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert found("Code released under the MIT License.\nEnjoy.") == ["mit"]
    assert found("It is licensed under the GNU General Public License, version 3") == ["gpl"]
    assert found("Licensed under CC BY-NC 4.0.") == ["cc-by-nc"] and found("Licensed under CC BY-SA 4.0.") == ["cc-by-sa"]
    for text in [*prose, *licences.OTHER_USES, "", "\n\n", "license"]:
        assert found(text) == []
    buried = " ".join(prose * 20) + " Released under the MIT License. " + " ".join(prose * 20)
    assert found(buried) == ["mit"]
    assert licences.scan(None, model) == []
    text = "x\nReleased under the MIT License."
    hit = licences.scan(text, model)[0]
    assert (hit["start"], hit["end"]) == (2, 32) and text[hit["start"] : hit["end"]] == "Released under the MIT License"


def test_short_notices_in_long_lines():
    """A short notice is found in a full window, alone and behind foreign words; the words around it alone are not."""
    prose = ["the rivers of the land were said to follow the old roads down to the sea", "nothing here is about rights or works at all", "und die kleine Stadt lag still am Fluss"]
    model = licences.train([p.split() for p in prose] * 50)
    found = lambda t: [h["family"] for h in licences.scan(t, model)]
    around = " ".join(prose * 20)
    assert found(around) == []
    for text, family in (("Released under the MIT License.", "mit"), ("All rights reserved.", "proprietary"), ("Released under CC0 1.0 Universal.", "cc0")):
        line = f"{around} {text} {around}"
        hits = licences.scan(line, model)
        assert [h["family"] for h in hits] == [family]
        assert hits[0]["start"] <= line.index(text) + 1 and hits[0]["end"] >= line.index(text) + len(text) - 1


def test_licence_tables(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.", 0), (1, "Released under the MIT License.", 0), (None, None, 0), (3, "", 0)], "doc_id long, text string, hits int")
    rows = licences.licences(docs).select("doc_id", F.size("hits").alias("n")).collect()
    assert sorted((r.doc_id or 0, r.n) for r in rows) == [(0, 0), (1, 1), (1, 1), (3, 0)]
    assert licences.licences(docs.where("false")).count() == 0


def test_licence_lines_of_a_table(spark):
    """Every line of a real table that grants a licence is found, and nothing in documents without one."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 4 = 0")
    grants = re.compile(r"(?i)\b(?:licen[sc]ed? under|released under|creative commons|all rights reserved|gnu (?:affero |lesser )?general public|apache license|mit license|spdx-license-identifier|mozilla public license)\b")
    model = licences.fit(docs)
    found = {r.doc_id: r.hits for r in licences.licences(docs, model=model).collect()}
    lines, caught = 0, 0
    for r in docs.collect():
        spans = [m.span() for m in re.finditer(r"[^\n]+", r.text or "") if grants.search(m[0])]
        lines += len(spans)
        caught += sum(any(h.start < e and s < h.end for h in found[r.doc_id]) for s, e in spans)
        assert spans or not found[r.doc_id]
    assert lines > 20 and caught >= 0.95 * lines
