"""Look-up of a table of terms: the definition in plain Python, both ways of joining, guards, code and edge cases."""

import random

import pytest

from kotomill.operators.dictionary import matches
from kotomill.operators.lint import analyze
from kotomill.operators.scans import kana_script


def units(text):
    return len(text.encode("utf-16-le")) // 2


def plain(text, terms, bounded):
    """At each place the longest term that no guard refuses; texts without code."""
    joined = lambda a, b: 0 <= a and b < len(text) and kana_script(text[a]) is not None and kana_script(text[a]) == kana_script(text[b])
    out, at = [], 0
    while at < len(text):
        fits = [t for t in terms if t and text.startswith(t, at) and not (bounded and (joined(at - 1, at) or joined(at + len(t) - 1, at + len(t))))]
        if not fits:
            at += 1
            continue
        best = max(fits, key=len)
        out.append((best, units(text[:at]), units(text[: at + len(best)])))
        at += len(best)
    return out


@pytest.mark.parametrize("limit", [None, 0], ids=["broadcast", "joined"])
@pytest.mark.parametrize("bounded", [False, True])
def test_against_the_definition(spark, limit, bounded):
    rng = random.Random(3)
    letters = "abあいアイ漢😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(200)] + ["ab" * 3000 + "漢", "", None]
    terms = list({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(150)}) + ["ab" * 20, "ab" * 20 + "漢", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    table = spark.createDataFrame([(t,) for t in terms + terms[:9]], "term string")
    got = sorted(map(tuple, matches(docs, table, bounded=bounded, broadcast_bytes=limit).collect()))
    assert got == sorted((k, *m) for k, t in enumerate(texts) if t for m in plain(t, [w for w in terms if w], bounded))


@pytest.mark.parametrize("limit", [None, 0], ids=["broadcast", "joined"])
def test_code_and_rule(spark, limit):
    """Code is left out, and the rule with the same terms finds the same places."""
    texts = ["必ず `必ず` 必ず", "```\n必ず\n```\n\n必ずや", "    必ず\n", "必ず\n\n```\n必", "だめ。だめだめ。xだめ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame([("必ず",), ("必ずや",), ("だめ",)], "term string")
    got = sorted((r.doc_id, r.start, r.end) for r in matches(docs, table, bounded=True, broadcast_bytes=limit).collect())
    rule = analyze(docs, {"rules": {"D004": {"ruleId": "D004", "forbiddenTerms": ["必ず", "必ずや", "だめ"]}}})
    assert got == sorted((r.doc_id, r.start, r.end) for r in rule.collect()) and got


@pytest.mark.parametrize("limit", [None, 0], ids=["broadcast", "joined"])
def test_edges(spark, limit):
    docs = spark.createDataFrame([(None, "ab"), (1, "ab"), (1, "ab"), (2, "")], "doc_id long, text string")
    one = spark.createDataFrame([("ab",)], "term string")
    assert sorted(map(tuple, matches(docs, one, broadcast_bytes=limit).collect()), key=str) == [(1, "ab", 0, 2), (1, "ab", 0, 2), (None, "ab", 0, 2)]
    assert matches(docs, one.where("false"), broadcast_bytes=limit).count() == 0
    assert matches(docs.where("false"), one, broadcast_bytes=limit).count() == 0


def test_equal_segments_are_searched_once(spark, monkeypatch):
    """Only the different segments of the texts, between the kana that guards read, ask for terms."""
    from kotomill.operators import dictionary

    tables = {}

    class Kept(dictionary.Written):
        def __init__(self, rows, name):
            super().__init__(rows, name)
            tables[name] = self

    monkeypatch.setattr(dictionary, "Written", Kept)
    texts = ["あb 漢あb うあb あbう 😀あb"] * 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, matches(docs, spark.createDataFrame([("あb",), ("b",)], "term string"), bounded=True, broadcast_bytes=0).collect()))
    assert got == sorted((k, *m) for k, t in enumerate(texts) for m in plain(t, ["あb", "b"], True))
    assert tables["different-segments"].df.count() == 3
