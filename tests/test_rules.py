"""Hand-checked cases of every rule, and properties of the findings."""

import json
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kotomill.config import validate
from kotomill.functions import japanese as ja
from kotomill.operators.lint import analyze, with_findings
from kotomill.operators.scans import Terms, brackets, register, repeated
from kotomill.operators.structure import describe
from tests.golden import CASES, SENTENCES

ALL = {"rules": {rule: {"ruleId": rule, **options} for rule, options, _ in CASES.values()}}


def units(text):
    return len(text.encode("utf-16-le")) // 2


def cut(text, start, end):
    return text.encode("utf-16-le")[2 * start : 2 * end].decode("utf-16-le")


@pytest.mark.parametrize("name", CASES)
def test_golden(spark, name):
    rule, options, cases = CASES[name]
    docs = spark.createDataFrame(list(enumerate(t for t, _ in cases)), "doc_id long, text string")
    found = analyze(docs, {"rules": {rule: {"ruleId": rule, **options}}}).collect()
    got = sorted((r.doc_id, r.start, r.end, r.actual, r.message) for r in found)
    assert got == sorted((k, *f) for k, (_, fs) in enumerate(cases) for f in fs)


def test_sentence_labels(spark):
    rows = spark.createDataFrame([(t,) for t, *_ in SENTENCES], "t string")
    t = F.col("t")
    got = rows.select("t", ja.terminal(t), ja.leading(t), F.array_join(F.transform(ja.predicates(t), lambda p: p["surface"]), ","), F.array_join(ja.demonstratives(t), ",")).collect()
    assert [tuple(r) for r in got] == SENTENCES


def test_sentence_analysis(spark):
    """Tokens of all four roles with rebased ranges, sorted by start and role."""
    cases = [("一方、手紙を書きます。", 10), ("それは駅です、これを😀説明するか？", 0), ("", 3), ("abc", 5)]
    rows = spark.createDataFrame(cases, "t string, o int")
    got = [r[0] for r in rows.select(ja.analysis(F.col("t"), F.col("o"))).collect()]
    token = lambda t: (t.role, t.start, t.end, t.surfaceForm, t.lemma, t.morphologyLabel)
    assert [token(t) for t in got[0].tokens] == [("leading", 10, 12, "一方", "一方", None), ("predicate", 16, 20, "書きます", "書く", None), ("terminal", 16, 20, "書きます", "書く", "verb:書く:polite-nonpast")]
    assert [token(t) for t in got[1].tokens] == [
        ("demonstrative", 0, 2, "それ", "それ", None), ("leading", 0, 6, "それは駅です", "それは駅です", None), ("predicate", 4, 6, "です", "です", None),
        ("demonstrative", 7, 9, "これ", "これ", None), ("terminal", 12, 16, "説明する", "説明する", "verb:説明する:plain-nonpast|particle:か"),
    ]
    assert (got[0].predicateGroupCount, got[0].leadingSurfaceLabel, got[0].terminalMorphologyLabel) == (1, "一方", "verb:書く:polite-nonpast")
    assert got[1].demonstrativeLemmas == ["それ", "これ"] and got[2].tokens == [] and got[3].tokens == []


def test_order_and_ranges(spark):
    """Findings come sorted, lie in the text, and keep the order of the configuration on ties."""
    texts = [t for _, _, cases in CASES.values() for t, _ in cases]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in with_findings(docs, ALL).collect():
        keys = [(f.start, f.end, f.rule_id) for f in row.findings]
        assert keys == sorted(keys)
        for f in row.findings:
            assert 0 <= f.start < f.end <= units(row.text) and f.message
            assert (f.actual is None) == (f.category == "deterministic")
            assert f.actual is None or f.actual > f.threshold


def test_wide_prefix_shifts_by_two(spark):
    docs = spark.createDataFrame([(0, "必ず雨が降る。"), (1, "😀必ず雨が降る。")], "doc_id long, text string")
    rows = {r.doc_id: r.start for r in analyze(docs, {"rules": {"D004": {"ruleId": "D004", "forbiddenTerms": ["必ず"]}}}).collect()}
    assert rows[1] == rows[0] + 2


def test_null_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, None, "a", 1, 2), (1, "", "b", 1, 2), (1, "（", "c", 1, 2), (1, "（", "c", 1, 2)], "key long, text string, structure string, code int, findings2 int")
    rows = with_findings(docs, {"rules": {"D003": {"ruleId": "D003"}}}).collect()
    assert [r.findings if r.findings is None else len(r.findings) for r in rows] == [None, 0, 1, 1]
    assert [r.structure for r in rows] == ["a", "b", "c", "c"]
    assert analyze(docs.where("false").withColumnRenamed("key", "doc_id"), ALL).count() == 0


def test_code_exclusion(spark):
    before, code, after = "前" * 100 + "。", "中" * 100 + "。", "後" * 100 + "。"
    text = f"{before}\n\n```text\n{code}\n```\n\n{after}"
    docs = spark.createDataFrame([(0, text), (1, f"短い文。\n\n    {code}")], "doc_id long, text string")
    config = {"rules": {"H101": {"ruleId": "H101"}}, "exclude": {"codeBlocks": True}}
    assert [(r.doc_id, cut(text, r.start, r.end)) for r in analyze(docs, config).collect()] == [(0, before), (0, after)]


def test_many_matches_and_long_text(spark):
    """Offsets stay right far into a text."""
    text = "ab 😀" * 5000
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    rows = analyze(docs, {"rules": {"D007": {"ruleId": "D007", "patterns": ["ab"]}}}).select("start").collect()
    assert [r.start for r in rows] == [5 * k for k in range(5000)]


def test_disabled_rules_and_one_narrow_stage(spark):
    docs = spark.createDataFrame([(0, "（")], "doc_id long, text string")
    assert analyze(docs, {"rules": {"D003": False}}).count() == 0
    plan = analyze(docs, ALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def plain_repeats(words, most):
    out, start = [], 0
    while start < len(words):
        sizes = [g for g in range((len(words) - start) // 2, 0, -1) if words[start : start + g] == words[start + g : start + 2 * g]]
        if not sizes:
            start += 1
            continue
        g, copies = sizes[0], 2
        while words[start : start + g] == words[start + copies * g : start + (copies + 1) * g]:
            copies += 1
        out += [(start + k * g, start + (k + 1) * g - 1) for k in range(most, copies)]
        start += copies * g
    return out


def repeated_ranges(spark, texts, most, code=()):
    register(spark)
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("code", F.from_json(F.lit(json.dumps([{"start": s, "end": e} for s, e in code])), "array<struct<start:int,end:int>>"))
    return [[tuple(x) for x in r.found] for r in rows.select("k", repeated(F.col("t"), F.col("code"), most).alias("found")).orderBy("k").collect()]


@pytest.mark.parametrize("most", [1, 2])
def test_repeats_against_the_definition(spark, most):
    """Random words of few kinds, periods within periods, and the words of a Fibonacci sequence."""
    rng = random.Random(most)
    lists = [[rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(40))] for _ in range(1500)]
    for _ in range(300):
        one = [rng.choice("abcd") for _ in range(rng.randrange(1, 6))]
        lists.append((one * rng.randrange(1, 5) + [rng.choice("abcd")]) * rng.randrange(1, 4) + one)
    a, b = ["a"], ["a", "b"]
    while len(b) < 200:
        a, b = b, b + a
    lists.append(b)
    want = [[(2 * i, 2 * j + 1) for i, j in plain_repeats(words, most)] for words in lists]
    assert repeated_ranges(spark, [" ".join(words) for words in lists], most) == want


def test_repeats_end_at_marks_and_code(spark):
    """White space of any kind chains words; marks and code do not; words of any script count, ranges are UTF-16."""
    cases = ["😀 x x", "a\u3000\ufeff\n a", "a。a", "資料資料", "a\x85a", "１ １", ""]
    assert repeated_ranges(spark, cases, 1) == [[(5, 6)], [(5, 6)], [], [(2, 4)], [], [(2, 3)], []]
    assert repeated_ranges(spark, ["a a a a a"], 1, [(4, 5)]) == [[(2, 3), (8, 9)]]
    assert repeated_ranges(spark, ["a a a a a"], 1, [(6, 7), (0, 1)]) == [[(4, 5)]]


@pytest.mark.parametrize("kind", ["two words", "one word", "period"])
def test_long_texts_repeat_in_little_time(spark, kind):
    """320,000 words without a mark, of which most are one word."""
    n, rng = 320_000, random.Random(0)
    words = {"two words": lambda: [rng.choice("aaab") for _ in range(n)], "one word": lambda: ["a"] * n, "period": lambda: [f"w{k % 997}" for k in range(n)]}[kind]()
    repeated_ranges(spark, ["a a"], 1)
    began = time.perf_counter()
    (found,) = repeated_ranges(spark, [" ".join(words)], 1)
    assert time.perf_counter() - began < 15 and found


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="あ。！（）「」 \n\n`*[]ab😀が>-", max_size=60))
def test_structure_ranges(text):
    found = describe(text)
    for words, start, end, home in found["sentences"]:
        assert cut(text, start, end) == words and words.strip()
        assert home is None or found["paragraphs"][home][2] <= start < end <= found["paragraphs"][home][3]
    for _, raw, start, end, count in found["paragraphs"]:
        assert cut(text, start, end) == raw and count >= 0
    for name in ("sentences", "outside", "code", "paragraphs"):
        assert found[name] == sorted(found[name], key=lambda row: row[{"code": 0, "paragraphs": 2}.get(name, 1)])
    for name in ("sentences", "outside", "code"):  # a part alone comes out like the whole
        assert [r[-2:] if name == "code" else r[1:3] for r in describe(text, frozenset((name,)))[name]] == [r[-2:] if name == "code" else r[1:3] for r in found[name]]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="（）「」[]x", max_size=20))
def test_balanced_text_has_no_bracket_findings(text):
    whole = text + "".join({"（": "）", "「": "」", "[": "]"}[c] for c in reversed(text) if c in "（「[")
    if not any(c in "）」]" for c in text):
        assert brackets(whole, (("（", "）"), ("「", "」"), ("[", "]"))) == []


def test_sentence_counts_do_not_depend_on_partitions(spark):
    texts = [(k, "一。二！三" * (k % 5)) for k in range(50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    config = validate({"rules": {"H113": {"ruleId": "H113", "threshold": 2}}})
    one, many = (sorted(map(tuple, analyze(docs.repartition(n), config).collect())) for n in (1, 7))
    assert one == many
    assert docs.select(F.count("*")).first()[0] == 50


@pytest.mark.parametrize(("word", "text", "hits"), [("ああ", "ああ", 1), ("ああ", "あああ", 0), ("カ", "ｶカ", 0), ("カ", "漢カ漢", 1), ("𛀁", "𛀁あ", 0), ("𛀁", "x𛀁", 1), ("ｱ", "ア\U0001b164ｱ", 0), ("語", "語語", 2), ("a", "aa", 2)])
def test_kana_edges(word, text, hits):
    """A term whose edge is kana does not match inside a run of the same script, wherever its characters are encoded."""
    assert len(Terms((word,), True)(text)) == hits


def test_findings_are_computed_once(spark):
    """The plan holds the findings' expression once: no filter of Spark's repeats it."""
    docs = spark.createDataFrame([(0, "（")], "doc_id long, text string")
    plan = analyze(docs, {"rules": {"D003": {"ruleId": "D003"}}})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("の対応が一致しません") == 1


def test_h106_rounds_the_exact_share(spark):
    """57 of 200 are 28.5 percent; 57 / 200 * 100 is less as a double."""
    from kotomill.operators.lint import analyze

    docs = spark.createDataFrame([(1, "これは本。" * 57 + "本。" * 143)], "doc_id long, text string")
    assert [r.actual for r in analyze(docs, {"rules": {"H106": {"ruleId": "H106", "threshold": 5}}}).collect()] == [29]
