"""Envelopes checked in column expressions against the driver's checks of one envelope, and the order of reports by UTF-16 units."""

import copy
import json
import random

from pyspark.sql import functions as F

from kotomill.errors import ContractValidationError
from kotomill.operators import envelopes
from kotomill.operators import report as R

TEXT = "あ😀い￮うabc"
FINDINGS = [
    {"ruleId": "D004", "category": "deterministic", "range": {"start": 0, "end": 2}, "severity": "error", "message": "m"},
    {"ruleId": "H101", "category": "heuristic", "range": {"start": 0.0, "end": 9}, "severity": "warning", "message": "長い", "actual": 101, "threshold": 100.0},
    {"ruleId": "D006", "category": "deterministic", "range": {"start": 0, "end": 2}, "severity": "warning", "message": "\U0001f600"},
]
JUDGED = [
    {"ruleId": "S203", "status": "violation", "range": {"start": 0, "end": 4}, "evidence": ["😀い", "あ"], "reason": "r", "confidence": 0.9},
    {"ruleId": "S201", "status": "uncertain", "range": {"start": 3, "end": 5}, "evidence": ["x"], "reason": "￮", "confidence": 1, "suggestedAction": "do"},
    {"ruleId": "S201", "status": "uncertain", "range": {"start": 3, "end": 5}, "evidence": ["x"], "reason": "\U0001f600", "confidence": 0, "suggestedAction": "do"},
]
VALUES = [None, "", "S203", "D001", "H103", "violation", 0, -1, 1.5, 3, 9, 10, True, [], ["う"], [1], {}, {"start": 1, "end": 3}, "error", "warning", 1e30, "heuristic"]


def broken(rng):
    """An envelope with a few random changes anywhere in it."""
    value = {"input": TEXT, "findings": copy.deepcopy(rng.sample(FINDINGS, rng.randrange(4))), "semanticFindings": copy.deepcopy(rng.sample(JUDGED, rng.randrange(4)))}
    for _ in range(rng.choice([0, 0, 1, 1, 2])):
        at = value
        while rng.random() < 0.7:
            inner = [x for x in (at.values() if isinstance(at, dict) else at) if isinstance(x, dict | list) and x]
            if not inner:
                break
            at = rng.choice(inner)
        if isinstance(at, list):
            at[rng.randrange(len(at))] = rng.choice(VALUES)
        elif rng.random() < 0.2:
            at.pop(rng.choice(list(at)))
        else:
            at[rng.choice([*at, "extra", "suggestedAction"])] = rng.choice(VALUES)
    return json.dumps(value, ensure_ascii=rng.random() < 0.5)


def one(text):
    try:
        value = R.parse_envelope(text or "")
    except ContractValidationError as e:
        return 2, None, str(e)
    found = R.build_report(value["findings"], value["semanticFindings"])
    return found["exitCode"], json.loads(R.line(found)), None


def test_against_the_checks_of_one_envelope(spark):
    rng = random.Random(1)
    texts = [broken(rng) for _ in range(1500)] + ["", None, "null", "[]", "3", "{", '{"input": NaN}', '"x"']
    rows = envelopes.reports_of(spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "k int, value string, error int").drop("error"), "value").orderBy("k").collect()
    got = [(r.exit_code, json.loads(r.report) if r.report else None, r.error) for r in rows]
    want = [one(t) for t in texts]
    assert [(t, g, w) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []
    assert {w[0] for w in want} == {0, 1, 2} and len({w[2] for w in want}) > 12


def test_native_and_canonical(spark):
    rows = envelopes.reports_of(spark.createDataFrame([(json.dumps({"input": TEXT, "findings": FINDINGS, "semanticFindings": JUDGED}),)], "value string"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    report = json.loads(rows.first().report)
    assert [m["message"] for m in report["lintMessages"]] == ["m", "\U0001f600", "長い"]
    # U+1F600 is written as D83D DE00 and so comes before U+FFEE
    assert [n["reason"] for n in report["semanticNotices"]] == ["r", "\U0001f600", "￮"]
    assert '"confidence":1,' in rows.first().report


def test_null_rows(spark):
    assert envelopes.reports_of(spark.createDataFrame([], "value string")).count() == 0
    row = envelopes.reports_of(spark.range(1).select(F.lit(None).cast("string").alias("value"))).first()
    assert (row.exit_code, row.report, row.error) == (2, None, "invalid JSON")


def test_the_text_is_read_outside_the_lambdas(spark):
    """An envelope's text is named once, before its findings and judgements are checked, so that none of them reads all of it."""
    assert str(envelopes.envelope_problem(F.col("m"))).count("try_element_at(m, 'input')") == 2  # its kind and its value
