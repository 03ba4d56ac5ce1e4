"""Configuration, reports, saved judgements, the command line, sources, streams and the query catalogue."""

import json
import os

import pytest
from pyspark.sql import functions as F

from kotomill import cli
from kotomill.config import PAIRS, THRESHOLD, load, validate
from kotomill.errors import ConfigurationError, ContractValidationError, InputValidationError
from kotomill.operators import candidates as C
from kotomill.operators import envelopes
from kotomill.operators import report as R
from kotomill.operators import semantic
from kotomill.plans import catalog
from kotomill.sources import files
from kotomill.streaming import lint as streaming

BAD = [
    None, [], {"rules": []}, {"rules": {}, "more": 1}, {"rules": {"X001": False}}, {"rules": {"D001": True}}, {"rules": {"D001": {"ruleId": "D002", "style": "consistent"}}},
    {"rules": {"D001": {"ruleId": "D001", "style": "other"}}}, {"rules": {"D001": {"ruleId": "D001"}}}, {"rules": {"D002": {"ruleId": "D002", "normalization": "NFD"}}},
    {"rules": {"D003": {"ruleId": "D003", "pairs": []}}}, {"rules": {"D003": {"ruleId": "D003", "pairs": [["a"]]}}}, {"rules": {"D003": {"ruleId": "D003", "pairs": [["a", ""]]}}},
    {"rules": {"D004": {"ruleId": "D004", "forbiddenTerms": []}}}, {"rules": {"D004": {"ruleId": "D004", "forbiddenTerms": [""]}}}, {"rules": {"D005": {"ruleId": "D005", "terminology": {}}}},
    {"rules": {"D005": {"ruleId": "D005", "terminology": {"a": ""}}}}, {"rules": {"D006": {"ruleId": "D006", "maxConsecutive": 3}}}, {"rules": {"D006": {"ruleId": "D006"}}}, {"rules": {"D006": {"ruleId": "D006", "maxConsecutive": True}}},
    {"rules": {"D007": {"ruleId": "D007", "patterns": "x"}}}, {"rules": {"D007": {"ruleId": "D007", "patterns": None}}}, {"rules": {"D008": {"ruleId": "D008", "replacements": {"": "x"}}}},
    {"rules": {"D008": {"ruleId": "D008", "severity": "notice"}}}, {"rules": {"D008": {"ruleId": "D008", "other": 1}}}, {"rules": {"H101": {"ruleId": "H101", "threshold": -1}}},
    {"rules": {"H101": {"ruleId": "H101", "threshold": 1.5}}}, {"rules": {"H101": {"ruleId": "H101", "threshold": float("nan")}}}, {"rules": {"H101": {"ruleId": "H101", "severity": "error"}}},
    {"rules": {"H105": {"ruleId": "H105"}}}, {"rules": {}, "exclude": {"codeBlocks": 1}}, {"rules": {}, "exclude": {"x": True}}, {"rules": {}, "exclude": None},
]


@pytest.mark.parametrize("raw", BAD, ids=range(len(BAD)))
def test_bad_configurations(raw):
    with pytest.raises(ConfigurationError):
        validate(raw)


def test_defaults():
    rules = {r: {"ruleId": r} for r in THRESHOLD} | {"D003": {"ruleId": "D003", "severity": None}, "D007": {"ruleId": "D007"}, "D008": {"ruleId": "D008"}}
    config = validate({"rules": rules | {"D001": False}})
    assert {r.rule_id: r.threshold for r in config.enabled if r.threshold is not None} == THRESHOLD
    assert config.rules["D003"].pairs == PAIRS and config.rules["D003"].severity == "error" and config.rules["D007"].severity == "warning"
    assert config.exclude_code_blocks is False and config.rules["D001"] is None


def test_report_order_and_exit_code(spark):
    docs = spark.createDataFrame([(0, "（港に船が着く。]"), (1, "短い。"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in R.report(docs, {"rules": {"D003": {"ruleId": "D003"}, "H101": {"ruleId": "H101", "threshold": 5}}}).collect()}
    assert [(m.ruleId, m.range.start, m.range.end) for m in rows[0].lintMessages] == [("H101", 0, 8), ("D003", 8, 9)] and rows[2].lintMessages is None
    assert rows[0].exitCode == 1 and rows[1].exitCode == 0 and rows[2].exitCode == 2


@pytest.mark.parametrize(("text", "code", "lint", "notices"), catalog.ENVELOPES, ids=range(len(catalog.ENVELOPES)))
def test_envelopes(text, code, lint, notices, tmp_path, capsys):
    path = tmp_path / "e.json"
    path.write_text(text, encoding="utf-8")
    assert cli.main(["--input", str(path)]) == code
    out = capsys.readouterr()
    if code == 2:
        assert out.out == "" and out.err.startswith(cli.PREFIX)
    else:
        built = json.loads(out.out)
        R.check_report(built)
        assert (len(built["lintMessages"]), len(built["semanticNotices"]), out.out.count("\n")) == (lint, notices, 1)


def test_report_checks():
    built = R.build_report([catalog._ERROR], [catalog._JUDGED])
    R.check_report(built)
    for broken in ({**built, "x": 1}, {**built, "exitCode": 2}, {**built, "schemaVersion": "2"}, {**built, "lintMessages": [{}]}, {**built, "semanticNotices": [catalog._JUDGED]}):
        with pytest.raises(ContractValidationError):
            R.check_report(broken)


def test_checked_construction():
    """Findings built by hand keep their invariants; judgements need evidence of a violation only."""
    assert C.deterministic("あい", "D004", 0, 2, "error", "m")["category"] == "deterministic"
    assert C.heuristic("😀", "H101", 0, 2, 3, 2, "m")["severity"] == "warning"
    assert C.semantic("あい", "S201", "uncertain", 0, 1, [], "r", 0)["evidence"] == [] and C.semantic("あい", "S201", "violation", 0, 1, ["う"], "r", 1, "x")["suggestedAction"] == "x"
    for text in (None, 3, b"x"):
        with pytest.raises(InputValidationError):
            C.deterministic(text, "D004", 0, 1, "error", "m")
    bad = [
        lambda: C.deterministic("あ", "H101", 0, 1, "error", "m"), lambda: C.deterministic("あ", "D004", 0, 2, "error", "m"), lambda: C.deterministic("あ", "D004", 0, 1, "notice", "m"), lambda: C.deterministic("あ", "D004", 0, 1, "error", ""),
        lambda: C.heuristic("あ", "D004", 0, 1, 1, 0, "m"), lambda: C.heuristic("あ", "H101", 0, 1, -1, 0, "m"), lambda: C.heuristic("あ", "H101", 0, 1, 1.5, 0, "m"), lambda: C.heuristic("あ", "H101", 1, 1, 1, 0, "m"),
        lambda: C.semantic("", "S201", "uncertain", 0, 1, [], "r", 0), lambda: C.semantic("あ", "S201", "violation", 0, 1, [], "r", 0), lambda: C.semantic("あ", "S201", "uncertain", 0, 1, [""], "r", 0), lambda: C.semantic("あ", "S201", "uncertain", 0, 2, [], "r", 0),
        lambda: C.semantic("あ", "S201", "maybe", 0, 1, [], "r", 0), lambda: C.semantic("あ", "S201", "uncertain", 0, 1, [], "", 0), lambda: C.semantic("あ", "S201", "uncertain", 0, 1, [], "r", 1.1), lambda: C.semantic("あ", "S201", "uncertain", 0, 1, [], "r", 0, ""),
    ]
    for make in bad:
        with pytest.raises(ContractValidationError):
            make()


def test_native_semantic_problems(spark):
    schema = "text string, f struct<ruleId:string,status:string,range:struct<start:int,end:int>,evidence:array<string>,reason:string,confidence:double,suggestedAction:string>"
    good = ("S203", "violation", (0, 3), ["あい"], "r", 0.9, None)
    cases = [(good, None), (("S999", *good[1:]), "rule"), ((good[0], "maybe", *good[2:]), "status"), ((*good[:2], (0, 9), *good[3:]), "range"), ((*good[:3], [], *good[4:]), "evidence"), ((*good[:3], ["え"], *good[4:]), "evidence outside range"), ((*good[:5], 1.5, None), "confidence"), ((*good[:6], ""), "suggested action")]
    rows = spark.createDataFrame([("あいうえ", c) for c, _ in cases], schema)
    assert [r[0] for r in rows.select(R.semantic_problems(F.col("text"), F.col("f"))).collect()] == [p for _, p in cases]
    wide = spark.createDataFrame([("😀あい", ("S203", "violation", (2, 4), ["あい"], "r", 0.9, None))], schema)
    assert wide.select(R.semantic_problems(F.col("text"), F.col("f"))).first()[0] is None


def test_saved_judgements_join_and_ties(spark):
    docs = spark.createDataFrame([(0, "あ"), (1, "い")], "doc_id long, text string")
    saved = spark.createDataFrame([(0, "S202", "violation", (0, 1), ["b"], "r", 0.9, "x"), (0, "S202", "violation", (0, 1), ["b"], "r", 0.9, None), (0, "S202", "violation", (0, 1), ["a", "z"], "r", 0.9, None), (0, "S201", "uncertain", (0, 1), ["b"], "r", 0.1, None)], "doc_id long, ruleId string, status string, range struct<start:int,end:int>, evidence array<string>, reason string, confidence double, suggestedAction string")
    rows = {r.doc_id: r for r in R.report(R.join_semantic(docs, saved), {"rules": {}}, semantic="semantic").collect()}
    assert [(n.ruleId, n.evidence, n.suggestedAction, n.level) for n in rows[0].semanticNotices] == [("S201", ["b"], None, "notice"), ("S202", ["a", "z"], None, "notice"), ("S202", ["b"], None, "notice"), ("S202", ["b"], "x", "notice")]
    assert rows[1].semanticNotices == [] and rows[0].exitCode == 0


def test_evaluation(spark):
    fixtures = spark.createDataFrame([("S201", "a", "violation"), ("S201", "b", "no_violation"), ("S202", "c", "uncertain")], "ruleId string, fixtureId string, expectedStatus string")
    seen = spark.createDataFrame([("a", "violation"), ("b", "uncertain")], "fixtureId string, observedStatus string")
    assert {r.ruleId: (r.n, r.agree, r.passed) for r in semantic.evaluate(fixtures, seen).collect()} == {"S201": (2, 1, False), "S202": (1, 0, False)}


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.md").write_text("一。\n二。", encoding="utf-8")
    assert [r.text for r in files.texts(spark, str(tmp_path / "t")).collect()] == ["一。\n二。"]
    saved = {"ruleId": "S203", "meaning": "m", "cases": [{"fixtureId": "P01", "input": "x", "expectedStatus": "violation", "observedStatus": "violation"}]}
    (tmp_path / "s.json").write_text(json.dumps(saved))
    assert [(r.ruleId, r.fixtureId) for r in files.cases(spark, str(tmp_path / "s.json")).collect()] == [("S203", "P01")]


def test_config_file(tmp_path):
    (tmp_path / "config.json").write_text(json.dumps({"rules": {"H101": {"ruleId": "H101"}}}))
    assert load({"KOTOMILL_CONFIG_HOME": str(tmp_path), "HOME": "/nowhere"}).enabled[0].threshold == 100
    (tmp_path / "kotomill").mkdir()
    (tmp_path / "kotomill/config.json").write_text("{}")
    with pytest.raises(ConfigurationError):
        load({"KOTOMILL_CONFIG_HOME": "", "XDG_CONFIG_HOME": str(tmp_path)})
    with pytest.raises(ConfigurationError):
        load({})


def test_usage(capsys):
    assert cli.main([]) == 2 and cli.main(["--analyze"]) == 2 and cli.main(["--other", "x"]) == 2 and cli.main(["--input", "/missing"]) == 2
    assert capsys.readouterr().out == ""


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(k, "必ず雨が降る。" * (k % 3)) for k in range(20)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    config = {"rules": {"D004": {"ruleId": "D004", "forbiddenTerms": ["必ず"]}, "H107": {"ruleId": "H107", "threshold": 1}}}
    stream = streaming.documents(spark, str(tmp_path / "in"), "doc_id long, text string", files=1)
    rows = streaming.findings(stream, config)
    streaming.write(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted(map(tuple, spark.read.schema(rows.schema).parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == sorted(map(tuple, streaming.analyze(docs, config).collect()), key=str) and got


def test_stream_counts_append(spark, tmp_path):
    """Counts come out in append mode once the watermark has passed their window; later rows of such a window are dropped."""
    start = 1_700_000_100  # a window's start
    parts = [[(start + k, "いい") for k in range(3)] + [(start + 299, "いい。いい")], [(start + 2000, "い")], [(start + 2001, "いい")], [(start + 5, "いい"), (start + 2002, "い")], [(start + 9000, "い")]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "at long, text string").select(F.timestamp_seconds("at").alias("at"), "text").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        os.utime(next((tmp_path / f"in/{k}").glob("part-*")), (start + k, start + k))
    stream = streaming.documents(spark, f"{tmp_path}/in/*", "at timestamp, text string", files=1)
    rows = streaming.counts(stream, {"rules": {"D007": {"ruleId": "D007", "patterns": ["いい"]}}}, "at")
    streaming.write(rows.select(F.unix_timestamp("window.start").alias("w"), "rule_id", "n"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [(start, "D007", 5), (start + 1800, "D007", 1)]


def test_analyze_command(tmp_path, monkeypatch, capsys, spark):
    """--analyze reads the configuration's file, prints one report and exits with its code."""
    (tmp_path / "config.json").write_text(json.dumps({"rules": {"D003": {"ruleId": "D003"}, "H101": {"ruleId": "H101", "threshold": 5}}}))
    (tmp_path / "a.md").write_text("（港に船が着く。]", encoding="utf-8")
    (tmp_path / "b.md").write_text("短い。", encoding="utf-8")
    monkeypatch.setenv("KOTOMILL_CONFIG_HOME", str(tmp_path))
    assert cli.main(["--analyze", str(tmp_path / "a.md")]) == 1
    out = capsys.readouterr().out
    built = json.loads(out)
    R.check_report(built)
    assert [m["ruleId"] for m in built["lintMessages"]] == ["H101", "D003"] and out.count("\n") == 1
    assert cli.main(["--analyze", str(tmp_path / "b.md")]) == 0 and json.loads(capsys.readouterr().out)["lintMessages"] == []
    (tmp_path / "config.json").write_text("{")
    assert cli.main(["--analyze", str(tmp_path / "b.md")]) == 2 and capsys.readouterr().out == ""


def test_envelope_files_and_lines(spark, tmp_path):
    """Envelopes from files, one each or one a line; reports written one a line."""
    (tmp_path / "e").mkdir()
    for k, (text, *_) in enumerate(catalog.ENVELOPES):
        (tmp_path / f"e/{k:02}.json").write_text(text, encoding="utf-8")
    (tmp_path / "all.jsonl").write_text("\n".join(t for t, *_ in catalog.ENVELOPES), encoding="utf-8")
    expected = sorted(c for _, c, *_ in catalog.ENVELOPES)
    for rows in (files.envelopes(spark, str(tmp_path / "e")), files.envelopes(spark, str(tmp_path / "all.jsonl"), lines=True)):
        assert sorted(r.exit_code for r in envelopes.reports_of(rows, "value").collect()) == expected
    docs = spark.createDataFrame([(0, "（"), (1, "")], "doc_id long, text string")
    files.write_lines(R.as_json(R.report(docs, {"rules": {"D003": {"ruleId": "D003"}}})), str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(x["exitCode"] for x in lines) == [0, 1] and [R.check_report(x) for x in lines]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_catalogue_against_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    expected = db.execute(catalog.ORACLES[name])
    names = [c[0] for c in expected.description]
    rows = catalog.QUERIES[name](spark, folder)
    assert sorted(rows.columns) == sorted(names)
    assert sorted(map(tuple, rows.select(*names).collect()), key=str) == sorted(expected.fetchall(), key=str)
