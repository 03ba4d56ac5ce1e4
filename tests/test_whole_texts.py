"""Rules over the whole texts of a table, against brute force where there is one."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from kotomill.operators.lint import analyze
from kotomill.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rule", ["d001", "d002", "d003", "d006", "h102", "h104", "h106", "h107", "h108"])
def test_ranges_lie_in_their_texts(spark, rule):
    """Over the tables' own texts, which hold what few of these rules report."""
    lengths = {r.doc_id: len(r.text.encode("utf-16-le")) // 2 for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = catalog.QUERIES[f"{rule}_text"](spark, FOLDER).collect()
    assert all(r.rule_id == rule.upper() and 0 <= r.start < r.end <= lengths[r.doc_id] for r in rows)
    assert rows or rule != "d006"


@pytest.mark.parametrize("name", ["d001_styles", "d002_marks", "d003_stack", "d006_groups", "h102_clauses", "h104_nested", "h106_ratio", "h107_runs", "h108_runs", "d002_code", "d003_code", "d004_code_kana", "d005_code", "d007_code", "d008_code", "h107_rows", "h108_rows"])
def test_built_texts_have_findings(spark, name):
    """Over texts built from the tables every rule reports something, in order and for several documents."""
    rows = catalog.QUERIES[name](spark, FOLDER).collect()
    assert len({r.doc_id for r in rows}) > 5
    assert all(r.rule_id == name[:4].upper() and 0 <= r.start < r.end and r.message for r in rows)


def test_decomposed_at_the_end_of_whole_texts(spark):
    """Texts with one decomposed letter behind all they hold: exactly these are flagged, and there."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\n\nが"))).otherwise(F.col("text")).alias("text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id for r in analyze(docs, {"rules": {"D002": {"ruleId": "D002", "normalization": "NFC"}}}).collect()}
    assert found == {d for d, t in texts.items() if unicodedata.normalize("NFC", t) != t} and found
