"""Reports: findings and saved semantic judgements of a document in one canonical order, with an exit code.

Texts compare by UTF-16 units, as their UTF-16BE bytes do: U+FFFD comes after any character beyond U+FFFF.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ContractValidationError
from ..schema import DETERMINISTIC, HEURISTIC, SEMANTIC, SEMANTIC_RULES, STATUSES
from .lint import exit_code, with_findings

VERSION = "1.0.0"


def _units(text: Column) -> Column:
    """The sort key of a text by UTF-16 units."""
    return F.encode(text, "UTF-16BE")


def lint_messages(findings: Column) -> Column:
    """The messages in report order: start, end, rule, category, severity, text; repeats stay."""
    keyed = F.transform(findings, lambda f: F.struct(f["start"].alias("a"), f["end"].alias("b"), f["rule_id"].alias("c"), f["category"].alias("d"), f["severity"].alias("e"), _units(f["message"]).alias("f"), f["message"].alias("g")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["c"].alias("ruleId"), x["d"].alias("category"), F.struct(x["a"].alias("start"), x["b"].alias("end")).alias("range"), x["g"].alias("message"), x["e"].alias("level")))


def semantic_notices(findings: Column) -> Column:
    """The notices in report order; array fields compare item by item and a missing action comes first."""
    names = ("ruleId", "status", "evidence", "reason", "confidence", "suggestedAction")
    order = {"evidence": lambda f: F.transform(f["evidence"], _units), "reason": lambda f: _units(f["reason"]), "suggestedAction": lambda f: _units(f["suggestedAction"])}
    keyed = F.transform(findings, lambda f: F.struct(f["range"]["start"].alias("start"), f["range"]["end"].alias("end"), *(order.get(n, lambda f, n=n: f[n])(f).alias(f"by_{n}") for n in names), *(f[n].alias(n) for n in names)))
    notice = lambda x: F.struct(x["ruleId"].alias("ruleId"), x["status"].alias("status"), F.struct(x["start"].alias("start"), x["end"].alias("end")).alias("range"), *(x[n].alias(n) for n in names[2:]), F.lit("notice").alias("level"))
    return F.transform(F.array_sort(keyed), notice)


def report(docs: DataFrame, config: Any, key: str = "doc_id", text: str = "text", semantic: str | None = None) -> DataFrame:
    """(key, schemaVersion, exitCode, lintMessages, semanticNotices), one row per document, without a shuffle.

    ``semantic`` may name an array column of saved judgements. A null text has null messages and exit code 2.
    """
    extra = F.col(semantic) if semantic else F.array().cast(f"array<{SEMANTIC}>")
    rows = with_findings(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), extra.alias("semantic")), config)
    code = F.when(F.col("findings").isNull(), F.lit(2)).otherwise(exit_code(F.col("findings")))
    return rows.select(F.col("key").alias(key), F.lit(VERSION).alias("schemaVersion"), code.alias("exitCode"), lint_messages(F.col("findings")).alias("lintMessages"), semantic_notices(F.col("semantic")).alias("semanticNotices"))


def join_semantic(docs: DataFrame, saved: DataFrame, key: str = "doc_id", column: str = "semantic") -> DataFrame:
    """The documents with their saved judgements (a table of key and the fields of SEMANTIC) as an array column."""
    names = [c for c in saved.columns if c != key]
    grouped = saved.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct(*names)).alias(column))
    return docs.join(grouped, F.col(key) == F.col("_key"), "left").drop("_key").withColumn(column, F.coalesce(column, F.array().cast(f"array<{SEMANTIC}>")))


def as_json(reports: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, json): the canonical JSON line of each report."""
    return reports.select(key, F.to_json(F.struct("schemaVersion", "exitCode", "lintMessages", "semanticNotices")).alias("json"))


def semantic_problems(text: Column, finding: Column) -> Column:
    """The first rule that a saved judgement breaks, or null. Native, for judgements held in a table."""
    from ..functions import utf16

    f, units = finding, utf16.length(text)
    start, end = f["range"]["start"], f["range"]["end"]
    bad = lambda c, name: F.when(~F.coalesce(c, F.lit(False)), F.lit(name))
    # a UTF-16 slice of text without wide characters is a substring; with them the slice is cut from its encoding
    part = F.when(units == F.length(text), F.substring(text, start + 1, end - start)).otherwise(F.decode(F.substring(F.encode(text, "UTF-16BE"), start * 2 + 1, (end - start) * 2), "UTF-16BE"))
    inside = F.forall(f["evidence"], lambda e: F.contains(part, e))
    return F.coalesce(
        bad(f["ruleId"].isin(*SEMANTIC_RULES), "rule"),
        bad(f["status"].isin(*STATUSES), "status"),
        bad((start >= 0) & (start < end) & (end <= units), "range"),
        bad((F.size(f["evidence"]) > 0) & F.forall(f["evidence"], lambda e: e.isNotNull() & (e != "")), "evidence"),
        bad((f["status"] != "violation") | inside, "evidence outside range"),
        bad(f["reason"] != "", "reason"),
        bad((f["confidence"] >= 0) & (f["confidence"] <= 1) & ~F.isnan(f["confidence"]), "confidence"),
        bad(f["suggestedAction"].isNull() | (f["suggestedAction"] != ""), "suggested action"),
    )


# Closed-schema checks of one JSON envelope or report on the driver; tables of envelopes go through ``envelopes``.


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ContractValidationError(f"invalid {what}")


def _keys(value: Any, what: str, need: str, may: str = "") -> dict:
    _check(isinstance(value, dict) and set(need.split()) <= set(value) <= set(f"{need} {may}".split()), what)
    return value


def _whole(x: Any) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool) and x == x and abs(x) != float("inf") and x == int(x)


def _text(x: Any, what: str) -> None:
    _check(isinstance(x, str) and x != "", what)


def _range(value: Any, units: int | None) -> tuple[int, int]:
    _keys(value, "range", "start end")
    s, e = value["start"], value["end"]
    _check(_whole(s) and _whole(e) and 0 <= s < e and (units is None or e <= units), "range")
    return int(s), int(e)


def _finding(x: Any, units: int) -> None:
    _check(isinstance(x, dict), "finding")
    common = "ruleId category range severity message"
    if x.get("category") == "deterministic":
        _keys(x, "deterministic finding", common)
        _check(x["ruleId"] in DETERMINISTIC and x["severity"] in ("error", "warning"), "deterministic finding")
    else:
        _check(x.get("category") == "heuristic", "category")
        _keys(x, "heuristic finding", f"{common} actual threshold")
        _check(x["ruleId"] in HEURISTIC and x["severity"] == "warning", "heuristic finding")
        _check(all(_whole(x[k]) and x[k] >= 0 for k in ("actual", "threshold")), "observation")
    _range(x["range"], units)
    _text(x["message"], "message")


def _judgement(x: Any, units: bytes | None, level: bool = False) -> None:
    need = "ruleId status range evidence reason confidence" + " level" * level
    _keys(x, "semantic finding", need, "suggestedAction")
    _check(isinstance(x["ruleId"], str) and x["ruleId"] in SEMANTIC_RULES and x["status"] in STATUSES and (not level or x["level"] == "notice"), "semantic finding")
    s, e = _range(x["range"], None if units is None else len(units) // 2)
    evidence = x["evidence"]
    _check(isinstance(evidence, list) and bool(evidence) and all(isinstance(i, str) and i for i in evidence), "evidence")
    if x["status"] == "violation" and units is not None:
        part = units[2 * s : 2 * e].decode("utf-16-le", "surrogatepass")
        _check(all(i in part for i in evidence), "evidence outside range")
    _text(x["reason"], "reason")
    c = x["confidence"]
    _check(isinstance(c, int | float) and not isinstance(c, bool) and 0 <= c <= 1, "confidence")
    if "suggestedAction" in x:
        _text(x["suggestedAction"], "suggested action")


def _no_constant(name: str) -> None:
    raise ContractValidationError(f"invalid number {name}")


def parse_envelope(text: str) -> dict:
    """A checked {input, findings, semanticFindings}, or ContractValidationError."""
    try:
        value = json.loads(text, parse_constant=_no_constant)
    except ValueError as e:
        raise ContractValidationError("invalid JSON") from e
    _keys(value, "envelope", "input findings semanticFindings")
    _text(value["input"], "input")
    _check(isinstance(value["findings"], list) and isinstance(value["semanticFindings"], list), "arrays")
    units = value["input"].encode("utf-16-le", "surrogatepass")
    for x in value["findings"]:
        _finding(x, len(units) // 2)
    for x in value["semanticFindings"]:
        _judgement(x, units)
    return value


def build_report(findings: list[dict], semantic: list[dict]) -> dict:
    """The report of one document."""
    place = lambda f: (f["range"]["start"], f["range"]["end"], f["ruleId"])
    units = lambda x: x.encode("utf-16-be", "surrogatepass")
    lint = sorted(findings, key=lambda f: (*place(f), f["category"], f["severity"], units(f["message"])))
    notes = sorted(semantic, key=lambda f: (*place(f), f["status"], [*map(units, f["evidence"])], units(f["reason"]), f["confidence"], "suggestedAction" in f, units(f.get("suggestedAction", ""))))
    failed = any(f["category"] == "deterministic" and f["severity"] == "error" for f in lint)
    messages = [{"ruleId": f["ruleId"], "category": f["category"], "range": dict(f["range"]), "message": f["message"], "level": f["severity"]} for f in lint]
    notices = [{k: f[k] for k in ("ruleId", "status", "range", "evidence", "reason", "confidence")} | {"level": "notice"} | ({"suggestedAction": f["suggestedAction"]} if "suggestedAction" in f else {}) for f in notes]
    return {"schemaVersion": VERSION, "exitCode": int(failed), "lintMessages": messages, "semanticNotices": notices}


def check_report(value: Any) -> None:
    """Raises ContractValidationError unless the value is a report."""
    _keys(value, "report", "schemaVersion exitCode lintMessages semanticNotices")
    _check(value["schemaVersion"] == VERSION and value["exitCode"] in (0, 1) and isinstance(value["lintMessages"], list) and isinstance(value["semanticNotices"], list), "report")
    for m in value["lintMessages"]:
        _keys(m, "message", "ruleId category range message level")
        known = DETERMINISTIC if m["category"] == "deterministic" else HEURISTIC if m["category"] == "heuristic" else ()
        _check(m["ruleId"] in known and m["level"] in (("error", "warning") if known is DETERMINISTIC else ("warning",)), "message")
        _range(m["range"], None)
        _text(m["message"], "message")
    for n in value["semanticNotices"]:
        _judgement(n, None, level=True)


def line(value: dict) -> str:
    """Canonical JSON: whole numbers without a fraction."""
    plain = lambda x: int(x) if isinstance(x, float) and x.is_integer() else {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, list) else x
    return json.dumps(plain(value), ensure_ascii=False, separators=(",", ":"))
