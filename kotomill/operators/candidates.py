"""Checked construction of single findings, for callers that build them by hand rather than by rules.

Ranges are UTF-16 units of the input text. Deterministic and heuristic findings keep what the rules' own findings keep; saved
judgements are held to the core's rule here, which asks for evidence of a violation only and does not compare it with the text
(``report.semantic_problems`` and envelopes are stricter).
"""

from __future__ import annotations

from typing import Any

from ..errors import InputValidationError
from .report import _check, _finding, _judgement


def _units(text: Any) -> int:
    if not isinstance(text, str):
        raise InputValidationError("the input must be a text")
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def deterministic(text: Any, rule_id: str, start: int, end: int, severity: str, message: str) -> dict:
    made = {"ruleId": rule_id, "category": "deterministic", "range": {"start": start, "end": end}, "severity": severity, "message": message}
    _finding(made, _units(text))
    return made


def heuristic(text: Any, rule_id: str, start: int, end: int, actual: int, threshold: int, message: str) -> dict:
    made = {"ruleId": rule_id, "category": "heuristic", "range": {"start": start, "end": end}, "severity": "warning", "message": message, "actual": actual, "threshold": threshold}
    _finding(made, _units(text))
    return made


def semantic(text: Any, rule_id: str, status: str, start: int, end: int, evidence: list[str], reason: str, confidence: float, suggested_action: str | None = None) -> dict:
    units = _units(text)
    _check(units > 0, "empty input of a judgement")
    made = {"ruleId": rule_id, "status": status, "range": {"start": start, "end": end}, "evidence": list(evidence), "reason": reason, "confidence": confidence}
    if suggested_action is not None:
        made["suggestedAction"] = suggested_action
    _check(end <= units, "range")
    _check(status != "violation" or bool(evidence), "evidence of a violation")
    _judgement(made if evidence else {**made, "evidence": ["-"]}, None)
    return made
