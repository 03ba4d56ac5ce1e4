"""Rule configuration: a closed schema, validated on the driver before any plan exists."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Any

from .errors import ConfigurationError
from .schema import DETERMINISTIC, HEURISTIC

# Defaults of the rules.
SEVERITY = {**dict.fromkeys(DETERMINISTIC[:5], "error"), **dict.fromkeys(DETERMINISTIC[5:], "warning")}
THRESHOLD = {"H101": 100, "H102": 4, "H103": 4, "H104": 2, "H106": 50, "H107": 2, "H108": 2, "H112": 500, "H113": 8}
PAIRS = (("（", "）"), ("「", "」"), ("『", "』"), ("【", "】"), ("[", "]"))
STYLES = ("consistent", "desu-masu", "da-dearu")
DOUBLE_NEGATIVES = ("ないわけではない",)
REDUNDANT = MappingProxyType({"することができる": "できる"})


@dataclass(frozen=True)
class Rule:
    """One enabled rule; only the fields of its kind are set."""

    rule_id: str
    severity: str
    threshold: int | None = None
    style: str | None = None
    pairs: tuple[tuple[str, str], ...] = ()
    terms: tuple[str, ...] = ()
    mapping: Mapping[str, str] = field(default_factory=lambda: MappingProxyType({}))
    max_consecutive: int | None = None


@dataclass(frozen=True)
class Config:
    rules: Mapping[str, Rule | None]
    exclude_code_blocks: bool = False

    @property
    def enabled(self) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules.values() if r is not None)


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigurationError(message)


def _closed(value: Any, where: str, *names: str) -> Mapping[str, Any]:
    _need(isinstance(value, Mapping), f"{where} must be an object")
    extra = [k for k in value if k not in names]
    _need(not names or not extra, f"{where} has an unknown field: {extra[:1]}")
    return value


def _texts(value: Any, where: str, some: bool) -> tuple[str, ...]:
    _need(isinstance(value, list | tuple) and all(isinstance(x, str) and x for x in value) and (bool(value) or not some), f"{where} must list non-empty strings")
    return tuple(value)


def _pairs_of(value: Any, where: str, some: bool) -> Mapping[str, str]:
    _closed(value, where)
    _need(all(isinstance(x, str) and x for kv in value.items() for x in kv) and (bool(value) or not some), f"{where} must map non-empty strings to non-empty strings")
    return MappingProxyType(dict(value))


_FIELDS = {"D001": ("style",), "D002": ("normalization",), "D003": ("pairs",), "D004": ("forbiddenTerms",), "D005": ("terminology",), "D006": ("maxConsecutive",), "D007": ("patterns",), "D008": ("replacements",)}


def _deterministic(rule_id: str, raw: Any) -> Rule:
    raw = _closed(raw, rule_id, "ruleId", "severity", *_FIELDS[rule_id])
    _need(raw.get("ruleId") == rule_id, f"{rule_id}.ruleId must match its key")
    severity = raw.get("severity")
    severity = SEVERITY[rule_id] if severity is None else severity
    _need(severity in ("error", "warning"), "severity must be error or warning")
    name = _FIELDS[rule_id][0]
    value, where = raw.get(name), f"{rule_id}.{name}"
    given = name in raw
    if rule_id == "D001":
        _need(value in STYLES, f"{where} is invalid")
        return Rule(rule_id, severity, style=value)
    if rule_id == "D002":
        _need(value == "NFC", f"{where} must be NFC")
        return Rule(rule_id, severity)
    if rule_id == "D003":
        if given:
            _need(isinstance(value, list | tuple) and bool(value), f"{where} must list pairs")
            value = tuple(_texts(p, where, True) for p in value)
            _need(all(len(p) == 2 for p in value), f"{where} must list pairs")
        return Rule(rule_id, severity, pairs=value if given else PAIRS)
    if rule_id == "D004":
        return Rule(rule_id, severity, terms=_texts(value, where, True))
    if rule_id == "D005":
        return Rule(rule_id, severity, mapping=_pairs_of(value, where, True))
    if rule_id == "D006":
        _need(value in (1, 2) and not isinstance(value, bool), f"{where} must be 1 or 2")
        return Rule(rule_id, severity, max_consecutive=int(value))
    if rule_id == "D007":
        return Rule(rule_id, severity, terms=_texts(value, where, False) if given else DOUBLE_NEGATIVES)
    return Rule(rule_id, severity, mapping=_pairs_of(value, where, False) if given else REDUNDANT)


def _heuristic(rule_id: str, raw: Any) -> Rule:
    raw = _closed(raw, rule_id, "ruleId", "threshold", "severity")
    _need(raw.get("ruleId") == rule_id, f"{rule_id}.ruleId must match its key")
    _need("severity" not in raw or raw["severity"] == "warning", f"{rule_id}.severity must be warning")
    value = raw.get("threshold")
    value = THRESHOLD[rule_id] if value is None else value
    whole = isinstance(value, int | float) and not isinstance(value, bool) and value == value and abs(value) != float("inf") and value == int(value)
    _need(whole and value >= 0, f"{rule_id}.threshold must be a non-negative integer")
    return Rule(rule_id, "warning", threshold=int(value))


def validate(raw: Any) -> Config:
    """The checked configuration with defaults, or ConfigurationError. A rule set to false is disabled."""
    raw = _closed(raw, "config", "rules", "exclude")
    rules: dict[str, Rule | None] = {}
    for rule_id, value in _closed(raw.get("rules"), "rules").items():
        _need(rule_id in DETERMINISTIC or rule_id in HEURISTIC, f"unknown rule: {rule_id}")
        rules[rule_id] = None if value is False else (_deterministic if rule_id in DETERMINISTIC else _heuristic)(rule_id, value)
    exclude = _closed(raw["exclude"], "exclude", "codeBlocks") if "exclude" in raw else {}
    code = exclude.get("codeBlocks", False)
    _need(isinstance(code, bool), "exclude.codeBlocks must be boolean")
    return Config(MappingProxyType(rules), code)


def load(environ: Mapping[str, str] = os.environ) -> Config:
    """From the first of KOTOMILL_CONFIG_HOME, XDG_CONFIG_HOME/kotomill and HOME/.config/kotomill that is set and not empty."""
    for name, below in (("KOTOMILL_CONFIG_HOME", ""), ("XDG_CONFIG_HOME", "/kotomill"), ("HOME", "/.config/kotomill")):
        if environ.get(name):
            with open(f"{environ[name]}{below}/config.json", encoding="utf-8") as f:
                return validate(json.load(f))
    raise ConfigurationError("no configuration folder is set")
