"""Closed-schema checks of JSON envelopes, and their reports, in column expressions over VARIANT values.

An envelope that breaks the contract has exit code 2, no report, and the first rule that it breaks, in the order in which ``report.parse_envelope``
reads it; a JSON object that names a key twice is no JSON here. Nothing leaves the JVM, and a row's cost grows with its envelope only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.utf16 import let
from ..schema import DETERMINISTIC, HEURISTIC, SEMANTIC_RULES, STATUSES
from . import report as reports

NUMBERS = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT")
COMMON = ("ruleId", "category", "range", "severity", "message")
JUDGED = ("ruleId", "status", "range", "evidence", "reason", "confidence")


def _is(value: Column, *kinds: str) -> Column:
    """Whether a value is of one of the kinds of scalars; of a whole object or array this would read all that it holds."""
    return F.coalesce(F.schema_of_variant(value).rlike(rf"\A(?:{'|'.join(kinds)})(?![A-Z])"), F.lit(False))


def _string(value: Column) -> Column:
    """The text of a JSON string, null for anything else."""
    return F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string"))


def _number(value: Column) -> Column:
    return F.when(_is(value, *NUMBERS), F.try_variant_get(value, "$", "double"))


def _object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _at(fields: Column, name: str) -> Column:
    return F.try_element_at(fields, F.lit(name))


def _bad(ok: Column, what: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"invalid {what}"))


def _keys(fields: Column, need: tuple[str, ...], may: tuple[str, ...] = ()) -> Column:
    """Whether an object has all the needed keys and no others but those it may have."""
    names = F.map_keys(fields)
    lits = lambda x: F.array(*map(F.lit, x))
    return fields.isNotNull() & (F.size(F.array_except(lits(need), names)) == 0) & (F.size(F.array_except(names, lits((*need, *may)))) == 0)


def _integral(n: Column) -> Column:
    # doubles from 2^53 on have no fraction, and may be too large for floor
    return F.when(F.abs(n) < 2.0**53, n == F.floor(n).cast("double")).otherwise(F.abs(n) < float("inf"))


def _range_problem(value: Column, units: Column) -> Column:
    def of(r: Column) -> Column:
        ends = F.struct(_number(_at(r, "start")).alias("s"), _number(_at(r, "end")).alias("e"))
        inside = let(ends, lambda x: _integral(x["s"]) & _integral(x["e"]) & (x["s"] >= 0) & (x["s"] < x["e"]) & (x["e"] <= units))
        return _bad(_keys(r, ("start", "end")) & inside, "range")

    return let(_object(value), of)


def _said(value: Column, what: str) -> Column:
    return _bad(_string(value) != "", what)


def finding_problem(value: Column, units: Column) -> Column:
    """What is wrong with a finding, or null."""

    def of(f: Column) -> Column:
        return let(F.struct(*(_string(_at(f, k)).alias(k) for k in ("ruleId", "category", "severity"))), lambda named: told(f, named))

    def told(f: Column, named: Column) -> Column:
        rule, category, severity = named["ruleId"], named["category"], named["severity"]
        plain = F.coalesce(_bad(_keys(f, COMMON), "deterministic finding"), _bad(rule.isin(*DETERMINISTIC) & severity.isin("error", "warning"), "deterministic finding"))
        counted = lambda k: let(_number(_at(f, k)), lambda n: _integral(n) & (n >= 0))
        rated = F.coalesce(_bad(_keys(f, (*COMMON, "actual", "threshold")), "heuristic finding"), _bad(rule.isin(*HEURISTIC) & (severity == "warning"), "heuristic finding"), _bad(counted("actual") & counted("threshold"), "observation"))
        return F.coalesce(_bad(f.isNotNull(), "finding"), F.when(category == "deterministic", plain).when(category == "heuristic", rated).otherwise(F.lit("invalid category")), _range_problem(_at(f, "range"), units), _said(_at(f, "message"), "message"))

    return let(_object(value), of)


def _part(encoded: Column, start: Column, end: Column) -> Column:
    """A UTF-16 slice of a text in UTF-16BE: only the slice is read, wherever in the text it is."""
    s, n = start.cast("int"), (end - start).cast("int")
    return F.decode(F.substring(encoded, s * 2 + 1, n * 2), "UTF-16BE")


def judgement_problem(value: Column, encoded: Column, units: Column) -> Column:
    """What is wrong with a saved judgement on the text, given in UTF-16BE with its length, or null."""

    def of(f: Column) -> Column:
        named = F.struct(*(_string(_at(f, k)).alias(k) for k in ("ruleId", "status")), _array(_at(f, "evidence")).alias("evidence"), _number(_at(f, "confidence")).alias("confidence"))
        return let(named, lambda named: told(f, named))

    def told(f: Column, named: Column) -> Column:
        rule, status, evidence, confidence = (named[k] for k in ("ruleId", "status", "evidence", "confidence"))
        part = let(_object(_at(f, "range")), lambda where: _part(encoded, _number(_at(where, "start")), _number(_at(where, "end"))))
        held = let(part, lambda p: F.forall(evidence, lambda e: F.contains(p, _string(e))))
        return F.coalesce(
            _bad(_keys(f, JUDGED, ("suggestedAction",)), "semantic finding"),
            _bad(rule.isin(*SEMANTIC_RULES) & status.isin(*STATUSES), "semantic finding"),
            _range_problem(_at(f, "range"), units),
            _bad((F.size(evidence) > 0) & F.forall(evidence, lambda e: F.coalesce(_string(e) != "", F.lit(False))), "evidence"),
            _bad((status != "violation") | held, "evidence outside range"),
            _said(_at(f, "reason"), "reason"),
            _bad((confidence >= 0) & (confidence <= 1), "confidence"),
            F.when(F.array_contains(F.map_keys(f), "suggestedAction"), _said(_at(f, "suggestedAction"), "suggested action")),
        )

    return let(_object(value), of)


def _first(items: Column, problem: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(F.transform(items, problem), lambda p: p.isNotNull()), F.lit(0))


def envelope_problem(fields: Column) -> Column:
    """What is wrong with an envelope, given as a map of its keys, or null."""

    def of(parts: Column) -> Column:
        text, findings, judged = parts["text"], parts["findings"], parts["judged"]
        measured = let(F.encode(text, "UTF-16BE"), lambda encoded: let(F.struct(encoded.alias("encoded"), (F.octet_length(encoded) / 2).cast("int").alias("units")), inside(findings, judged)))
        return F.coalesce(_bad(_keys(fields, ("input", "findings", "semanticFindings")), "envelope"), _bad(text != "", "input"), _bad(findings.isNotNull() & judged.isNotNull(), "arrays"), measured)

    def inside(findings: Column, judged: Column) -> Callable[[Column], Column]:
        return lambda t: F.coalesce(_first(findings, lambda x: finding_problem(x, t["units"])), _first(judged, lambda x: judgement_problem(x, t["encoded"], t["units"])))

    # read once: inside lambdas every mention of the text would read all of it for each finding
    return let(F.struct(_string(_at(fields, "input")).alias("text"), _array(_at(fields, "findings")).alias("findings"), _array(_at(fields, "semanticFindings")).alias("judged")), of)


def _where(f: Column) -> tuple[Column, Column]:
    r = _object(_at(f, "range"))
    return _number(_at(r, "start")).cast("int"), _number(_at(r, "end")).cast("int")


def _typed_finding(value: Column) -> Column:
    def of(f: Column) -> Column:
        s, e = _where(f)
        return F.struct(s.alias("start"), e.alias("end"), *(_string(_at(f, k)).alias(n) for k, n in (("ruleId", "rule_id"), ("category", "category"), ("severity", "severity"), ("message", "message"))))

    return let(_object(value), of)


def _typed_judgement(value: Column) -> Column:
    def of(f: Column) -> Column:
        s, e = _where(f)
        return F.struct(
            *(_string(_at(f, k)).alias(k) for k in ("ruleId", "status")), F.struct(s.alias("start"), e.alias("end")).alias("range"), F.transform(_array(_at(f, "evidence")), _string).alias("evidence"),
            _string(_at(f, "reason")).alias("reason"), _number(_at(f, "confidence")).alias("confidence"), _string(_at(f, "suggestedAction")).alias("suggestedAction"),
        )

    return let(_object(value), of)


def _as_json(messages: Column, notices: Column, code: Column) -> Column:
    """The canonical line; whole confidences are written without a fraction."""
    number = lambda c: F.parse_json(F.when(c == F.floor(c).cast("double"), c.cast("bigint").cast("string")).otherwise(c.cast("string")))
    plain = F.transform(notices, lambda n: F.struct(*(n[k].alias(k) for k in ("ruleId", "status", "range", "evidence", "reason")), number(n["confidence"]).alias("confidence"), n["level"].alias("level"), n["suggestedAction"].alias("suggestedAction")))
    return F.to_json(F.struct(F.lit(reports.VERSION).alias("schemaVersion"), code.alias("exitCode"), messages.alias("lintMessages"), plain.alias("semanticNotices")))


def reports_of(envelopes: DataFrame, column: str = "value") -> DataFrame:
    """The rows with exit_code, report and error: envelopes that break the contract have code 2, no report and a reason."""

    def of(fields: Column) -> Column:
        def told(problem: Column) -> Column:
            def built(found: Column) -> Column:
                code = F.exists(found, lambda f: (f["category"] == "deterministic") & (f["severity"] == "error")).cast("int")
                notices = F.transform(_array(_at(fields, "semanticFindings")), _typed_judgement)
                return F.struct(code.alias("exit_code"), _as_json(reports.lint_messages(found), reports.semantic_notices(notices), code).alias("report"), F.lit(None).cast("string").alias("error"))

            broken = F.struct(F.lit(2).alias("exit_code"), F.lit(None).cast("string").alias("report"), problem.alias("error"))
            return F.when(problem.isNotNull(), broken).otherwise(let(F.transform(_array(_at(fields, "findings")), _typed_finding), built))

        return let(envelope_problem(fields), told)

    value = F.try_parse_json(F.col(f"`{column}`"))
    no_json = F.struct(F.lit(2).alias("exit_code"), F.lit(None).cast("string").alias("report"), F.lit("invalid JSON").alias("error"))
    checked = let(value, lambda v: F.when(v.isNull(), no_json).otherwise(let(_object(v), of)))
    return envelopes.withColumn("_checked", checked).select(*(F.col(f"`{c}`") for c in envelopes.columns), "_checked.*")
