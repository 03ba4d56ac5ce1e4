"""python -m kotomill --input <envelope.json> | --analyze <text file>: one JSON line and an exit code.

0: no deterministic error; 1: at least one; 2: wrong usage, input or configuration (nothing on stdout).
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from . import config
from .operators import report

PREFIX = "KOTOMILL_INPUT_ERROR"


def _analyzed(path: str) -> dict:
    from pyspark.sql import SparkSession

    from .operators.lint import analyze

    with open(path, encoding="utf-8", newline="") as f:
        text = f.read()
    rules = config.load()
    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    rows = analyze(spark.createDataFrame([(0, text)], "doc_id int, text string"), rules).collect()
    return report.build_report([{"ruleId": r.rule_id, "category": r.category, "severity": r.severity, "message": r.message, "range": {"start": r.start, "end": r.end}} for r in rows], [])


def main(args: Sequence[str]) -> int:
    if len(args) != 2 or args[0] not in ("--input", "--analyze"):
        print(f"{PREFIX}: expected --input <path> or --analyze <path>", file=sys.stderr)
        return 2
    try:
        if args[0] == "--analyze":
            built = _analyzed(args[1])
        else:
            with open(args[1], encoding="utf-8") as f:
                value = report.parse_envelope(f.read())
            built = report.build_report(value["findings"], value["semanticFindings"])
    except (OSError, ValueError):
        print(f"{PREFIX}: invalid input", file=sys.stderr)
        return 2
    print(report.line(built))
    return built["exitCode"]
