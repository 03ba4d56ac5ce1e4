"""The rules: each turns a document's columns into an array of findings, without leaving the row.

No rule shuffles, so any set of them is one narrow stage over the documents and also runs on a stream.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PAIRS, Rule
from ..functions import japanese as ja
from ..functions import utf16
from ..functions.utf16 import let
from ..messages import TEXT
from ..schema import DETERMINISTIC, FINDING
from .scans import Brackets, Terms, repeated

#: Structure that each rule reads; {s} is the sentence field that code exclusion selects.
NEEDS = {
    "D001": ("sentences", "texts"), "D002": ("decomposed",), "D006": ("code",), "H101": ("{s}",), **{r: ("{s}", "texts") for r in ("H102", "H103", "H104", "H106")},
    **{r: ("{s}", "texts", "homes") for r in ("H107", "H108")}, "H112": ("paragraphs",), "H113": ("paragraphs", "counts"),
}


# What D001 leaves out of a sentence, and the endings of either style.
QUOTED = "「[^」]*」|『[^』]*』|“[^”]*”|‘[^’]*’"
POLITE = ("です", "ます", "でした", "ました", "ません", "ませんでした", "でしょう", "ましょう")
PLAIN = ("である", "であった", "だ", "だった")


def scan_of(rule: Rule) -> Terms | Brackets | None:
    """The scan of the text outside code whose hits a rule reports."""
    if rule.rule_id == "D003":
        return Brackets(rule.pairs)
    if rule.rule_id in ("D004", "D007"):
        return Terms(rule.terms, rule.rule_id == "D004")
    return Terms(tuple(rule.mapping)) if rule.rule_id in ("D005", "D008") else None


class Pass:
    """The columns that rules read: the text, and fields of the structure pass."""

    def __init__(self, text: Column, found: Column, exclude_code: bool):
        self.text, self._found, self._exclude = text, found, exclude_code

    def __getitem__(self, name: str) -> Column:
        return self._found[name]

    @property
    def sentences(self) -> Column:
        return self["outside" if self._exclude else "sentences"]


def finding(rule: Rule, span: Column, message: Column, actual: Column | None = None) -> Column:
    kind = "deterministic" if rule.rule_id in DETERMINISTIC else "heuristic"
    seen = [F.lit(None) if actual is None else actual, F.lit(rule.threshold)]
    return F.struct(
        span["start"].cast("int").alias("start"), span["end"].cast("int").alias("end"), F.lit(rule.rule_id).alias("rule_id"), F.lit(kind).alias("category"), F.lit(rule.severity).alias("severity"),
        message.alias("message"), seen[0].cast("int").alias("actual"), (seen[1] if actual is not None else F.lit(None)).cast("int").alias("threshold"),
    )


def text_of(template: str, **parts: Column) -> Column:
    """The template with its {names} replaced by columns."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*(parts[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p))


def none() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def _lookup(key: Column, table) -> Column:
    return reduce(lambda c, kv: c.when(key == kv[0], F.lit(kv[1])), table.items(), F.when(F.lit(False), F.lit("")))


def d001(rule: Rule, of: Pass) -> Column:
    ends = lambda words: rf"\A[{utf16.SPACE}]*+[。！？!?]*+[{utf16.SPACE}]*+{ja.reversed_endings(words)}"
    spoken = lambda t: F.when(t.rlike("[「『“‘]"), F.regexp_replace(t, QUOTED, "")).otherwise(t)
    style = lambda t: let(F.reverse(spoken(t)), lambda back: F.when(back.rlike(ends(POLITE)), F.lit("desu-masu")).when(back.rlike(ends(PLAIN)), F.lit("da-dearu")))
    told = F.filter(F.transform(of["sentences"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), style(s["text"]).alias("style"))), lambda s: s["style"].isNotNull())
    report = lambda rows, base: F.transform(F.filter(rows, lambda s: s["style"] != base), lambda s: finding(rule, s, text_of(TEXT["D001"], a=base, b=s["style"])))
    if rule.style != "consistent":
        return report(told, F.lit(rule.style))
    return let(told, lambda t: let(F.get(t, F.lit(0))["style"], lambda base: report(t, base)))


def d002(rule: Rule, of: Pass) -> Column:
    return F.transform(of["decomposed"], lambda s: finding(rule, s, F.lit(TEXT["D002"])))


def d003(rule: Rule, of: Pass) -> Column:
    return F.transform(of["D003"], lambda s: finding(rule, s, text_of(TEXT["D003"], t=s["text"])))


def d004(rule: Rule, of: Pass) -> Column:
    return F.transform(of["D004"], lambda s: finding(rule, s, text_of(TEXT["D004"], t=s["text"])))


def d005(rule: Rule, of: Pass) -> Column:
    return F.transform(of["D005"], lambda s: finding(rule, s, text_of(TEXT["D005"], t=s["text"], x=_lookup(s["text"], rule.mapping))))


def d006(rule: Rule, of: Pass) -> Column:
    return F.transform(repeated(of.text, of["code"], rule.max_consecutive), lambda s: finding(rule, s, F.lit(TEXT["D006"])))


def d007(rule: Rule, of: Pass) -> Column:
    return F.transform(of["D007"], lambda s: finding(rule, s, text_of(TEXT["D007"], t=s["text"])))


def d008(rule: Rule, of: Pass) -> Column:
    return F.transform(of["D008"], lambda s: finding(rule, s, text_of(TEXT["D008"], t=s["text"], x=_lookup(s["text"], rule.mapping))))


def _over(rule: Rule, rows: Column, metric: Callable[[Column], Column], message: str) -> Column:
    """Findings for the rows whose metric passes the threshold."""
    seen = F.transform(rows, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), metric(s).cast("int").alias("actual")))
    return F.transform(F.filter(seen, lambda s: s["actual"] > rule.threshold), lambda s: finding(rule, s, text_of(message, t=F.lit(rule.threshold), a=s["actual"]), s["actual"]))


def h101(rule: Rule, of: Pass) -> Column:
    return _over(rule, of.sentences, lambda s: s["end"] - s["start"], TEXT["H101"])


def h102(rule: Rule, of: Pass) -> Column:
    return _over(rule, of.sentences, lambda s: ja.predicate_count(s["text"]), TEXT["H102"])


def h103(rule: Rule, of: Pass) -> Column:
    return _over(rule, of.sentences, lambda s: F.length(s["text"]) - F.length(F.replace(s["text"], F.lit("、"), F.lit(""))), TEXT["H103"])


def depth(text: Column) -> Column:
    """The deepest nesting of the fixed pairs; null if they don't balance. The stack is a short string."""
    opens, closes = "".join(p[0] for p in PAIRS), "".join(p[1] for p in PAIRS)
    marks = F.regexp_extract_all(text, F.lit("[" + re.escape(opens + closes) + "]"), F.lit(0))
    start = F.struct(F.lit("").alias("stack"), F.lit(0).alias("most"), F.lit(True).alias("ok"))

    def step(s: Column, c: Column) -> Column:
        wants = F.translate(c, opens, closes)
        opening = wants != c
        stack = F.when(opening, F.concat(s["stack"], wants)).otherwise(F.substring(s["stack"], F.lit(1), F.greatest(F.lit(0), F.length(s["stack"]) - 1)))
        fits = opening | (F.right(s["stack"], F.lit(1)) == c)
        return F.struct(stack.alias("stack"), F.greatest(s["most"], F.length(stack)).alias("most"), (s["ok"] & fits).alias("ok"))

    return F.aggregate(marks, start, step, lambda s: F.when(s["ok"] & (s["stack"] == ""), s["most"]))


def h104(rule: Rule, of: Pass) -> Column:
    return _over(rule, of.sentences, lambda s: depth(s["text"]), TEXT["H104"])


def h106(rule: Rule, of: Pass) -> Column:
    rows = of.sentences
    n = F.size(rows)
    span = F.struct(F.get(rows, F.lit(0))["start"].alias("start"), F.get(rows, n - 1)["end"].alias("end"))

    def judged(found: Column) -> Column:
        actual = F.floor(F.when(n > 0, found.cast("double") * 100 / n) + 0.5).cast("int")
        one = F.array(finding(rule, span, text_of(TEXT["H106"], t=F.lit(rule.threshold), a=actual), actual))
        return F.when((n >= 3) & (found >= 3) & (actual > rule.threshold), one).otherwise(none())

    return let(F.aggregate(rows, F.lit(0), lambda a, s: a + F.size(ja.demonstratives(s["text"]))), judged)


def _runs(rule: Rule, of: Pass, label: Callable[[Column], Column], message: str) -> Column:
    """Maximal runs of neighbours with one label in one paragraph, by the positions where a run starts and ends."""
    keyed = F.transform(of.sentences, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(s["paragraph"].cast("string"), F.lit(":"), label(s["text"])).alias("key")))
    # (run start, actual, end) grows only when a run ends; the open run is a struct
    empty = F.array().cast("array<struct<start:int,end:int,actual:int>>")
    zero = F.struct(F.lit(None).cast("string").alias("key"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("n"), empty.alias("runs"))

    def done(a: Column) -> Column:
        return F.when(a["n"] > rule.threshold, F.concat(a["runs"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end"), a["n"].alias("actual"))))).otherwise(a["runs"])

    def step(a: Column, s: Column) -> Column:
        same = F.coalesce(a["key"] == s["key"], F.lit(False))
        counted = F.when(s["key"].isNull(), 0).when(same, a["n"] + 1).otherwise(1)
        return F.struct(s["key"].alias("key"), F.when(same, a["start"]).otherwise(s["start"]).alias("start"), s["end"].alias("end"), counted.alias("n"), F.when(same, a["runs"]).otherwise(done(a)).alias("runs"))

    runs = F.aggregate(keyed, zero, step, done)
    return F.transform(runs, lambda s: finding(rule, s, text_of(message, t=F.lit(rule.threshold), a=s["actual"]), s["actual"]))


def h107(rule: Rule, of: Pass) -> Column:
    return _runs(rule, of, ja.leading, TEXT["H107"])


def h108(rule: Rule, of: Pass) -> Column:
    return _runs(rule, of, ja.terminal, TEXT["H108"])


def h112(rule: Rule, of: Pass) -> Column:
    return _over(rule, of["paragraphs"], lambda p: utf16.length(p["text"]), TEXT["H112"])


def h113(rule: Rule, of: Pass) -> Column:
    return _over(rule, of["paragraphs"], lambda p: p["sentences"], TEXT["H113"])


RULES: dict[str, Callable[[Rule, Pass], Column]] = {
    "D001": d001, "D002": d002, "D003": d003, "D004": d004, "D005": d005, "D006": d006, "D007": d007, "D008": d008,
    "H101": h101, "H102": h102, "H103": h103, "H104": h104, "H106": h106, "H107": h107, "H108": h108, "H112": h112, "H113": h113,
}
__all__ = ["NEEDS", "RULES", "Pass", "depth", "finding", "scan_of"]
