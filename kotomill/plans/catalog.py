"""The registered queries of the core library and their equivalent SQL.

The tables hold no Japanese, so devices give every rule real input: prose is *lifted* (its
punctuation becomes Japanese, the characters that mean something in Markdown go), literal rules look for frequent
Latin fragments, ``built`` sets Markdown, brackets and Japanese into the prose, and dictionary entries stand among its words.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import japanese as ja
from ..functions import utf16
from ..messages import TEXT
from ..operators import envelopes
from ..operators import report as reports
from ..operators import semantic
from ..operators.lint import analyze
from ..operators.structure import rows_of, structure
from ..sources.files import table
from . import built, judgements, relations
from .built import LIFTED_SQL, TRIM, lifted

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# --- lifted prose ---------------------------------------------------------------------------------

def prose(spark: SparkSession, sf_dir: str, apart: bool = False) -> DataFrame:
    """(doc_id, text, lang): lifted documents; apart: every line a paragraph."""
    docs = table(spark, sf_dir, "documents").select("doc_id", lifted().alias("text"), "lang")
    return docs.withColumn("text", F.regexp_replace("text", "\n", "\n\n")) if apart else docs


DOCS = f"docs AS (SELECT doc_id, lang, {LIFTED_SQL} AS t FROM documents)"
SENTENCES_SQL = f"""{DOCS},
raw AS (SELECT doc_id, lang, regexp_extract_all(t, '[^。！？]*[。！？]+|[^。！？]+$') AS parts FROM docs),
cut AS (SELECT doc_id, lang, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM raw),
placed AS (SELECT *, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) - length(s) + length(s) - length(regexp_replace(s, '^\\s+', '')) AS a FROM cut),
sentences AS (SELECT doc_id, lang, CAST(a AS INTEGER) AS "start", CAST(a + length({TRIM.format("s")}) AS INTEGER) AS "end", {TRIM.format("s")} AS s FROM placed WHERE {TRIM.format("s")} <> '')"""
PARAGRAPHS_SQL = f"""{DOCS},
raw AS (SELECT doc_id, lang, string_split(replace(t, chr(10), chr(10) || chr(10)), chr(10)) AS parts FROM docs),
cut AS (SELECT doc_id, lang, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM raw),
placed AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(s) - 1 + length(s) - length(ltrim(s)) AS a FROM cut),
paragraphs AS (SELECT doc_id, lang, CAST(a AS INTEGER) AS "start", CAST(a + length(trim(s)) AS INTEGER) AS "end", trim(s) AS s,
  CAST(len([x for x in regexp_extract_all(trim(s), '[^。！？]*[。！？]+|[^。！？]+$') if trim(x) <> '']) AS INTEGER) AS n FROM placed WHERE trim(s) <> '')"""

OUT = ("doc_id", "rule_id", "start", "end", "severity", "message", "actual", "threshold")


def findings_of(docs: DataFrame, *rules: tuple[str, dict]) -> DataFrame:
    return analyze(docs, {"rules": {r: {"ruleId": r, **options} for r, options in rules}}).select(*OUT)


@query("sentences", f"""WITH {SENTENCES_SQL} SELECT doc_id, "start", "end", CAST(length(s) AS INTEGER) AS n_units FROM sentences""")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(structure(prose(spark, sf_dir).select("doc_id", "text"), fields=("sentences",)), "sentences", "doc_id").withColumnRenamed("sentences", "s")
    return rows.select("doc_id", "s.start", "s.end", (F.col("s.end") - F.col("s.start")).alias("n_units"))


@query("paragraphs", f"""WITH {PARAGRAPHS_SQL} SELECT doc_id, "start", "end", CAST(length(s) AS INTEGER) AS n_units, n AS n_sentences FROM paragraphs""")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(structure(prose(spark, sf_dir, apart=True).select("doc_id", "text"), fields=("paragraphs", "counts")), "paragraphs", "doc_id").withColumnRenamed("paragraphs", "p")
    return rows.select("doc_id", "p.start", "p.end", utf16.length(F.col("p.text")).alias("n_units"), F.col("p.sentences").alias("n_sentences"))


def _metric_sql(rule: str, source: str, metric: str, threshold: int, message: str) -> str:
    text = "'" + message.replace("{t}", str(threshold)).replace("{a}", f"' || CAST({metric} AS VARCHAR) || '") + "'"
    return f"""SELECT doc_id, '{rule}' AS rule_id, "start", "end", 'warning' AS severity, {text} AS message, CAST({metric} AS INTEGER) AS actual, {threshold} AS threshold FROM {source} WHERE {metric} > {threshold}"""


def _literal_sql(rule: str, words: list[str], severity: str, message: str, values: dict[str, str] | None = None) -> str:
    either = "|".join(sorted(words, key=lambda w: -len(w)))
    said = "'" + message.replace("{t}", "' || m || '") + "'"
    if values:
        said = said.replace("{x}", "' || CASE m " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END || '")
    return f"""SELECT doc_id, '{rule}' AS rule_id, CAST(b - length(m) AS INTEGER) AS "start", CAST(b AS INTEGER) AS "end", '{severity}' AS severity, {said} AS message, CAST(NULL AS INTEGER) AS actual, CAST(NULL AS INTEGER) AS threshold
FROM (SELECT doc_id, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM (
  SELECT doc_id, unnest(regexp_extract_all(t, '{either}')) AS m, unnest(string_split_regex(t, '{either}')[:-2]) AS g, generate_subscripts(regexp_extract_all(t, '{either}'), 1) AS i FROM docs WHERE regexp_matches(t, '{either}')))"""


FORBIDDEN = ["ation", "tion", "the", "que"]
TERMS = {"ing": "ation", "sting": "st", "des": "der"}
NEGATIONS, LONGER = ["anan", "nano", "ouou"], {"thth": "th", "enen": "en", "enenen": "en"}
D004_SQL = _literal_sql("D004", FORBIDDEN, "error", TEXT["D004"])
D005_SQL = _literal_sql("D005", list(TERMS), "error", TEXT["D005"], TERMS)
D007_SQL = _literal_sql("D007", NEGATIONS, "warning", TEXT["D007"])
D008_SQL = _literal_sql("D008", list(LONGER), "warning", TEXT["D008"], LONGER)
H101_SQL = _metric_sql("H101", "sentences", "length(s)", 100, TEXT["H101"])
H103_SQL = _metric_sql("H103", "sentences", "(length(s) - length(replace(s, '、', '')))", 4, TEXT["H103"])
H112_SQL = _metric_sql("H112", "paragraphs", "length(s)", 500, TEXT["H112"])
H113_SQL = _metric_sql("H113", "paragraphs", "n", 8, TEXT["H113"])

LITERAL = {"D004": ({"forbiddenTerms": FORBIDDEN}, D004_SQL), "D005": ({"terminology": TERMS}, D005_SQL), "D007": ({"patterns": NEGATIONS}, D007_SQL), "D008": ({"replacements": LONGER}, D008_SQL)}


def _plain(rule: str, options: dict, apart: bool = False) -> Query:
    return lambda spark, sf_dir: findings_of(prose(spark, sf_dir, apart), (rule, options))


for _rule, (_options, _sql) in LITERAL.items():
    query(f"{_rule.lower()}_prose", f"WITH {DOCS} {_sql}")(_plain(_rule, _options))
for _rule, _sql in {"H101": H101_SQL, "H103": H103_SQL}.items():
    query(f"{_rule.lower()}_prose", f"WITH {SENTENCES_SQL} {_sql}")(_plain(_rule, {}))
for _rule, _sql in {"H112": H112_SQL, "H113": H113_SQL}.items():
    query(f"{_rule.lower()}_prose", f"WITH {PARAGRAPHS_SQL} {_sql}")(_plain(_rule, {}, apart=True))

ALL = [(r, o) for r, (o, _) in LITERAL.items()] + [("H101", {}), ("H103", {})]
ALL_SQL = f"WITH {SENTENCES_SQL}, findings AS (" + "\nUNION ALL ".join([*(s for _, s in LITERAL.values()), H101_SQL, H103_SQL]) + ")"
CONFIG = {"rules": {r: {"ruleId": r, **o} for r, o in ALL}}


@query("lint_findings", f"{ALL_SQL} SELECT * FROM findings")
def lint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of these rules at once: one pass over the documents, no shuffle."""
    return findings_of(prose(spark, sf_dir), *ALL)


@query(
    "report",
    f"""{ALL_SQL}, per AS (SELECT doc_id, count(*) AS n, count(*) FILTER (severity = 'error') AS e, min("start") AS s FROM findings GROUP BY doc_id)
SELECT d.doc_id, '1.0.0' AS schema_version, CAST(CASE WHEN coalesce(e, 0) > 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_code, CAST(coalesce(n, 0) AS INTEGER) AS n_lint, CAST(coalesce(e, 0) AS INTEGER) AS n_errors, s AS first_start FROM docs d LEFT JOIN per USING (doc_id)""",
)
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.report(prose(spark, sf_dir), CONFIG)
    m = F.col("lintMessages")
    return rows.select("doc_id", F.col("schemaVersion").alias("schema_version"), F.col("exitCode").alias("exit_code"), F.size(m).alias("n_lint"), F.size(F.filter(m, lambda x: x["level"] == "error")).alias("n_errors"), F.get(m, F.lit(0))["range"]["start"].alias("first_start"))


@query(
    "exit_code",
    f"""{ALL_SQL}, per AS (SELECT doc_id, max(CASE WHEN severity = 'error' THEN 1 ELSE 0 END) AS e FROM findings GROUP BY doc_id)
SELECT CAST(coalesce(e, 0) AS INTEGER) AS exit_code, count(*) AS n FROM docs LEFT JOIN per USING (doc_id) GROUP BY 1""",
)
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report(prose(spark, sf_dir), CONFIG).groupBy(F.col("exitCode").alias("exit_code")).agg(F.count("*").alias("n"))


@query("rule_counts", f"{ALL_SQL} SELECT lang, rule_id, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM findings JOIN docs USING (doc_id) GROUP BY ALL")
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language and rule: the rows stay with their documents, so only the counts shuffle."""
    from ..operators.lint import with_findings

    rows = with_findings(prose(spark, sf_dir), CONFIG).select("doc_id", "lang", F.explode_outer("findings.rule_id").alias("rule_id")).where("rule_id is not null")
    per = rows.groupBy("doc_id", "lang", "rule_id").agg(F.count("*").alias("k"))
    return per.groupBy("lang", "rule_id").agg(F.sum("k").alias("n"), F.count("*").alias("n_docs"))


@query("stream_findings", f"WITH {DOCS} {D004_SQL}")
def stream_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rule over a stream of the documents' files, written exactly once and read back."""
    from ..sources.files import temporary
    from ..streaming import lint as streaming

    docs = table(spark, sf_dir, "documents")
    stream = streaming.documents(spark, f"{sf_dir}/documents.parquet*", docs.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    rows = streaming.findings(stream.select("doc_id", lifted().alias("text")), {"rules": {"D004": {"ruleId": "D004", "forbiddenTerms": FORBIDDEN}}}).select(*OUT)
    where = temporary(spark, "stream")
    streaming.write(rows, f"{where}/out", f"{where}/state").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{where}/out")


# --- whole texts ----------------------------------------------------------------------------------


def _whole(rule: str, options: dict) -> Query:
    return lambda spark, sf_dir: findings_of(table(spark, sf_dir, "documents").select("doc_id", "text"), (rule, options))


#: Rules without another query over whole texts; no SQL follows them, tests hold brute force where there is one.
for _rule, _options in {"D001": {"style": "consistent"}, "D002": {"normalization": "NFC"}, "D003": {}, "D006": {"maxConsecutive": 1}, "H102": {}, "H104": {}, "H106": {}, "H107": {}, "H108": {}}.items():
    query(f"{_rule.lower()}_text")(_whole(_rule, _options))


# --- dictionaries ---------------------------------------------------------------------------------


def _quoted(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, int):
        return str(x)
    return " || ".join(f"chr({ord(p)})" if p == "\n" else "'" + p.replace("'", "''") + "'" for p in _pieces(x)) or "''"


def _pieces(text: str) -> list[str]:
    out, held = [], ""
    for c in text:
        if c == "\n":
            out += [held, c] if held else [c]
            held = ""
        else:
            held += c
    return [*out, held] if held else out


def tiled(spark: SparkSession, sf_dir: str, texts: list[str]) -> DataFrame:
    """(doc_id, text): the documents' ids with the texts in turn."""
    pick = F.element_at(F.array(*map(F.lit, texts)), (F.pmod(F.col("doc_id"), F.lit(len(texts))) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", pick.alias("text"))


#: Sentences' ends and beginnings with what the analyser finds in them, set behind or before a document's words.
ENDINGS = [(f"{stem}{m}", f"verb:{lemma}:{form}") for stem, lemma in ja.POLITE_STEMS.items() for m, form in ja.MASU_FORMS.items()]
ENDINGS += [(c, f"copula:{lemma}:{form}") for c, (lemma, form) in ja.COPULAS.items()] + [(a, f"adjective:{lemma}:{form}") for a, (lemma, form) in ja.ADJECTIVES.items()]
ENDINGS += [(v, f"verb:{lemma}:{form}") for v, (lemma, form) in ja.PLAIN_VERBS.items()] + [("例ですか", "copula:です:polite-nonpast|particle:か"), ("読みますね", "verb:読む:polite-nonpast|particle:ね"), ("", None)]
#: Clauses and the surface of the predicate that ends each.
CLAUSES = [(f"資料を確認{e}", f"確認{e}") for e in ja.SURU_ENDINGS] + [(c, c) for c in ("読みます", "書きません", "比べました", "である", *ja.COPULAS, *ja.ADJECTIVES, *ja.CONJUNCTIVE)] + [(f"本{v}", f"本{v}") for v in ja.CLAUSE_VERBS] + [("名詞", "")]
POINTERS = [(f"{p}は", p) for p in ja.PRONOUNS] + [(f"{d}例", d) for d in ja.DETERMINERS] + [(f"{a}し", a) for a in ja.ADVERBS] + [("それぞれ", ""), ("このは", "この")]


def _dictionary(name: str, rows: list[tuple[str, str | None]], build: str, of: Callable[[Column], Column]) -> None:
    """Every entry in turn, with the words of a document around it; {} in ``build`` stands for the entry, # for the words."""

    def text() -> Column:
        words = F.regexp_replace(built.line(), "[。！？、 ]+", "")
        entry = F.element_at(F.array(*(F.lit(a) for a, _ in rows)), (F.pmod(F.col("doc_id"), F.lit(len(rows))) + 1).cast("int"))
        return F.concat(*(words if p == "#" else entry if p == "{}" else F.lit(p) for p in re.split(r"(#|\{\})", build) if p))

    values = ", ".join(f"({k}, {_quoted(v)})" for k, (_, v) in enumerate(rows))
    sql = f"SELECT doc_id, CAST(v AS VARCHAR) AS {name} FROM documents JOIN (VALUES {values}) AS x(k, v) ON doc_id % {len(rows)} = k"
    query(name, sql)(lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", of(text()).alias(name)))


_dictionary("terminal_label", ENDINGS, "#は{}。", ja.terminal)
_dictionary("leading_label", [(w, w) for w in ja.LEADERS] + [("", None)], "{}、#。", ja.leading)
_dictionary("predicates", CLAUSES, "#、{}。", lambda t: F.array_join(F.transform(ja.predicates(t), lambda p: p["surface"]), ","))
_dictionary("demonstratives", POINTERS, "# {} #", lambda t: F.array_join(ja.demonstratives(t), ","))

QUERIES |= built.QUERIES | relations.QUERIES | judgements.QUERIES
ORACLES |= built.ORACLES | relations.ORACLES | judgements.ORACLES


@query(
    "utf16_ranges",
    """SELECT doc_id, CAST(p + least(p, w) AS INTEGER) AS "start", CAST(p + 2 + least(p + 2, w) AS INTEGER) AS "end"
FROM (SELECT doc_id, doc_id % 7 AS p, doc_id % 4 AS w, length(text) AS n FROM documents) WHERE p + 2 <= n + w""",
)
def utf16_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two code points of every text, behind up to three characters that take two units."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.repeat(F.lit("😀"), F.pmod("doc_id", F.lit(4)).cast("int")), "text").alias("t"), F.pmod("doc_id", F.lit(7)).cast("int").alias("p"))
    return docs.select("doc_id", utf16.to_range(F.col("t"), F.col("p"), F.col("p") + 2).alias("r")).where("r is not null").select("doc_id", "r.start", "r.end")


# --- saved judgements -----------------------------------------------------------------------------

_JUDGED = {"ruleId": "S203", "status": "violation", "range": {"start": 0, "end": 3}, "evidence": ["あい"], "reason": "r", "confidence": 0.9}
_ERROR = {"ruleId": "D004", "category": "deterministic", "range": {"start": 0, "end": 2}, "severity": "error", "message": "m"}
_WARNED = {"ruleId": "H101", "category": "heuristic", "range": {"start": 0, "end": 4}, "severity": "warning", "message": "m", "actual": 101, "threshold": 100}


def _envelope(findings: list, judged: list, **more) -> str:
    return json.dumps({"input": "あいうえ", "findings": findings, "semanticFindings": judged, **more}, ensure_ascii=False)


#: (envelope, exit code, lint messages, notices); the last ones break the contract.
ENVELOPES = [
    (_envelope([], []), 0, 0, 0),
    (_envelope([_WARNED], [_JUDGED, _JUDGED]), 0, 1, 2),
    (_envelope([_WARNED, _ERROR], [_JUDGED]), 1, 2, 1),
    (_envelope([_ERROR | {"severity": "warning"}], [_JUDGED | {"status": "uncertain", "evidence": ["x"], "confidence": 0}]), 0, 1, 1),
    (_envelope([], [_JUDGED | {"severity": "error"}]), 2, None, None),
    (_envelope([], [_JUDGED | {"evidence": ["えお"]}]), 2, None, None),
    (_envelope([], [_JUDGED | {"evidence": []}]), 2, None, None),
    (_envelope([], [_JUDGED | {"confidence": 1.5}]), 2, None, None),
    (_envelope([_WARNED | {"actual": -1}], []), 2, None, None),
    (_envelope([_ERROR | {"range": {"start": 2, "end": 2}}], []), 2, None, None),
    (_envelope([_ERROR | {"range": {"start": 0, "end": 5}}], []), 2, None, None),
    (_envelope([], [], extra=1), 2, None, None),
    ("not json", 2, None, None),
]


@query(
    "semantic_validate",
    f"""SELECT doc_id, CAST(c AS INTEGER) AS exit_code, CAST(l AS INTEGER) AS n_lint, CAST(s AS INTEGER) AS n_notices FROM documents
JOIN (VALUES {", ".join(f"({k}, {c}, {_quoted(n)}, {_quoted(s)})" for k, (_, c, n, s) in enumerate(ENVELOPES))}) AS x(k, c, l, s) ON doc_id % {len(ENVELOPES)} = k""",
)
def semantic_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved envelopes, checked and turned into reports."""
    rows = envelopes.reports_of(tiled(spark, sf_dir, [e for e, *_ in ENVELOPES]), "text")
    size = lambda name: F.json_array_length(F.get_json_object("report", f"$.{name}"))
    return rows.select("doc_id", "exit_code", size("lintMessages").alias("n_lint"), size("semanticNotices").alias("n_notices"))


_SAVED = "concat('S20', CAST(1 + doc_id % 8 AS VARCHAR))"


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judgement per document, by its id."""
    k = F.pmod("doc_id", F.lit(4))
    status = F.when(k == 0, "violation").when(k == 2, "uncertain").otherwise("no_violation")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("S20"), F.pmod("doc_id", F.lit(8)) + 1).alias("ruleId"), status.alias("status"), (F.pmod("doc_id", F.lit(11)) / 10).alias("confidence"))


_STATUS_SQL = "CASE doc_id % 4 WHEN 0 THEN 'violation' WHEN 2 THEN 'uncertain' ELSE 'no_violation' END"


@query("semantic_counts", f"""SELECT {_SAVED} AS "ruleId", CAST(sum(CASE WHEN s = 'violation' THEN 1 ELSE 0 END) AS BIGINT) AS violation, CAST(sum(CASE WHEN s = 'no_violation' THEN 1 ELSE 0 END) AS BIGINT) AS no_violation, CAST(sum(CASE WHEN s = 'uncertain' THEN 1 ELSE 0 END) AS BIGINT) AS uncertain FROM (SELECT doc_id, {_STATUS_SQL} AS s FROM documents) GROUP BY 1""")
def semantic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.status_counts(_saved(spark, sf_dir))


@query("semantic_shown", f"SELECT doc_id, {_SAVED} AS \"ruleId\" FROM documents WHERE doc_id % 4 = 0 AND doc_id % 11 >= 7")
def semantic_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.shown(_saved(spark, sf_dir)).select("doc_id", "ruleId")


@query("semantic_eval", f"""SELECT {_SAVED} AS "ruleId", count(*) AS n, CAST(sum(CASE WHEN doc_id % 24 <> 5 THEN 1 ELSE 0 END) AS BIGINT) AS agree, bool_and(doc_id % 24 <> 5) AS passed FROM documents GROUP BY 1""")
def semantic_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures joined to what was observed for them; one in 24 of one rule disagrees."""
    rows = _saved(spark, sf_dir)
    fixtures = rows.select(F.col("doc_id").alias("fixtureId"), "ruleId", F.col("status").alias("expectedStatus"))
    wrong = F.pmod("doc_id", F.lit(24)) == 5
    return semantic.evaluate(fixtures, rows.select(F.col("doc_id").alias("fixtureId"), F.when(wrong, F.lit("none")).otherwise(F.col("status")).alias("observedStatus")))


@query("analyzer_gates", "SELECT doc_id, doc_id % 3 = 0 AS accepted FROM documents")
def analyzer_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate analyser is accepted if every gate passed."""
    last = F.when(F.pmod("doc_id", F.lit(3)) == 0, "PASS").when(F.pmod("doc_id", F.lit(3)) == 1, "FAIL").otherwise("UNKNOWN")
    gates = F.create_map(*(x for g in semantic.GATES[:-1] for x in (F.lit(g), F.lit("PASS"))), F.lit(semantic.GATES[-1]), last)
    return table(spark, sf_dir, "documents").select("doc_id", semantic.accepted(gates).alias("accepted"))


