"""Queries over saved judgements and envelopes that are made from the tables' own texts, with their SQL.

A judgement is made for each place where a document's prose has one of two letter pairs: which rule, status and confidence it
has follows from the place, what it quotes is the text there. Some documents' envelopes break the contract in one way or
another, by their language and length, so that SQL can tell which ones must be refused and why.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import messages as said
from ..functions import utf16
from ..operators import envelopes, intervals, semantic
from ..operators import report as reports
from ..operators.lint import analyze, with_findings
from ..sources.files import stored, table, temporary
from ..sources.written import Written
from ..streaming import reports as run_reports
from .built import LINE_SQL, _places, line

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: What the prose has everywhere: reported by a rule, and judged.
PAIRS = ("ti", "an")
CONFIG = {"rules": {"D007": {"ruleId": "D007", "patterns": ["ti"]}, "D004": {"ruleId": "D004", "forbiddenTerms": ["ouou", "enen"]}}}


def _add(name: str, sql: str, query: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def _docs(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return (docs if parts is None else docs.select("doc_id", "lang", "text").repartition(parts, "doc_id")).select("doc_id", "lang", line().alias("text"))


#: Of a place: rule, status and confidence.
STATUS_SQL = "CASE s % 4 WHEN 0 THEN 'violation' WHEN 2 THEN 'uncertain' ELSE 'no_violation' END"


def _judged(s: Column) -> tuple[Column, Column, Column]:
    k = F.pmod(s, F.lit(4))
    status = F.when(k == 0, "violation").when(k == 2, "uncertain").otherwise("no_violation")
    return F.concat(F.lit("S20"), (F.pmod(s, F.lit(8)) + 1).cast("string")), status, F.pmod(s, F.lit(11)) / 10


HITS_SQL = f"docs AS (SELECT doc_id, lang, {LINE_SQL} AS t FROM documents), {_places('|'.join(PAIRS))}, hits AS (SELECT doc_id, m, CAST(b - 2 AS INTEGER) AS s, CAST(b AS INTEGER) AS e FROM marks)"


def hits(docs: DataFrame) -> DataFrame:
    """(doc_id, m, start, end) of the letter pairs."""
    found = analyze(docs, {"rules": {"D005": {"ruleId": "D005", "terminology": dict.fromkeys(PAIRS, "x")}}})
    return found.select("doc_id", "start", "end")


def saved(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """A judgement at each place (found, if the places are known): doc_id, start, end, ruleId, status, confidence."""
    rule, status, confidence = _judged(F.col("start"))
    return (hits(_docs(spark, sf_dir)) if found is None else found).select("doc_id", "start", "end", rule.alias("ruleId"), status.alias("status"), confidence.alias("confidence"))


_RULE_SQL = "'S20' || CAST(1 + s % 8 AS VARCHAR)"
_add("judged_counts", f"""WITH {HITS_SQL}, told AS (SELECT {_RULE_SQL} AS "ruleId", {STATUS_SQL} AS status FROM hits)
SELECT "ruleId", count(*) FILTER (status = 'violation') AS violation, count(*) FILTER (status = 'no_violation') AS no_violation, count(*) FILTER (status = 'uncertain') AS uncertain FROM told GROUP BY 1""", lambda spark, sf_dir: semantic.status_counts(saved(spark, sf_dir)))
_add("judged_shown", f"""WITH {HITS_SQL} SELECT doc_id, s AS "start", {_RULE_SQL} AS "ruleId" FROM hits WHERE s % 4 = 0 AND s % 11 >= 7""", lambda spark, sf_dir: semantic.shown(saved(spark, sf_dir)).select("doc_id", "start", "ruleId"))


def judged_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was expected of each place against what is observed there: a violation wherever the place begins one of two longer words; some places are not observed."""
    place = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("start").cast("string"))
    both = {"D005": {"ruleId": "D005", "terminology": dict.fromkeys(PAIRS, "x")}, "D007": {"ruleId": "D007", "patterns": ["tion", "and"]}}
    found = Written(analyze(_docs(spark, sf_dir), {"rules": both}).select("doc_id", "start", "end", "rule_id"), "places").df  # the texts are read once
    at, longer = (found.where(F.col("rule_id") == r).drop("rule_id") for r in both)
    fixtures = saved(spark, sf_dir, at).select(place.alias("fixtureId"), "ruleId", F.when(F.col("status") == "violation", "violation").otherwise("no_violation").alias("expectedStatus"))
    judged = intervals.first_containing(at.where(F.pmod("start", F.lit(13)) > 0), longer, "start")
    observed = judged.select(place.alias("fixtureId"), F.when(F.col("range").isNotNull(), "violation").otherwise("no_violation").alias("observedStatus"))
    return semantic.evaluate(fixtures, observed)


_add("judged_eval", f"""WITH {HITS_SQL}, wide AS (SELECT doc_id, regexp_extract_all(t, 'tion|and') AS m, string_split_regex(t, 'tion|and')[:-2] AS g FROM docs WHERE regexp_matches(t, 'tion|and')),
unrolled AS (SELECT doc_id, unnest(m) AS m, unnest(g) AS g, generate_subscripts(m, 1) AS i FROM wide),
longer AS (SELECT doc_id, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS a, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM unrolled),
told AS (SELECT {_RULE_SQL} AS "ruleId", CASE WHEN s % 4 = 0 THEN 'violation' ELSE 'no_violation' END AS expected,
  CASE WHEN s % 13 = 0 THEN NULL WHEN EXISTS (SELECT 1 FROM longer l WHERE l.doc_id = h.doc_id AND l.a <= h.s AND h.e <= l.b) THEN 'violation' ELSE 'no_violation' END AS observed FROM hits h)
SELECT "ruleId", count(*) AS n, count(*) FILTER (expected = observed) AS agree, bool_and(coalesce(expected = observed, false)) AS passed FROM told GROUP BY 1""", judged_eval)

# --- envelopes ------------------------------------------------------------------------------------

#: How an envelope may be broken, by the length of the text: what SQL expects as the reason.
BROKEN = {1: "invalid envelope", 2: "invalid evidence outside range", 3: "invalid confidence", 4: "invalid range", 5: "invalid JSON", 6: "invalid observation"}


def envelope_table(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, value): each document (docs, if they are dealt out) with its findings and judgements as JSON, broken by BROKEN where the text's length modulo 17 says so."""
    rows = with_findings(_docs(spark, sf_dir) if docs is None else docs, CONFIG).withColumn("kind", F.pmod(F.length("text"), F.lit(17))).withColumn("units", utf16.length(F.col("text")))
    kind, units = F.col("kind"), F.col("units")  # columns: inside a lambda an expression would be evaluated for each finding
    place = lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"))
    lint = F.transform("findings", lambda f: F.struct(f["rule_id"].alias("ruleId"), f["category"].alias("category"), place(f).alias("range"), f["severity"].alias("severity"), f["message"].alias("message")))
    measured = F.struct(F.lit("H101").alias("ruleId"), F.lit("heuristic").alias("category"), F.struct(F.lit(0).alias("start"), units.alias("end")).alias("range"), F.lit("warning").alias("severity"), F.lit("m").alias("message"), F.when(kind == 6, -1).otherwise(units).alias("actual"), F.lit(0).alias("threshold"))
    whole = F.to_json(F.array(measured))
    listed = F.when(F.size("findings") == 0, whole).otherwise(F.concat(utf16.let(F.to_json(lint), lambda x: F.substring(x, F.lit(1), F.length(x) - 1)), F.lit(","), F.substring(whole, F.lit(2), F.length(whole) - 1)))

    def judgement(f: Column) -> Column:
        rule, status, confidence = _judged(f["start"])
        evidence = F.when((kind == 2) & (status == "violation"), F.lit("＃")).otherwise(F.lit("ti"))
        end = F.when(kind == 4, f["start"]).otherwise(f["end"])
        return F.struct(rule.alias("ruleId"), status.alias("status"), F.struct(f["start"].alias("start"), end.alias("end")).alias("range"), F.array(evidence).alias("evidence"), F.lit("r").alias("reason"), F.when(kind == 3, confidence + 1.5).otherwise(confidence).alias("confidence"))

    judged = F.to_json(F.transform(F.filter("findings", lambda f: f["rule_id"] == "D007"), judgement))
    value = F.concat(F.lit('{"input":'), utf16.let(F.to_json(F.array("text")), lambda x: F.substring(x, F.lit(2), F.length(x) - 2)), F.lit(',"findings":'), listed, F.lit(',"semanticFindings":'), judged, F.when(kind == 1, ',"more":1').otherwise(""), F.when(kind == 5, "").otherwise("}"))
    return rows.select("doc_id", value.alias("value"))


def envelope_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of the documents, written, checked and turned into reports."""
    rows = envelopes.reports_of(Written(envelope_table(spark, sf_dir), "envelopes").df)
    size = lambda name: F.json_array_length(F.get_json_object("report", f"$.{name}"))
    return rows.select("doc_id", "exit_code", size("lintMessages").alias("n_lint"), size("semanticNotices").alias("n_notices"), "error")


_KIND_SQL = "CASE " + " ".join(f"WHEN k = {k} THEN '{e}'" if k in (1, 5, 6) else f"WHEN k = {k} AND {'v' if k == 2 else 'j'} > 0 THEN '{e}'" for k, e in BROKEN.items()) + " WHEN k = 0 AND t = '' THEN 'invalid input' END"
_add("envelope_reports", f"""WITH docs AS (SELECT doc_id, lang, {LINE_SQL} AS t FROM documents), {_places("ti")}, {_places("ouou|enen").replace("marks AS", "words AS", 1)},
per AS (SELECT doc_id, count(*) AS j, count(*) FILTER ((b - 2) % 4 = 0) AS v FROM marks GROUP BY doc_id), terms AS (SELECT doc_id, count(*) AS d FROM words GROUP BY doc_id),
sized AS (SELECT doc_id, t, length(t) % 17 AS k, coalesce(j, 0) AS j, coalesce(v, 0) AS v, coalesce(d, 0) AS d FROM docs LEFT JOIN per USING (doc_id) LEFT JOIN terms USING (doc_id)),
told AS (SELECT *, {_KIND_SQL} AS error FROM sized)
SELECT doc_id, CAST(CASE WHEN error IS NOT NULL THEN 2 WHEN d > 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_code, CAST(CASE WHEN error IS NULL THEN j + d + 1 END AS INTEGER) AS n_lint, CAST(CASE WHEN error IS NULL THEN j END AS INTEGER) AS n_notices, error FROM told""", envelope_reports)


def semantic_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each judgement's place in the report of its document, where reasons begin with a character beyond U+FFFF or one just below: UTF-16 units decide."""
    rule, status, confidence = _judged(F.col("start"))
    rows = hits(_docs(spark, sf_dir)).withColumn("at", F.col("start") - F.pmod("start", F.lit(50)))
    reason = F.concat(F.when(F.pmod("start", F.lit(3)) == 0, "\U0001f600").when(F.pmod("start", F.lit(3)) == 1, "￮").otherwise("r"), F.format_string("%08d", "start"))
    notes = rows.select("doc_id", rule.alias("ruleId"), status.alias("status"), F.struct(F.col("at").alias("start"), (F.col("at") + 50).alias("end")).alias("range"), F.when(F.pmod("start", F.lit(5)) == 0, F.array(F.lit("e"))).when(F.pmod("start", F.lit(5)) == 1, F.array(F.lit("e"), F.lit("f"))).otherwise(F.array(F.lit("\U0001f600"))).alias("evidence"), reason.alias("reason"), confidence.alias("confidence"), F.lit(None).cast("string").alias("suggestedAction"))
    joined = reports.join_semantic(_docs(spark, sf_dir).select("doc_id"), Written(notes, "notes").df)
    placed = joined.select("doc_id", F.posexplode(reports.semantic_notices(F.col("semantic"))))
    return placed.select("doc_id", "pos", F.col("col.ruleId").alias("rule_id"), F.col("col.reason").alias("reason"))


_add("semantic_order", f"""WITH {HITS_SQL}, notes AS (SELECT doc_id, s, s - s % 50 AS at_, {_RULE_SQL} AS rule_id, {STATUS_SQL} AS status, CASE s % 5 WHEN 0 THEN 'e' WHEN 1 THEN 'ef' ELSE 'g' END AS evidence,
  CASE s % 3 WHEN 0 THEN chr(128512) WHEN 1 THEN chr(65518) ELSE 'r' END || printf('%08d', s) AS reason, CASE s % 3 WHEN 2 THEN 'a' WHEN 0 THEN 'b' ELSE 'c' END || printf('%08d', s) AS units FROM hits)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY at_, rule_id, status, evidence, units) - 1 AS INTEGER) AS pos, rule_id, reason FROM notes""", semantic_order)


def gates_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates measured on each source's documents, and whether an analyser that passes them all would be taken."""
    docs = table(spark, sf_dir, "documents")
    passed = lambda ok: F.when(ok.isNull(), "UNKNOWN").when(ok, "PASS").otherwise("FAIL")
    n = F.count("*")
    of = [n >= 20, F.avg(F.length("text")) < 2600, F.max(F.length("text")) < 30_000, F.count_distinct("lang") >= 4, F.min("doc_id") < 60]
    found = docs.groupBy("source").agg(*(passed(ok).alias(g) for ok, g in zip(of, semantic.GATES, strict=True)))
    gates = F.create_map(*(x for g in semantic.GATES for x in (F.lit(g), F.col(g))))
    return found.select("source", semantic.accepted(gates).alias("accepted"), F.size(F.filter(F.map_values(gates), lambda g: g == "PASS")).alias("passed"))


_GATES_SQL = ("count(*) >= 20", "avg(length(text)) < 2600", "max(length(text)) < 30000", "count(DISTINCT lang) >= 4", "min(doc_id) < 60")
_add("gates_by_source", "SELECT source, " + " AND ".join(f"coalesce({g}, false)" for g in _GATES_SQL) + " AS accepted, CAST(" + " + ".join(f"CASE WHEN {g} THEN 1 ELSE 0 END" for g in _GATES_SQL) + " AS INTEGER) AS passed FROM documents GROUP BY source", gates_by_source)


def _told(spark: SparkSession, folder: str) -> DataFrame:
    """How many envelopes of a run have each exit code and error."""
    reported, refused = run_reports.results(spark, folder)
    each = reported.select(F.get_json_object("value", "$.exitCode").cast("int").alias("exit_code"), F.lit(None).cast("string").alias("error")).unionByName(refused.select(F.lit(2).alias("exit_code"), "error"))
    return each.groupBy("exit_code", "error").agg(F.count("*").alias("n"))


#: Files of envelopes are compressed, as JSON takes many times its texts; one task reads such a file, so their number grows with the documents' bytes.
LEAST_FILES, FILE_BYTES = 4, 8 << 20


def _envelope_files(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """The folder of the files and their number; the texts are dealt out to them before envelopes are made of them."""
    path, n = temporary(spark, "envelope-lines"), max(LEAST_FILES, -(-stored(spark, f"{sf_dir}/documents.parquet") // FILE_BYTES))
    envelope_table(spark, sf_dir, _docs(spark, sf_dir, n)).select("value").write.option("compression", "gzip").text(path)
    return path, n


def envelope_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over files of envelopes, one a line: reports and quarantine, counted."""
    folder = temporary(spark, "run")
    run_reports.run(spark, _envelope_files(spark, sf_dir)[0], folder)
    return _told(spark, folder)


def envelope_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream of four micro-batches, of one file each as long as there are four."""
    folder, state = temporary(spark, "run"), temporary(spark, "state")
    path, n = _envelope_files(spark, sf_dir)
    run_reports.stream(spark, path, folder, state, files=-(-n // LEAST_FILES)).awaitTermination()
    return _told(spark, folder)


_RUN_SQL = f"SELECT exit_code, error, count(*) AS n FROM ({ORACLES['envelope_reports']}) GROUP BY ALL"
_add("envelope_run", _RUN_SQL, envelope_run)
_add("envelope_stream", _RUN_SQL, envelope_stream)
