"""Queries over tables that are joined: terms, code and ranges beside the texts, with their SQL.

Texts are built as in ``built``: a document's whole prose in three parts, the middle one as a code span; some Latin letters become kana,
so that terms meet the guards of their scripts at the places where the prose has those letters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import messages as said
from ..config import PAIRS
from ..functions import japanese as ja
from ..operators import dictionary, intervals, nesting, runs
from ..operators.structure import rows_of, structure
from ..sources.files import table
from ..sources.written import Written
from . import built
from .built import A, B, C, LINE_SQL, THIRDS_SQL, line

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, sql: str, query: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name], ORACLES[name] = query, sql


# --- terms from a table ---------------------------------------------------------------------------

LETTERS, KANA = "aeon", "あいアン"
#: What separates the words of a built text.
APART = " 。！？、`"


def _kana(text: Column) -> Column:
    return F.translate(text, LETTERS, KANA)


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _kana(built._text(A, " `", B, "` ", C)).alias("text"))


def term_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginnings and ends of all words, and the shorter words themselves."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(_kana(line()), F.lit(f"[^{APART}]+"), F.lit(0)))).alias("w")).distinct()
    parts = F.array(F.substring("w", 1, 3), F.expr("right(w, 4)"), F.expr("substring(w, 2, 5)"), F.when(F.length("w") <= 12, F.col("w")))
    return words.select(F.explode(parts).alias("term")).where("length(term) > 1").distinct()


_GUARD = "regexp_matches({}, '^(\\p{{Hiragana}}{{2}}|\\p{{Katakana}}{{2}})$')"
DICTIONARY_SQL = f"""WITH RECURSIVE {THIRDS_SQL},
every AS (SELECT DISTINCT unnest(regexp_extract_all(translate({LINE_SQL}, '{LETTERS}', '{KANA}'), '[^{APART}]+')) AS w FROM documents),
terms AS (SELECT DISTINCT term FROM (SELECT unnest([substr(w, 1, 3), right(w, 4), substr(w, 2, 5), CASE WHEN length(w) <= 12 THEN w END]) AS term FROM every) WHERE length(term) > 1),
parts AS (SELECT doc_id, 0 AS base, translate(a, '{LETTERS}', '{KANA}') AS t FROM thirds UNION ALL SELECT doc_id, length(a) + length(b) + 4, translate(c, '{LETTERS}', '{KANA}') FROM thirds),
cut AS (SELECT doc_id, base, unnest(regexp_extract_all(t, '[^{APART}]+|[{APART}]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^{APART}]+|[{APART}]+'), 1) AS i FROM parts),
placed AS (SELECT doc_id, w, base + sum(length(w)) OVER (PARTITION BY doc_id, base ORDER BY i) - length(w) AS place FROM cut),
words AS (SELECT DISTINCT w FROM placed WHERE NOT contains('{APART}', left(w, 1))),
starts AS (SELECT w, unnest(range(1, length(w))) AS s FROM words),
subs AS (SELECT w, s, unnest(range(2, least(13, length(w) - s + 2))) AS l FROM starts),
hits AS (SELECT w, s, max(l) AS l FROM subs JOIN terms ON term = substr(w, s, l) WHERE NOT {_GUARD.format("substr(w, s - 1, CASE WHEN s > 1 THEN 2 ELSE 0 END)")} AND NOT {_GUARD.format("substr(w, s + l - 1, 2)")} GROUP BY w, s),
walk AS (SELECT w, 0 AS s, 1 AS e FROM words UNION ALL SELECT w, s, e FROM (SELECT h.w, h.s, h.s + h.l AS e, row_number() OVER (PARTITION BY h.w ORDER BY h.s) AS turn FROM walk k JOIN hits h ON h.w = k.w AND h.s >= k.e) WHERE turn = 1)
SELECT doc_id, substr(w, s, e - s) AS term, CAST(place + s - 1 AS INTEGER) AS "start", CAST(place + e - 1 AS INTEGER) AS "end" FROM placed JOIN walk USING (w) WHERE s > 0"""


def dictionary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms of a table in all texts, outside code and by the kana guards."""
    return dictionary.matches(coded(spark, sf_dir), term_table(spark, sf_dir), bounded=True)


def dictionary_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows where no table of terms may be broadcast."""
    return dictionary.matches(coded(spark, sf_dir), term_table(spark, sf_dir), bounded=True, broadcast_bytes=0)


_add("dictionary_terms", DICTIONARY_SQL, dictionary_terms)
_add("dictionary_joined", DICTIONARY_SQL, dictionary_joined)

# --- deterministic rules beside code --------------------------------------------------------------


def _beside_code(name: str, rule: str, options: dict, pairs: dict[str, str], sql: Callable[[str], str]) -> None:
    """A rule over the prose with its middle part in code and the pairs replaced in all parts: the findings of the outer parts, each by itself."""

    def swapped(part: str) -> str:
        for a, b in pairs.items():
            part = f"replace({part}, '{a}', '{b}')"
        return part

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = built._text(A, " `", B, "` ", C)
        for a, b in pairs.items():
            text = F.replace(text, F.lit(a), F.lit(b))
        return built._findings(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), rule, options)

    a, b, c = (swapped(x) for x in "abc")
    parts = f"SELECT 2 * doc_id AS doc_id, lang, 0 AS base, {a} AS t FROM thirds UNION ALL SELECT 2 * doc_id + 1, lang, 0, {c} FROM thirds"
    _add(name, f"""WITH {THIRDS_SQL}, sizes AS (SELECT doc_id, length({a}) + length({b}) + 4 AS behind FROM thirds), found AS ({sql(parts)})
SELECT f.doc_id // 2 AS doc_id, rule_id, CAST("start" + behind * (f.doc_id % 2) AS INTEGER) AS "start", CAST("end" + behind * (f.doc_id % 2) AS INTEGER) AS "end", severity, message, actual, threshold FROM found f JOIN sizes s ON s.doc_id = f.doc_id // 2""", query)


def _literal(rule: str, pattern: str, message: str) -> Callable[[str], str]:
    return lambda t: f"""WITH docs AS ({t}), {built._places(pattern)}, spans AS (SELECT doc_id, m, CAST(b - length(m) AS INTEGER) AS "start", CAST(b AS INTEGER) AS "end" FROM marks) {built._rows(rule, "spans", message)}"""


_beside_code("d002_code", "D002", {"normalization": "NFC"}, {"ta": "t" + built.MARKED}, lambda t: f"""WITH docs AS ({t}), {built._places(built.MARKED)}, spans AS (SELECT doc_id, CAST(b - 2 AS INTEGER) AS "start", CAST(b AS INTEGER) AS "end" FROM marks) {built._rows("D002", "spans", said.TEXT["D002"])}""")
_beside_code("d003_code", "D003", {}, built.BRACKETS, built.stack_sql)
_beside_code("d005_code", "D005", {"terminology": {"ing": "ation", "sting": "st"}}, {}, _literal("D005", "sting|ing", said.TEXT["D005"].format(t="{m}", x="{CASE m WHEN ''ing'' THEN ''ation'' ELSE ''st'' END}").replace("''", "'")))
_beside_code("d007_code", "D007", {"patterns": ["anan", "ouou", "enen"]}, {}, _literal("D007", "anan|ouou|enen", said.TEXT["D007"].format(t="{m}")))
_beside_code("d008_code", "D008", {"replacements": {"thth": "th", "erer": "er"}}, {}, _literal("D008", "thth|erer", said.TEXT["D008"].format(t="{m}", x="{CASE m WHEN ''thth'' THEN ''th'' ELSE ''er'' END}").replace("''", "'")))

#: A term of each kind of edge: kana of either script at one end or both, and none.
EDGED = ["あh", "hい", "いr", "rい", "アu", "アン", "い", "th"]


def _script(c: str) -> str:
    """The kana script of a character of these texts, null for all others."""
    return f"CASE WHEN {c} IN ('あ', 'い') THEN 1 WHEN {c} IN ('ア', 'ン') THEN 2 END"


def _guards_sql() -> str:
    """Of the terms at each place the longest that its guards let pass; a term may follow another at once."""
    either = lambda size: ", ".join(f"'{t}'" for t in EDGED if len(t) == size)
    apart = lambda a, b: f"coalesce({_script(a)} <> {_script(b)}, true)"
    return f"""WITH {THIRDS_SQL},
parts AS (SELECT doc_id, 0 AS base, translate(a, '{LETTERS}', '{KANA}') AS t FROM thirds UNION ALL SELECT doc_id, length(a) + length(b) + 4, translate(c, '{LETTERS}', '{KANA}') FROM thirds),
firsts AS (SELECT doc_id, base, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS s FROM parts),
near AS (SELECT *, lag(c) OVER w AS p, lead(c) OVER w AS n, lead(c, 2) OVER w AS nn FROM firsts WINDOW w AS (PARTITION BY doc_id, base ORDER BY s)),
hits AS (SELECT doc_id, base, s, CASE WHEN c || n IN ({either(2)}) AND {apart("n", "nn")} THEN c || n WHEN c IN ({either(1)}) AND {apart("c", "n")} THEN c END AS term FROM near WHERE {apart("p", "c")} AND term IS NOT NULL),
-- two hits overlap only if the second starts at the last character of the first; a chain of such hits keeps every other one
chained AS (SELECT *, CASE WHEN lag(s + length(term)) OVER w > s THEN 0 ELSE 1 END AS head FROM hits WINDOW w AS (PARTITION BY doc_id, base ORDER BY s)),
chains AS (SELECT *, sum(head) OVER (PARTITION BY doc_id, base ORDER BY s) AS chain FROM chained),
turns AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base, chain ORDER BY s) AS turn FROM chains),
spans AS (SELECT doc_id, term, CAST(base + s - 1 AS INTEGER) AS "start", CAST(base + s - 1 + length(term) AS INTEGER) AS "end" FROM turns WHERE turn % 2 = 1)
{built._rows("D004", "spans", said.TEXT["D004"].format(t="{term}"))}"""


_add("d004_code_kana", _guards_sql(), lambda spark, sf_dir: built._findings(coded(spark, sf_dir), "D004", {"forbiddenTerms": EDGED}))


# --- ranges in separate tables --------------------------------------------------------------------


def _apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prose with every line a paragraph."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(built.lifted(), "\n", "\n\n").alias("text"))


def sentence_homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence with the first paragraph that contains it, from two written tables; sentences across paragraphs have none."""
    docs = _apart(spark, sf_dir)
    sentences = Written(rows_of(structure(docs, fields=("sentences",)), "sentences", "doc_id").select("doc_id", "sentences.start", "sentences.end"), "sentences")
    paragraphs = Written(rows_of(structure(docs, fields=("paragraphs",)), "paragraphs", "doc_id", place="pos").select("doc_id", "pos", "paragraphs.start", "paragraphs.end"), "paragraphs")
    found = intervals.first_containing(sentences.df, paragraphs.df, "pos")
    return found.select("doc_id", "start", "end", F.col("range.pos").alias("paragraph"), F.col("range.start").alias("home"))


_add(
    "sentence_homes",
    f"""WITH {built.sentences_sql(f"SELECT doc_id, lang, 0 AS base, replace({built.LIFTED_SQL}, chr(10), chr(10) || chr(10)) AS t FROM documents")},
lines AS (SELECT doc_id, string_split(t, chr(10)) AS parts FROM docs), pieces AS (SELECT doc_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS k FROM lines),
spread AS (SELECT *, sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1 - length(ltrim(p)) AS a FROM pieces),
paragraphs AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS pos, CAST(a AS INTEGER) AS a, CAST(a + length(trim(p)) AS INTEGER) AS b FROM spread WHERE trim(p) <> '')
SELECT s.doc_id, s."start", s."end", p.pos AS paragraph, p.a AS home FROM sentences s LEFT JOIN paragraphs p ON p.doc_id = s.doc_id AND p.a <= s."start" AND s."end" <= p.b""",
    sentence_homes,
)


def sentences_outside_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences that no code range overlaps, and those that none contains, from tables of sentences and of code."""
    docs = table(spark, sf_dir, "documents").select("doc_id", built._text(A, " `", B, "` ", C).alias("text"))
    sentences = Written(rows_of(structure(docs, fields=("sentences",)), "sentences", "doc_id").select("doc_id", "sentences.start", "sentences.end"), "sentences").df
    code = Written(rows_of(structure(docs, fields=("code",)), "code", "doc_id").select("doc_id", "code.*"), "code").df
    kept = [intervals.outside(sentences, code, how).withColumn("free_of", F.lit(how)) for how in (intervals.OVERLAPPING, intervals.CONTAINED)]
    return kept[0].unionByName(kept[1])


_add(
    "sentences_outside_code",
    f"""WITH {THIRDS_SQL}, {built.sentences_sql("SELECT doc_id, lang, 0 AS base, a || ' `' || b || '` ' || c AS t FROM thirds")}, code AS (SELECT doc_id, length(a) + 1 AS c, length(a) + length(b) + 3 AS d FROM thirds)
SELECT x.doc_id, "start", "end", 'overlapping' AS free_of FROM sentences x JOIN code USING (doc_id) WHERE NOT ("start" < d AND "end" > c)
UNION ALL SELECT x.doc_id, "start", "end", 'contained' FROM sentences x JOIN code USING (doc_id) WHERE NOT (c <= "start" AND "end" <= d)""",
    sentences_outside_code,
)

# --- runs over rows of sentences ------------------------------------------------------------------


def _row_runs(name: str, of: str, label: Callable[[Column], Column]) -> None:
    """The runs of the query ``of``, from a table with a row for each sentence instead of arrays in documents."""
    rule, pairs = built.RUNS[of]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = built._built(spark, sf_dir, built._swapped(pairs))
        rows = rows_of(structure(docs, fields=("sentences", "texts", "homes")), "sentences", "doc_id", place="n").withColumnRenamed("sentences", "s")
        keyed = rows.select("doc_id", "n", "s.start", "s.end", F.concat(F.col("s.paragraph").cast("string"), F.lit(":"), label(F.col("s.text"))).alias("label"))
        found = runs.runs(keyed).where(F.col("length") > 2)
        message = F.format_string(said.TEXT[rule].replace("{t}", "2").replace("{a}", "%d"), F.col("length"))
        return found.select("doc_id", F.lit(rule).alias("rule_id"), "start", "end", F.lit("warning").alias("severity"), message.alias("message"), F.col("length").cast("int").alias("actual"), F.lit(2).alias("threshold"))

    _add(name, built.ORACLES[of], query)


_row_runs("h107_rows", "h107_runs", ja.leading)
_row_runs("h108_rows", "h108_runs", ja.terminal)

# --- texts in pieces ------------------------------------------------------------------------------

PIECE = 97


def d003_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marks without a partner of texts that lie in many rows each."""
    docs = built._built(spark, sf_dir, built._swapped(built.BRACKETS))
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))  # one pass; a substring's cost grows with its distance from the start
    pieces = docs.select("doc_id", F.posexplode(F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(parts)).alias("n", "text")).select("doc_id", "n", (F.col("n") * PIECE).alias("offset"), "text")
    found, _ = nesting.nested(pieces, pairs=PAIRS)
    return found.select("doc_id", F.col("start").cast("int").alias("start"), F.format_string(said.TEXT["D003"].replace("{t}", "%s"), "mark").alias("message"))


_add("d003_pieces", f"""SELECT doc_id, "start", message FROM ({built.stack_sql(f"SELECT doc_id, lang, 0 AS base, {built._swapped_sql(built.BRACKETS)} AS t FROM documents")})""", d003_pieces)
