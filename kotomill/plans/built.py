"""Queries over texts built from the documents' own, with Markdown, brackets, code and Japanese at places that SQL can compute.

Each text is a document's lifted prose, whole, with its line breaks as spaces: Latin letters, digits, spaces and Japanese
punctuation. Replacing some letters or punctuation by marks gives every rule its own subject at the places where the prose
happens to have those letters; cutting the prose in three and setting the parts in Markdown gives offsets
that are sums of lengths.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import japanese as ja
from ..operators import report as reports
from ..operators.lint import analyze, with_findings
from ..operators.structure import rows_of, structure
from ..sources.files import table, temporary
from ..streaming import lint as streaming
from .. import messages as said

MARKS, JAPANESE, GONE = ",.!?", "、。！？", "()\"'`[]{}<>#*_|-+&\\~=$%@/:;^"
LIFTED_SQL = "ltrim(regexp_replace(regexp_replace(translate(text, '" + (MARKS + GONE).replace("'", "''") + f"', '{JAPANESE}'), ' +', ' ', 'g'), '\\n ', chr(10), 'g'))"
LINE_SQL = f"trim(regexp_replace(replace({LIFTED_SQL}, chr(10), ' '), ' +', ' ', 'g'))"
TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
PLAIN = "[^。！？]*[。！？]+|[^。！？]+$"
#: Sentences where pair marks protect what they hold.
PAIRED = "(?:「[^」]*」|[^。！？「])*[。！？]+|(?:「[^」]*」|[^。！？「])+$"


def lifted() -> Column:
    plain = F.translate(F.col("text"), MARKS + GONE, JAPANESE)
    return F.ltrim(F.regexp_replace(F.regexp_replace(plain, " +", " "), "\n ", "\n"))


def line() -> Column:
    return F.trim(F.regexp_replace(F.replace(lifted(), F.lit("\n"), F.lit(" ")), " +", " "))


def sentences_sql(docs: str, pattern: str = PLAIN) -> str:
    """CTEs up to sentences(doc_id, lang, start, end, s, i); docs has doc_id, lang, base and t."""
    return f"""docs AS ({docs}),
raw AS (SELECT doc_id, lang, base, regexp_extract_all(t, '{pattern}') AS parts FROM docs),
cut AS (SELECT doc_id, lang, base, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM raw),
placed AS (SELECT *, sum(length(s)) OVER (PARTITION BY doc_id, base ORDER BY i) - length(regexp_replace(s, '^\\s+', '')) + base AS a FROM cut),
sentences AS (SELECT doc_id, lang, CAST(a AS INTEGER) AS "start", CAST(a + length({TRIM.format("s")}) AS INTEGER) AS "end", {TRIM.format("s")} AS s,
  row_number() OVER (PARTITION BY doc_id ORDER BY base, i) AS i FROM placed WHERE {TRIM.format("s")} <> '')"""


def _insertions(pairs: dict[str, str]) -> dict[str, str] | None:
    """Patterns and what goes behind their matches, for pairs that only insert a text before their last character and cannot meet: then they may be replaced in any order, many by one pattern. None for others."""
    groups: dict[str, dict[str, str]] = {}
    for a, b in pairs.items():
        if len(a) < 2 or len(b) <= len(a) or not (b.startswith(a[:-1]) and b.endswith(a[-1])):
            return None
        held = groups.setdefault(b[len(a) - 1 : -1], {})
        held[a[:-1]] = held.get(a[:-1], "") + a[-1]
    # no key begins inside a key or an insertion, all keys are of one length, and no insertion makes a key of what it follows
    firsts, lasts = {a[0] for a in pairs}, {a[-1] for a in pairs}
    if len({len(a) for a in pairs}) > 1 or any(firsts & {*a[1:]} for a in pairs) or any(firsts & {*x} or x[0] in lasts for x in groups):
        return None
    return {f"(?=[{ja._class(''.join(sorted({p[0] for p in held})))}])(?:{'|'.join(f'{re.escape(p)}(?=[{ja._class(ends)}])' for p, ends in held.items())})": x for x, held in groups.items()}


def _swapped(pairs: dict[str, str]) -> Column:
    """The line with the pairs replaced in turn; each replacement reads the whole text, so pairs that may share a pattern do."""
    column, patterns = line(), _insertions(pairs)
    if patterns and len(patterns) < len(pairs):
        for a, x in patterns.items():
            column = F.regexp_replace(column, a, "$0" + re.sub(r"([\\$])", r"\\\1", x))
        return column
    for a, b in pairs.items():
        column = F.replace(column, F.lit(a), F.lit(b))
    return column


def _swapped_sql(pairs: dict[str, str]) -> str:
    sql = LINE_SQL
    for a, b in pairs.items():
        sql = f"replace({sql}, '{a}', '{b}')"
    return sql


def _built(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def _findings(docs: DataFrame, rule: str, options: dict, **more) -> DataFrame:
    return analyze(docs, {"rules": {rule: {"ruleId": rule, **options}}, **more}).select("doc_id", "rule_id", "start", "end", "severity", "message", "actual", "threshold")


def _rows(rule: str, source: str, message: str, actual: str = "NULL", threshold: object = "NULL", where: str = "true") -> str:
    """The findings' SQL; {x} in the message is an SQL expression."""
    parts = message.replace("{", "' || CAST(").replace("}", " AS VARCHAR) || '")
    return f"""SELECT doc_id, '{rule}' AS rule_id, "start", "end", '{"error" if rule < "D006" else "warning"}' AS severity, '{parts}' AS message, CAST({actual} AS INTEGER) AS actual, CAST({threshold} AS INTEGER) AS threshold FROM {source} WHERE {where}"""


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, sql: str, query) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def _rule(name: str, rule: str, options: dict, pairs: dict[str, str], sql) -> None:
    """A rule over the line with the pairs replaced; sql gets the SELECT of the texts."""
    documents = f"SELECT doc_id, lang, 0 AS base, {_swapped_sql(pairs)} AS t FROM documents"
    _add(name, sql(documents), lambda spark, sf_dir: _findings(_built(spark, sf_dir, _swapped(pairs)), rule, options))


# --- Markdown -------------------------------------------------------------------------------------


def _third(k: int) -> Column:
    """A third of the line, behind a letter that keeps it from being empty or from opening a list."""
    n = F.floor(F.length(line()) / 3).cast("int")
    part = F.substring(line(), F.lit(1) + n * k, n) if k < 2 else F.substring(line(), F.lit(1) + n * k, F.length(line()))
    return F.concat(F.lit("k"), F.trim(part))


THIRDS_SQL = f"""lines AS (SELECT doc_id, lang, {LINE_SQL} AS t FROM documents), sized AS (SELECT *, length(t) // 3 AS n FROM lines),
thirds AS (SELECT doc_id, lang, 'k' || trim(substr(t, 1, n)) AS a, 'k' || trim(substr(t, 1 + n, n)) AS b, 'k' || trim(substr(t, 1 + 2 * n)) AS c FROM sized)"""
A, B, C = range(3)


def _text(*parts: str | int) -> Column:
    """Literal parts and thirds of the line."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else _third(p) for p in parts))


def markdown_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of a code span, a fence and an indented block."""
    docs = _built(spark, sf_dir, _text(A, " `", B, "` ", C, "\n\n```\n", A, "\n```\n\n    ", B, "\n\n", C))
    return structure(docs, fields=("code",)).select("doc_id", F.inline_outer("code")).where("start is not null")


_add(
    "markdown_code",
    f"""WITH {THIRDS_SQL}, x AS (SELECT doc_id, length(a) AS a, length(b) AS b, length(c) AS c FROM thirds)
SELECT doc_id, CAST(a + 1 AS INTEGER) AS "start", CAST(a + b + 3 AS INTEGER) AS "end", false AS block FROM x
UNION ALL SELECT doc_id, CAST(a + b + c + 6 AS INTEGER), CAST(2 * a + b + c + 14 AS INTEGER), true FROM x
UNION ALL SELECT doc_id, CAST(2 * a + b + c + 16 AS INTEGER), CAST(2 * a + 2 * b + c + 20 AS INTEGER), true FROM x""",
    markdown_code,
)


def markdown_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected paragraphs of a list, a link, an emphasis in a quote and plain text; headings and tables are none."""
    docs = _built(spark, sf_dir, _text("# ", A, "\n\n* ", B, "\n* [", C, "](http://x.test/y)！\n\n> **", A, "** ", B, "\n\n| h | i |\n| - | - |\n| ", B, " | x |\n\n", C))
    rows = rows_of(structure(docs, fields=("paragraphs", "counts")), "paragraphs", "doc_id").withColumnRenamed("paragraphs", "p")
    return rows.select("doc_id", "p.start", "p.end", F.col("p.text").alias("projection"), F.col("p.sentences").alias("n_sentences"))


_add(
    "markdown_paragraphs",
    f"""WITH {THIRDS_SQL}, x AS (SELECT *, length(a) AS la, length(b) AS lb, length(c) AS lc FROM thirds),
p AS (SELECT doc_id, la + 6 AS s, lb AS n, b AS t FROM x
UNION ALL SELECT doc_id, la + lb + 9, lc + 20, c || '！' FROM x
UNION ALL SELECT doc_id, la + lb + lc + 33, la + lb + 5, a || ' ' || b FROM x
UNION ALL SELECT doc_id, 2 * la + 3 * lb + lc + 70, lc, c FROM x)
SELECT doc_id, CAST(s AS INTEGER) AS "start", CAST(s + n AS INTEGER) AS "end", t AS projection, CAST(len([y for y in regexp_extract_all(trim(t), '{PLAIN}') if trim(y) <> '']) AS INTEGER) AS n_sentences FROM p""",
    markdown_paragraphs,
)


def markdown_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected paragraphs of task items, of footnotes and of texts that refer to them: boxes and references are no text."""
    docs = _built(spark, sf_dir, _text("- [ ] ", A, "\n- [x] ", B, "[^1]！\n\n", C, "[^n]！\n\n[^n]: ", A))
    rows = rows_of(structure(docs, fields=("paragraphs",)), "paragraphs", "doc_id").withColumnRenamed("paragraphs", "p")
    return rows.select("doc_id", "p.start", "p.end", F.col("p.text").alias("projection"))


_add(
    "markdown_notes",
    f"""WITH {THIRDS_SQL}, x AS (SELECT *, length(a) AS la, length(b) AS lb, length(c) AS lc FROM thirds),
p AS (SELECT doc_id, 6 AS s, la AS n, a AS t FROM x UNION ALL SELECT doc_id, la + 13, lb + 5, b || '！' FROM x
UNION ALL SELECT doc_id, la + lb + 20, lc + 5, c || '！' FROM x UNION ALL SELECT doc_id, la + lb + lc + 33, la, a FROM x)
SELECT doc_id, CAST(s AS INTEGER) AS "start", CAST(s + n AS INTEGER) AS "end", t AS projection FROM p""",
    markdown_notes,
)


def code_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences outside a fence, which also ends them."""
    return _findings(_built(spark, sf_dir, _text(A, "\n\n```\n", B, "\n```\n\n", C)), "H101", {"threshold": 40}, exclude={"codeBlocks": True})


_PARTS = "SELECT doc_id, lang, 0 AS base, a AS t FROM thirds UNION ALL SELECT doc_id, lang, length(a) + length(b) + 12, c FROM thirds"
_add("code_exclusion", f"WITH {THIRDS_SQL}, {sentences_sql(_PARTS)} {_rows('H101', 'sentences', said.TEXT['H101'].format(t=40, a='{length(s)}'), 'length(s)', 40, 'length(s) > 40')}", code_exclusion)

# --- sentences and their rules --------------------------------------------------------------------

PROTECTED = {"v": "「左。右。」", "k": "『"}


def sentences_in_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks inside pairs end no sentence; an opener without its closer protects nothing."""
    rows = rows_of(structure(_built(spark, sf_dir, _swapped(PROTECTED)), fields=("sentences",)), "sentences", "doc_id").withColumnRenamed("sentences", "s")
    return rows.select("doc_id", "s.start", "s.end")


_add("sentences_in_pairs", f"""WITH {sentences_sql(f"SELECT doc_id, lang, 0 AS base, {_swapped_sql(PROTECTED)} AS t FROM documents", PAIRED)} SELECT doc_id, "start", "end" FROM sentences""", sentences_in_pairs)

STYLE = "CASE WHEN regexp_matches(s, 'です[。！？]+$') THEN 'desu-masu' WHEN regexp_matches(s, 'である[。！？]+$') THEN 'da-dearu' END"
_rule("d001_styles", "D001", {"style": "consistent"}, {"a。": "です。", "e。": "である。"}, lambda t: f"""WITH {sentences_sql(t)}, told AS (SELECT *, {STYLE} AS style FROM sentences WHERE {STYLE} IS NOT NULL),
based AS (SELECT *, first_value(style) OVER (PARTITION BY doc_id ORDER BY i) AS base FROM told) {_rows("D001", "based", said.TEXT["D001"].format(a="{base}", b="{style}"), where="style <> base")}""")

_rule("h102_clauses", "H102", {}, {"、": "です、", "。": "でした。"}, lambda t: f"""WITH {sentences_sql(t)}, told AS (SELECT *, len([c for c in regexp_extract_all(s, '[^、]+') if regexp_matches(c, '(です|でした)[。！？ ]*$')]) AS n FROM sentences)
{_rows("H102", "told", said.TEXT["H102"].format(t=4, a="{n}"), "n", 4, "n > 4")}""")

NESTED = {"v": "（イ）", "q": "「（ロ）」", "b": "『「（ハ）」』", "j": "】"}
_rule("h104_nested", "H104", {"threshold": 1}, NESTED, lambda t: f"""WITH {sentences_sql(t)}, told AS (SELECT *, CASE WHEN contains(s, '】') THEN 0 WHEN contains(s, '『') THEN 3 WHEN contains(s, '「') THEN 2 ELSE 0 END AS n FROM sentences)
{_rows("H104", "told", said.TEXT["H104"].format(t=1, a="{n}"), "n", 1, "n > 1")}""")

_rule("h106_ratio", "H106", {"threshold": 5}, {" a": " これは", " d": " その"}, lambda t: f"""WITH {sentences_sql(t)}, told AS (SELECT doc_id, min("start") AS "start", max("end") AS "end", count(*) AS n, sum(len(regexp_extract_all(' ' || s, '[ 。！？、]これは|[ 。！？、は]その'))) AS k FROM sentences GROUP BY doc_id),
rated AS (SELECT *, CAST(floor(k * 100.0 / n + 0.5) AS INTEGER) AS actual FROM told WHERE n >= 3 AND k >= 3) {_rows("H106", "rated", said.TEXT["H106"].format(t=5, a="{actual}"), "actual", 5, "actual > 5")}""")


def _runs_sql(rule: str, label: str):
    return lambda t: f"""WITH {sentences_sql(t)}, told AS (SELECT *, {label} AS label FROM sentences),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, label ORDER BY i) AS island FROM told WHERE label IS NOT NULL),
runs AS (SELECT doc_id, min("start") AS "start", max("end") AS "end", count(*) AS n FROM islands GROUP BY doc_id, label, island)
{_rows(rule, "runs", said.TEXT[rule].format(t=2, a="{n}"), "n", 2, "n > 2")}"""


#: Rules on runs, with what replaces parts of the prose.
RUNS = {
    "h107_runs": ("H107", {f"{m} {c}": f"{m} {'また' if c in 'ABCDEFGHIabcdefghi' else 'しかし'}、{c}" for m in "。！？" for c in "ABCDEFGHIJKLMNOPQRSTUVWabcdefghijklmnopqrstuvw"}),
    "h108_runs": ("H108", {"a。": "です。", "e。": "です。", "s。": "だ。", "n。": "だ。", "i。": "難しい。"}),
}
_rule("h107_runs", "H107", {}, RUNS["h107_runs"][1], _runs_sql("H107", "nullif(regexp_extract(s, '^(また|しかし)、', 1), '')"))
_rule("h108_runs", "H108", {}, RUNS["h108_runs"][1], _runs_sql("H108", "nullif(regexp_extract(s, '(です|だ|難しい)[。！？]+$', 1), '')"))


def sentence_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a sentence with a document's words in it; ranges count from an offset, as in a text."""
    words = F.regexp_replace(line(), "[。！？、 ]+", "")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("「しかし、😀"), words, F.lit("は、これを説明しますね。")).alias("s"))
    rows = docs.select("doc_id", F.explode(ja.tokens(F.col("s"), F.pmod("doc_id", F.lit(100)).cast("int"))).alias("t"))
    return rows.select("doc_id", "t.role", "t.start", "t.end", F.col("t.surfaceForm").alias("surface"), "t.lemma", F.col("t.morphologyLabel").alias("label"))


_add(
    "sentence_tokens",
    f"""WITH w AS (SELECT doc_id, doc_id % 100 AS o, length(regexp_replace({LINE_SQL}, '[。！？、 ]+', '', 'g')) AS n FROM documents),
x(role, a, k, surface, lemma, label) AS (VALUES ('leading', 1, 0, 'しかし', 'しかし', NULL), ('demonstrative', 9, 1, 'これ', 'これ', NULL), ('terminal', 12, 1, '説明します', '説明する', 'verb:説明する:polite-nonpast|particle:ね'))
SELECT doc_id, role, CAST(o + a + k * n AS INTEGER) AS "start", CAST(o + a + k * n + length(surface) AS INTEGER) AS "end", surface, lemma, label FROM w, x""",
    sentence_tokens,
)

# --- scans ----------------------------------------------------------------------------------------


def _places(pattern: str) -> str:
    """CTE marks(doc_id, m, b, i): the pattern's matches in docs.t, where each ends, and its number."""
    return f"""marks AS (SELECT doc_id, m, i, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM (
  SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(string_split_regex(t, '{pattern}')[:-2]) AS g, generate_subscripts(regexp_extract_all(t, '{pattern}'), 1) AS i FROM docs WHERE regexp_matches(t, '{pattern}')))"""


MARKED = chr(97) + chr(769)
_rule("d002_marks", "D002", {"normalization": "NFC"}, {"ta": "t" + MARKED}, lambda t: f"""WITH docs AS ({t}), {_places(MARKED)}, spans AS (SELECT doc_id, CAST(b - 2 AS INTEGER) AS "start", CAST(b AS INTEGER) AS "end" FROM marks) {_rows("D002", "spans", said.TEXT["D002"])}""")

#: Letters that become brackets, so that the prose opens and closes them in any order.
BRACKETS = {"j": "（", "k": "）", "U": "「", "G": "」", "Q": "（「"}


def stack_sql(t: str) -> str:
    """A stack as text: what each open mark waits for with its place, the last one first; a mark that breaks the order is reported and takes the last one with it."""
    return f"""WITH RECURSIVE docs AS ({t}), {_places("[（）「」]")},
walk AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, '' AS stack, CAST(NULL AS VARCHAR) AS bad, CAST(0 AS HUGEINT) AS place FROM docs
UNION ALL SELECT w.doc_id, m.i, CASE WHEN m.m IN ('（', '「') THEN CASE m.m WHEN '（' THEN '）' ELSE '」' END || CAST(m.b AS VARCHAR) || ' ' || stack ELSE regexp_replace(stack, '^[^ ]* ', '') END,
  CASE WHEN m.m IN ('）', '」') AND (stack = '' OR left(stack, 1) <> m.m) THEN m.m END, m.b FROM walk w JOIN marks m ON m.doc_id = w.doc_id AND m.i = w.i + 1),
last AS (SELECT doc_id, stack FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1),
open AS (SELECT doc_id, unnest(regexp_extract_all(stack, '[^ ]+')) AS o FROM last),
spans AS (SELECT doc_id, bad AS m, CAST(place - 1 AS INTEGER) AS "start", CAST(place AS INTEGER) AS "end" FROM walk WHERE bad IS NOT NULL
UNION ALL SELECT doc_id, CASE left(o, 1) WHEN '）' THEN '（' ELSE '「' END, CAST(substr(o, 2) AS INTEGER) - 1, CAST(substr(o, 2) AS INTEGER) FROM open) {_rows("D003", "spans", said.TEXT["D003"].format(t="{m}"))}"""


_rule("d003_stack", "D003", {}, BRACKETS, stack_sql)


#: A document's words as three words, by whether their length is even, odd or one; a mark ends every chain of 40.
WORDS = (("[^ 。！？、]{2}", "z"), ("[^ 。！？、z]", "y"), ("z+", "z"), ("((?:[zy]+ ){40})", "{}1。"))


def _three_words() -> Column:
    column = line()
    for a, b in WORDS:
        column = F.regexp_replace(column, a, b.format("$"))
    return column


def _three_words_sql() -> str:
    sql = LINE_SQL
    for a, b in WORDS:
        sql = f"regexp_replace({sql}, '{a}', '{b.format(chr(92))}', 'g')"
    return sql


def d006_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated groups of every length in the whole prose, whose words become three."""
    return _findings(_built(spark, sf_dir, _three_words()), "D006", {"maxConsecutive": 1})


#: By the definition: of each word the longest group that repeats at once, all its copies, and a walk that jumps over them.
_add(
    "d006_groups",
    f"""WITH RECURSIVE docs AS (SELECT doc_id, {_three_words_sql()} AS t FROM documents),
cut AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^。！？、]+|[。！？、]+')) AS c, generate_subscripts(regexp_extract_all(t, '[^。！？、]+|[。！？、]+'), 1) AS i FROM docs),
placed AS (SELECT *, sum(length(c)) OVER (PARTITION BY doc_id ORDER BY i) - length(ltrim(c)) AS base FROM cut),
words AS (SELECT doc_id, i, base, [x for x in string_split(c, ' ') if x <> ''] AS w FROM placed WHERE regexp_matches(c, '[zy]')),
chains AS (SELECT DISTINCT w FROM words), starts AS (SELECT w, unnest(range(1, len(w))) AS s FROM chains), sizes AS (SELECT w, s, unnest(range(1, (len(w) - s + 1) // 2 + 1)) AS g FROM starts),
longest AS (SELECT w, s, max(g) AS g FROM sizes WHERE w[s:s + g - 1] = w[s + g:s + 2 * g - 1] GROUP BY w, s),
groups AS (SELECT *, list_min([k for k in range(2, len(w) + 1) if w[s:s + g - 1] <> w[s + k * g:s + (k + 1) * g - 1]]) AS copies FROM longest),
walk AS (SELECT w, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS g, CAST(0 AS BIGINT) AS copies, CAST(1 AS BIGINT) AS after FROM chains
UNION ALL SELECT w, s, g, copies, s + copies * g FROM (SELECT h.*, row_number() OVER (PARTITION BY h.w ORDER BY h.s) AS turn FROM walk k JOIN groups h ON h.w = k.w AND h.s >= k.after) WHERE turn = 1),
told AS (SELECT w, s, g, unnest(range(1, copies)) AS k FROM walk WHERE copies > 0),
spread AS (SELECT w, list_sum([length(x) + 1 for x in w[1:s + k * g - 1]]) AS a, list_sum([length(x) + 1 for x in w[1:s + (k + 1) * g - 1]]) - 1 AS b FROM told),
spans AS (SELECT doc_id, CAST(base + coalesce(a, 0) AS INTEGER) AS "start", CAST(base + b AS INTEGER) AS "end" FROM words JOIN spread USING (w)) {_rows("D006", "spans", said.TEXT["D006"])}""",
    d006_groups,
)

# --- order, reports and streams -------------------------------------------------------------------

def _one_row_each(rows: DataFrame, items: str) -> DataFrame:
    return rows.select("doc_id", F.posexplode_outer(items)).where("col is not null")


_COMMAS = "(length(s) - length(replace(s, '、', '')))"
ORDER = {"D007": {"patterns": ["ti", "at"]}, "H103": {"threshold": 1}, "H101": {"threshold": 60}, "D004": {"forbiddenTerms": ["at", "ti"]}, "D008": {"replacements": {"tiona": "x", "at": "y"}}}

def _terms_sql(name: str, pattern: str) -> str:
    return _places(pattern).replace("marks AS", f"{name} AS", 1)


_EVERY = f"""WITH {sentences_sql(f"SELECT doc_id, lang, 0 AS base, {LINE_SQL} AS t FROM documents")}, {_terms_sql("two", "ti|at")}, {_terms_sql("longer", "tiona|at")}, every AS (
SELECT doc_id, 'D007' AS rule_id, CAST(b - 2 AS INTEGER) AS "start", CAST(b AS INTEGER) AS "end", 1 AS k, 'deterministic' AS category, 'warning' AS severity, '{said.TEXT["D007"].format(t="' || m || '")}' AS message FROM two
UNION ALL SELECT doc_id, 'H103', "start", "end", 2, 'heuristic', 'warning', '{said.TEXT["H103"].format(t=1, a="' || CAST(" + _COMMAS + " AS VARCHAR) || '")}' FROM sentences WHERE {_COMMAS} > 1
UNION ALL SELECT doc_id, 'H101', "start", "end", 3, 'heuristic', 'warning', '{said.TEXT["H101"].format(t=60, a="' || CAST(length(s) AS VARCHAR) || '")}' FROM sentences WHERE length(s) > 60
UNION ALL SELECT doc_id, 'D004', CAST(b - 2 AS INTEGER), CAST(b AS INTEGER), 4, 'deterministic', 'error', '{said.TEXT["D004"].format(t="' || m || '")}' FROM two
UNION ALL SELECT doc_id, 'D008', CAST(b - length(m) AS INTEGER), CAST(b AS INTEGER), 5, 'deterministic', 'warning', '{said.TEXT["D008"].format(t="' || m || '", x="' || CASE m WHEN ''at'' THEN ''y'' ELSE ''x'' END || '").replace("''", "'")}' FROM longer)"""


def lint_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings with their places in the canonical order of analyze()."""
    config = {"rules": {r: {"ruleId": r, **o} for r, o in ORDER.items()}}
    rows = _one_row_each(with_findings(_built(spark, sf_dir, line()), config), "findings")
    return rows.select("doc_id", "pos", "col.rule_id", "col.start", "col.end", "col.message")


_add("lint_order", f"""{_EVERY} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", rule_id, k, message) - 1 AS INTEGER) AS pos, rule_id, "start", "end", message FROM every""", lint_order)


def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of the reports with their places in report order."""
    config = {"rules": {r: {"ruleId": r, **o} for r, o in ORDER.items()}}
    rows = _one_row_each(reports.report(_built(spark, sf_dir, line()), config), "lintMessages")
    return rows.select("doc_id", "pos", F.col("col.ruleId").alias("rule_id"), F.col("col.range.start").alias("start"), F.col("col.range.end").alias("end"), F.col("col.level").alias("level"), F.col("col.message").alias("message"))


_add("report_order", f"""{_EVERY} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", rule_id, category, severity, message) - 1 AS INTEGER) AS pos, rule_id, "start", "end", severity AS level, message FROM every""", report_order)


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings per rule and five minutes of arrival, appended once the watermark has passed the window; a document arrives each minute."""
    docs = table(spark, sf_dir, "documents")
    stream = streaming.documents(spark, f"{sf_dir}/documents.parquet*", docs.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), files=1 << 20)
    arrived = stream.select(F.timestamp_seconds(F.col("doc_id") * 60).alias("arrived"), line().alias("text"))
    rows = streaming.counts(arrived, {"rules": {"D007": {"ruleId": "D007", "patterns": ["ti", "at"]}, "H101": {"ruleId": "H101", "threshold": 60}}}, "arrived")
    flat = rows.select(F.unix_timestamp("window.start").alias("opened"), "rule_id", "n")
    where = temporary(spark, "counts")
    streaming.write(flat, f"{where}/out", f"{where}/state").awaitTermination()
    return spark.read.schema(flat.schema).parquet(f"{where}/out")


_add(
    "stream_counts",
    f"""{_EVERY}, per AS (SELECT doc_id * 60 // 300 * 300 AS opened, rule_id, count(*) AS n FROM every WHERE rule_id IN ('D007', 'H101') GROUP BY ALL)
SELECT CAST(opened AS BIGINT) AS opened, rule_id, n FROM per WHERE opened + 300 <= (SELECT max(doc_id) * 60 - 600 FROM documents)""",
    stream_counts,
)
