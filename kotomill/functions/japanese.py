"""Surface analysis of one Japanese sentence, as column expressions.

A sentence's clauses end at commas and semicolons; each ends in at most one predicate. What ends a text is read from the text
reversed: a pattern made from a trie of the reversed endings is tried at the first character only and walks once along the ending, instead of looking for it from
every character on. All tests are regular expressions and table look-ups that stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .utf16 import SPACE, length, let

STEM = r"[\p{IsHan}\p{IsKatakana}ー]+"

# Tables of the surface analyser.
OPENERS = "「『（【["
STOPS = "、，,。！？!? \n\t"
PARTICLES = "はがをにでとのもへや"
PRONOUNS = ("これら", "それら", "あれら", "あそこ", "これ", "それ", "あれ", "ここ", "そこ")
DETERMINERS = ("この", "その", "あの")
ADVERBS = ("こう", "そう", "ああ")
ADVERB_FOLLOWERS = "しなだで言考思見話書読行進変、。！？!? "
LEADERS = ("そのため", "しかし", "または", "そして", "ところで", "一方", "まず", "次に", "また", "さらに", "これら", "それら", "あれら", "あそこ", "これ", "それ", "あれ", "この", "その", "あの", "ここ", "そこ", "こう", "そう", "ああ")
SURU_ENDINGS = ("できませんでした", "できました", "できます", "しませんでした", "しました", "しません", "します", "して", "した", "する")
MASU_FORMS = {"ませんでした": "polite-negative-past", "ました": "polite-past", "ません": "polite-negative-nonpast", "ます": "polite-nonpast"}
COPULAS = {"でした": ("です", "polite-past"), "だった": ("だ", "plain-past"), "です": ("です", "polite-nonpast"), "だ": ("だ", "plain-nonpast")}
CONJUNCTIVE = {"読み": "読む", "書き": "書く", "考え": "考える", "調べ": "調べる", "説明し": "説明する", "確認し": "確認する", "実行し": "実行する", "利用し": "利用する", "検討し": "検討する", "使い": "使う", "作り": "作る", "行い": "行う", "進め": "進める", "比べ": "比べる"}
POLITE_STEMS = {"読み": "読む", "書き": "書く", "話し": "話す", "使い": "使う", "行い": "行う", "進み": "進む", "調べ": "調べる", "考え": "考える", "見": "見る", "比べ": "比べる"}
ADJECTIVES = {
    "美しくない": ("美しい", "plain-nonpast"), "難しくない": ("難しい", "plain-nonpast"), "易しくない": ("易しい", "plain-nonpast"), "少なくない": ("少ない", "plain-nonpast"),
    "美しかった": ("美しい", "plain-past"), "難しかった": ("難しい", "plain-past"), "易しかった": ("易しい", "plain-past"), "高かった": ("高い", "plain-past"), "低かった": ("低い", "plain-past"),
    "美しい": ("美しい", "plain-nonpast"), "難しい": ("難しい", "plain-nonpast"), "易しい": ("易しい", "plain-nonpast"), "少ない": ("少ない", "plain-nonpast"),
    "新しい": ("新しい", "plain-nonpast"), "古い": ("古い", "plain-nonpast"), "高い": ("高い", "plain-nonpast"), "低い": ("低い", "plain-nonpast"), "長い": ("長い", "plain-nonpast"),
    "短い": ("短い", "plain-nonpast"), "良い": ("良い", "plain-nonpast"), "悪い": ("悪い", "plain-nonpast"), "多い": ("多い", "plain-nonpast"), "ない": ("ない", "plain-nonpast"),
}
PLAIN_VERBS = {
    "読む": ("読む", "plain-nonpast"), "読んだ": ("読む", "plain-past"), "書く": ("書く", "plain-nonpast"), "書いた": ("書く", "plain-past"),
    "考える": ("考える", "plain-nonpast"), "考えた": ("考える", "plain-past"), "調べる": ("調べる", "plain-nonpast"), "調べた": ("調べる", "plain-past"),
    "確認する": ("確認する", "plain-nonpast"), "確認した": ("確認する", "plain-past"), "説明する": ("説明する", "plain-nonpast"), "説明した": ("説明する", "plain-past"),
    "使う": ("使う", "plain-nonpast"), "使った": ("使う", "plain-past"), "見る": ("見る", "plain-nonpast"), "見た": ("見る", "plain-past"),
    "話す": ("話す", "plain-nonpast"), "話した": ("話す", "plain-past"),
}
CLAUSE_VERBS = ("読む", "書く", "考える", "調べる", "使う", "作る", "行う", "進む", "進める", "比べる", "見る", "話す")

MARKS = rf"[{SPACE}。．.!！?？…」』）】\]]"
SEPARATORS = "、，,；;"
STEM_CUTS = "はがをにでともへ"


def _class(chars: str) -> str:
    return "".join(f"\\{c}" if c in "[]\\^-" else c for c in chars)


def _any(words) -> str:
    return "|".join(words)


def reversed_endings(words: Iterable[str]) -> str:
    """A pattern for the reversed words, the longest first, that reads every character of a common beginning once."""
    trie: dict = {}
    for word in words:
        node = trie
        for c in reversed(word):
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        more = "|".join(c + pattern(after) for c, after in node.items() if c)
        return f"(?:{more}){'?' if '' in node else ''}" if more else ""

    return pattern(trie)


def clauses(sentence: Column) -> Column:
    return F.regexp_extract_all(sentence, F.lit(f"[^{SEPARATORS}]+"), F.lit(0))


def _pick(key: Column, table) -> Column:
    return reduce(lambda c, kv: c.when(key == kv[0], F.lit(kv[1])), table.items(), F.when(F.lit(False), F.lit("")))


def _polite_lemma(stem: Column) -> Column:
    known = _pick(stem, POLITE_STEMS)
    cut = lambda n: F.substring(stem, F.lit(1), F.length(stem) - n)
    return known.when(stem.endswith("でき"), F.concat(cut(2), F.lit("できる"))).when(stem.endswith("し"), F.concat(cut(1), F.lit("する"))).otherwise(stem)


_STEM_BACK = rf"[^{STEM_CUTS}]"
_COPULA_ENDS = ("でした", "だった", "である", "です", "だ")
#: The kinds of predicates, reversed, in the order in which they are tried: suru verbs with their stem, polite verbs with theirs, copulas, conjunctive forms, adjectives, plain verbs with what stands before them.
_PREDICATE = rf"\A{MARKS}*+(?:({reversed_endings(SURU_ENDINGS)})({STEM})|({reversed_endings(MASU_FORMS)})({_STEM_BACK}+)|({reversed_endings(_COPULA_ENDS)})|({reversed_endings(CONJUNCTIVE)})|({reversed_endings(ADJECTIVES)})|({reversed_endings(CLAUSE_VERBS)}{STEM}))"


def predicate(clause: Column) -> Column:
    """(surface, lemma) of the predicate that ends a clause, or null; the first kind that fits wins."""
    return let(F.reverse(clause), _predicate)


def _predicate(back: Column) -> Column:
    part = lambda group: F.reverse(F.regexp_extract(back, _PREDICATE, group))
    both = lambda surface, lemma: F.struct(surface.alias("surface"), lemma.alias("lemma"))
    suru = lambda end, stem: both(F.concat(stem, end), F.concat(stem, F.when(end.startswith("でき"), F.lit("できる")).otherwise(F.lit("する"))))
    masu = lambda end, stem: both(F.concat(stem, end), _polite_lemma(stem))
    named = lambda group, lemma: F.when(part(group) != "", let(part(group), lambda x: both(x, lemma(x))))
    found = F.coalesce(
        F.when(part(1) != "", let(part(1), lambda end: let(part(2), lambda stem: suru(end, stem)))),
        F.when(part(3) != "", let(part(3), lambda end: let(part(4), lambda stem: masu(end, stem)))),
        named(5, lambda c: F.when(c.startswith("で"), F.lit("です")).otherwise(F.lit("だ"))),
        named(6, lambda c: _pick(c, CONJUNCTIVE)), named(7, lambda a: a), named(8, lambda v: v),
    )
    return F.when(back.rlike(_PREDICATE), found)


def predicates(sentence: Column) -> Column:
    return F.filter(F.transform(clauses(sentence), predicate), lambda p: p.isNotNull())


#: A reversed clause with a predicate: behind the sentence's end or a separator; the character before a polite form must be of the same clause.
_PREDICATES = rf"(?:\A|[{SEPARATORS}]){MARKS}*+(?:{reversed_endings((*_COPULA_ENDS, *CONJUNCTIVE, *ADJECTIVES))}|{reversed_endings(SURU_ENDINGS)}{STEM[:-1]}|{reversed_endings(MASU_FORMS)}[^{STEM_CUTS}{SEPARATORS}]|{reversed_endings(CLAUSE_VERBS)}{STEM[:-1]})"


def predicate_count(sentence: Column) -> Column:
    """Number of clauses that end in a predicate, in one pass over the reversed sentence."""
    return F.regexp_count(F.reverse(sentence), F.lit(_PREDICATES))


_NEXT = _class(PARTICLES + STOPS)
#: What a demonstrative begins with is looked for first: nearly every character fails there.
_BEGINS = _class("".join(sorted({w[0] for w in (*PRONOUNS, *DETERMINERS, *ADVERBS)})))
DEMONSTRATIVE = rf"(?=[{_BEGINS}])(?<![^{_class(OPENERS + STOPS + PARTICLES)}])(?:(?:{_any(PRONOUNS)})(?=[{_NEXT}]|\z)|{_any(DETERMINERS)}|(?:{_any(ADVERBS)})(?=[{ADVERB_FOLLOWERS}]|\z))"


def demonstratives(sentence: Column) -> Column:
    return F.regexp_extract_all(sentence, F.lit(DEMONSTRATIVE), F.lit(0))


def leading(sentence: Column) -> Column:
    """The word that opens a sentence if a comma, white space or the end follows it, or null."""
    pattern = rf"\A[{SPACE}「『（【\[(]*+((?:{_any(LEADERS)})|[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}ー]+?)(?=[、，,{SPACE}]|\z)"
    return F.nullif(F.regexp_extract(sentence, pattern, 1), F.lit(""))


#: What ends a sentence, reversed: the particle and the longest known ending before it.
_ENDS = rf"\A{MARKS}*+([かねよぞ]?+)({reversed_endings((*MASU_FORMS, *COPULAS, *ADJECTIVES, *PLAIN_VERBS))})"
_MASU_STEM = rf"\A{MARKS}*+[かねよぞ]?+{reversed_endings(MASU_FORMS)}({_STEM_BACK}*)"
_FORMS = {c: ("copula", *known) for c, known in COPULAS.items()} | {a: ("adjective", *known) for a, known in ADJECTIVES.items()} | {v: ("verb", *known) for v, known in PLAIN_VERBS.items()}
_LABELS, _LEMMAS = {x: ":".join(known) for x, known in _FORMS.items()}, {x: known[1] for x, known in _FORMS.items()}


def terminal(sentence: Column) -> Column:
    """The morphology label of a sentence's end, or null."""
    label = lambda back: F.when(back.rlike(_ENDS), F.concat(_ending(back)["label"], _tail(F.regexp_extract(back, _ENDS, 1))))
    return let(F.reverse(sentence), label)


def _tail(particle: Column) -> Column:
    return F.when(particle == "", F.lit("")).otherwise(F.concat(F.lit("|particle:"), particle))


def _ending(back: Column) -> Column:
    """(surface, lemma, label) of the form that ends a reversed sentence before its marks and particle, or null.

    The longest known ending decides: a plain verb in だ goes before the copula, a negative adjective before ない.
    """
    whole = lambda surface, lemma, label: F.struct(surface.alias("surface"), lemma.alias("lemma"), label.alias("label"))
    polite = lambda end, stem, lemma: whole(F.concat(stem, end), lemma, F.concat_ws(":", F.lit("verb"), lemma, _pick(end, MASU_FORMS)))
    stem = F.reverse(F.regexp_extract(back, _MASU_STEM, 1))
    of = lambda end: F.when(end.isin(*MASU_FORMS), let(stem, lambda stem: let(_polite_lemma(stem), lambda lemma: polite(end, stem, lemma)))).when(end != "", whole(end, _pick(end, _LEMMAS), _pick(end, _LABELS)))
    return let(F.reverse(F.regexp_extract(back, _ENDS, 2)), of)


TOKEN = "struct<start:int,role:string,surfaceForm:string,lemma:string,end:int,morphologyLabel:string>"


def _token(role: str, surface: Column, lemma: Column, start: Column, label: Column | None = None) -> Column:
    end = start + length(surface)
    return F.struct(start.cast("int").alias("start"), F.lit(role).alias("role"), surface.alias("surfaceForm"), lemma.alias("lemma"), end.cast("int").alias("end"), (F.lit(None).cast("string") if label is None else label).alias("morphologyLabel"))


def _placed(pieces: Column) -> Column:
    """The pieces of a sentence with the offsets where they start; a sentence has few."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,text:string>>").alias("out"))
    step = lambda a, x: F.struct((a["at"] + length(x)).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), x.alias("text")))).alias("out"))
    return F.aggregate(pieces, zero, step, lambda a: a["out"])


def tokens(sentence: Column, offset: Column) -> Column:
    """The sentence's leading, predicate, demonstrative and terminal tokens, sorted by start and role; ranges are UTF-16 units from ``offset``."""
    none = F.array().cast(f"array<{TOKEN}>")
    one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(none)
    opened = F.regexp_extract(sentence, rf"\A[{SPACE}「『（【\[(]*+", 0)
    first = let(leading(sentence), lambda word: one(F.when(word.isNotNull(), _token("leading", word, word, offset + length(opened)))))
    parts = _placed(F.regexp_extract_all(sentence, F.lit("[^、，,；;]+|[、，,；;]+"), F.lit(0)))

    def before_marks(text: Column) -> Column:
        return length(text) - length(F.regexp_extract(F.reverse(text), rf"\A{MARKS}*+", 0))

    def ended(p: Column) -> Column:
        start = lambda found: offset + p["at"] + before_marks(p["text"]) - length(found["surface"])
        return let(predicate(p["text"]), lambda found: F.when(found.isNotNull(), _token("predicate", found["surface"], found["lemma"], start(found))))

    second = F.filter(F.transform(parts, ended), lambda t: t.isNotNull())
    gaps = F.arrays_zip(F.split(sentence, DEMONSTRATIVE).alias("gap"), demonstratives(sentence).alias("hit"))
    pieces = F.flatten(F.transform(F.filter(gaps, lambda g: g["hit"].isNotNull()), lambda g: F.array(g["gap"], g["hit"])))
    third = F.transform(F.filter(F.transform(_placed(pieces), lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: x["i"] % 2 == 1), lambda x: _token("demonstrative", x["p"]["text"], x["p"]["text"], offset + x["p"]["at"]))

    def last(back: Column) -> Column:
        particle = F.regexp_extract(back, _ENDS, 1)
        start = lambda e: offset + before_marks(sentence) - length(particle) - length(e["surface"])
        return let(_ending(back), lambda e: one(F.when(e.isNotNull(), _token("terminal", e["surface"], e["lemma"], start(e), F.concat(e["label"], _tail(particle))))))

    fourth = let(F.reverse(sentence), last)
    return F.array_sort(F.concat(first, second, third, fourth))


def analysis(sentence: Column, offset: Column) -> Column:
    """What the analyser finds in a sentence: its tokens, the number of predicates, demonstratives, and the labels of either end."""
    return F.struct(
        tokens(sentence, offset).alias("tokens"), predicate_count(sentence).alias("predicateGroupCount"), demonstratives(sentence).alias("demonstrativeLemmas"),
        leading(sentence).alias("leadingSurfaceLabel"), terminal(sentence).alias("terminalMorphologyLabel"),
    )
