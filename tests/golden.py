"""Cases per rule: configuration and texts, in which ⟦⟧ mark what is found; each mark has its message and the value seen."""

from __future__ import annotations

from kotomill.messages import TEXT

GA = "が"


def case(marked: str, *found: tuple[str, int | None] | str) -> tuple[str, list[tuple[int, int, int | None, str]]]:
    """(text, [(start, end, actual, message), ...]) with ranges in UTF-16 units."""
    text, spans, at = "", [], []
    for c in marked:
        if c == "⟦":
            at.append(len(text.encode("utf-16-le")) // 2)
        elif c == "⟧":
            spans.append((at.pop(), len(text.encode("utf-16-le")) // 2))
        else:
            text += c
    told = [(f, None) if isinstance(f, str) else f for f in found]
    return text, [(s, e, actual, message) for (s, e), (message, actual) in zip(spans, told, strict=True)]


def say(rule: str, **parts: object) -> str:
    return TEXT[rule].format(**parts)


def over(rule: str, threshold: int, actual: int) -> tuple[str, int]:
    return TEXT[rule].format(t=threshold, a=actual), actual


POLITE, PLAIN = say("D001", a="desu-masu", b="da-dearu"), say("D001", a="da-dearu", b="desu-masu")
MARK, TERM, TWICE = (lambda t: say("D003", t=t)), (lambda t: say("D004", t=t)), say("D006")
LONG = "山" * 100

CASES: dict[str, tuple[str, dict, list]] = {
    "d001_consistent": ("D001", {"style": "consistent"}, [
        case("朝は雨です。⟦昼は曇りである。⟧", POLITE),
        case("傘を貸す。次の駅へ。到着。"),
        case("朝は雨です。⟦😀夜は雪だった。⟧", POLITE),
        case("犬である。「猫でした。」と答えた。『鳥です。』"),
        case("朝は雨です。⟦昼は雪だ。⟧⟦夜は風である。⟧", POLITE, POLITE),
        case(""),
    ]),
    "d001_polite": ("D001", {"style": "desu-masu"}, [case("⟦海は青だ。⟧空も青です。⟦山は緑であった。⟧", POLITE, POLITE), case("海へ行きました。")]),
    "d001_plain": ("D001", {"style": "da-dearu"}, [case("⟦海へ行きません。⟧⟦山へ行きましょう。⟧空は青である。", PLAIN, PLAIN), case("空は青だった。")]),
    "d002_marks": ("D002", {"normalization": "NFC"}, [
        case(f"⟦{GA}⟧", say("D002")),
        case(f"⟦{GA}⟧やö⟦ö⟧", say("D002"), say("D002")),
        case("q́"), case("́"),
        case(f"😀⟦{GA}⟧", say("D002")), case(f"⟦{GA}́⟧", say("D002")),
        case(f"`{GA}`\n\n~~~\n{GA}\n~~~\n\n    {GA}"),
    ]),
    "d003_brackets": ("D003", {}, [
        case("（駅前⟦]⟧", MARK("]")), case("駅前⟦『⟧", MARK("『")), case("⟦」⟧駅前", MARK("」")),
        case("[駅]【前】『の』「店」（は）"),
        case("「（駅⟦」⟧⟦）⟧", MARK("」"), MARK("）")),
        case("⟦【⟧\n\n~~~\nq\n~~~\n\n⟦】⟧", MARK("【"), MARK("】")),
    ]),
    "d003_own_pairs": ("D003", {"pairs": [["<<", ">>"]]}, [case("⟦<<⟧駅]", MARK("<<")), case("<<駅>>「")]),
    "d004_kana": ("D004", {"forbiddenTerms": ["絶対", "もの", "ルール"]}, [
        case("⟦絶対⟧に勝つ", TERM("絶対")), case("⟦絶対⟧値", TERM("絶対")), case("ものさし"), case("漢⟦もの⟧、", TERM("もの")), case("ルールブック"),
        case("`絶対`\n\n~~~\n絶対\n~~~\n\n    絶対\n\n⟦絶対⟧", TERM("絶対")),
    ]),
    "d004_longest": ("D004", {"forbiddenTerms": ["絶対", "絶対安全", "klm", "lmno"]}, [case("⟦絶対安全⟧だ", TERM("絶対安全")), case("⟦klm⟧no", TERM("klm"))]),
    "d005_terms": ("D005", {"terminology": {"メモリ": "memory", "メモリー": "メモリ"}}, [case("⟦メモリー⟧を足す", say("D005", t="メモリー", x="メモリ")), case("⟦メモリ⟧を足す", say("D005", t="メモリ", x="memory")), case("足す")]),
    "d006_once": ("D006", {"maxConsecutive": 1}, [
        case("大変⟦大変⟧だ", TWICE), case("大変　 ⟦大変⟧", TWICE), case("大変⟦大変⟧⟦大変⟧", TWICE, TWICE), case("大変なほど大変"), case("大変、大変"), case("京都大学⟦京都大学⟧", TWICE),
    ]),
    "d006_twice": ("D006", {"maxConsecutive": 2}, [case("大変大変⟦大変⟧", TWICE), case("大変大変だ")]),
    "d007_default": ("D007", {}, [case("飲め⟦ないわけではない⟧", say("D007", t="ないわけではない")), case("ない訳ではない")]),
    "d007_own": ("D007", {"patterns": ["zz"]}, [case("⟦zz⟧⟦zz⟧z", say("D007", t="zz"), say("D007", t="zz")), case("飲めないわけではない")]),
    "d007_none": ("D007", {"patterns": []}, [case("飲めないわけではない")]),
    "d008_default": ("D008", {}, [case("泳ぎを練習⟦することができる⟧", say("D008", t="することができる", x="できる")), case("すること"), case("する。ことができる")]),
    "d008_own": ("D008", {"replacements": {"掃除を行う": "掃除する"}}, [case("練習することができる。⟦掃除を行う⟧。", say("D008", t="掃除を行う", x="掃除する"))]),
    "h101": ("H101", {}, [case("山" * 99 + "。"), case(f"⟦{LONG}。⟧", over("H101", 100, 101)), case("⟦" + "😀" * 50 + "。⟧", over("H101", 100, 101)), case(f" ⟦{LONG}。⟧  ", over("H101", 100, 101))]),
    "h102": ("H102", {}, [
        case("⟦朝は本を読み、昼は絵を書き、町を調べ、店を比べ、夜は道具を使います。⟧", over("H102", 4, 5)),
        case("朝は本を読み、昼は絵を書き、町を調べ、夜は道具を使います。"),
        case("⟦水を使い、問題が難しい、値段は高い、冬です、最後に説明します。⟧", over("H102", 4, 5)),
        case("春、夏、秋、冬、年、説明します。"),
    ]),
    "h103": ("H103", {}, [case("春、夏、秋、冬、年。"), case("⟦春、夏、秋、冬、年、月。⟧", over("H103", 4, 5)), case("p,q,r,s,t,u，v")]),
    "h104": ("H104", {}, [case("（『山』）の絵。"), case("⟦[（『山』）]の絵。⟧", over("H104", 2, 3)), case("「山）の絵。")]),
    "h106": ("H106", {}, [case("⟦ここは駅です。そこは店です。それは本です。⟧", over("H106", 50, 100)), case("ここは駅です。そこは店です。"), case("ここは駅です。雨が降る。そこは店です。風が吹く。それは本です。雪が積む。")]),
    "h107": ("H107", {}, [
        case("⟦まず、水を飲みます。まず、本を見ます。まず、絵を比べます。⟧", over("H107", 2, 3)),
        case("まず、水を飲みます。まず、本を見ます。"), case("まず、水を飲みます。次に、本を見ます。まず、絵を比べます。"), case("まず、飲みます。まず、見ます。\n\nまず、比べます。"),
    ]),
    "h108": ("H108", {}, [
        case("⟦水を検査します。絵を検査します。本を検査します。⟧", over("H108", 2, 3)), case("水を検査します。絵を検査します。"), case("駅です。駅ですね。駅だった。"),
        case("⟦絵を書く。字を書く。詩を書く。⟧", over("H108", 2, 3)), case("駅である。店である。町である。"),
    ]),
    "h112": ("H112", {}, [case("川" * 500), case("⟦" + "川" * 501 + "⟧", over("H112", 500, 501)), case("⟦" + "😀" * 251 + "⟧", over("H112", 500, 502)), case("+ ⟦" + "川" * 501 + "⟧", over("H112", 500, 501)), case("## " + "川" * 501), case(f"[川](http://maps.test/{'q' * 600})")]),
    "h113": ("H113", {}, [
        case("春。" * 8), case("⟦" + "春。" * 9 + "⟧", over("H113", 8, 9)), case("春。" * 4 + "\n\n" + "秋。" * 5), case("⟦" + "春。" * 8 + "端⟧", over("H113", 8, 9)),
        case("⟦__春。__ " + "秋。" * 8 + "⟧", over("H113", 8, 9)), case("「春。夏。」秋。" + "冬。" * 7),
    ]),
}

#: Sentences with their terminal label, leading label, predicates and demonstratives.
SENTENCES: list[tuple[str, str | None, str | None, str, str]] = [
    ("絵を検討します。", "verb:検討する:polite-nonpast", None, "検討します", ""),
    ("字を書きました。", "verb:書く:polite-past", None, "書きました", ""),
    ("それは駅ですよ！", "copula:です:polite-nonpast|particle:よ", None, "", "それ"),
    ("値段が高かった。", "adjective:高い:plain-past", None, "高かった", ""),
    ("絵を見る。", "verb:見る:plain-nonpast", None, "", ""),
    ("しかし、この絵を使います。", "verb:使う:polite-nonpast", "しかし", "使います", "この"),
    ("また、駅である。", None, "また", "である", ""),
    ("あれから決めません。", "verb:あれから決め:polite-negative-nonpast", None, "あれから決めません", ""),
    ("それぞれを話す", "verb:話す:plain-nonpast", "それぞれを話す", "", ""),
    ("字を書いた。", "verb:書く:plain-past", None, "", ""),
]
