"""Markdown structure in plain Python: code ranges and projected paragraphs.

A subset of CommonMark with GFM tables: headings (ATX, setext), thematic breaks, fenced and indented code,
HTML blocks, block quotes and lists with lazy continuation, task items, reference definitions, front matter, footnote
definitions; in paragraphs code spans, emphasis, strikethrough, links, images, autolinks, footnote references, inline HTML,
entities, escapes and hard breaks. A task item's paragraph begins behind its box, and a footnote reference shows nothing. Not covered: tab stops inside containers, nested link edge cases.
All offsets are code points. Containers may nest to any depth: they are worked off a list, not by recursion, and the
levels that all lines of a block quote share are opened at once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from html import unescape

_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_ATX = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
_SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_QUOTE = re.compile(r" {0,3}> ?")
_QUOTES = re.compile(r"(?: {0,3}> ?)+")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|$)")
_HTML = re.compile(r" {0,3}<(?:!--|[?]|![A-Za-z]|!\[CDATA\[|/?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|pre|script|section|source|style|summary|table|tbody|td|textarea|tfoot|th|thead|title|tr|track|ul)(?:[\s/>]|$))", re.I)
_HTML_END = ((re.compile(r" {0,3}<!--"), "-->"), (re.compile(r" {0,3}<[?]"), "?>"), (re.compile(r" {0,3}<!\[CDATA\["), "]]>"), (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), "</"))
_RULE_ROW = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(r" {0,3}\[(?!\^)((?:[^\[\]\\]|\\.){1,999})\]:[ \t]*(?:<[^<>]*>|\S+)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
_TASK = re.compile(r"\[[ \txX]\][ \t]+(?=\S)")
_FOOTNOTE = re.compile(r" {0,3}\[\^[^\]\s]+\]:[ \t]*")

_INLINE_HTML = re.compile(r"<(?:/[A-Za-z][A-Za-z0-9-]*\s*|[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|!--.*?--|[?].*?[?]|![A-Z][^>]*)>", re.S)
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w-]+(?:\.[\w-]+)*)>")
_ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#\d{1,7}|[A-Za-z][A-Za-z0-9]{1,31});")
_DESTINATION = re.compile(r"\(\s*(?:<(?:[^<>\\\n]|\\.)*>|(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)", re.S)
_REFERENCE = re.compile(r"\[\^[^\]\s]+\]")
_MARK = re.compile(r"`+|\\|&|<|!\[|\[|\]|\*+|_+|~~|\n")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass
class Structure:
    code: list[tuple[int, int, bool]] = field(default_factory=list)  # start, end, is a block
    paragraphs: list[tuple[str, int, int]] = field(default_factory=list)  # projection, start, end
    waiting: list[list[tuple[int, str]]] = field(default_factory=list)  # lines whose code spans count, without a paragraph
    open_paragraphs: list[list[tuple[int, str]]] = field(default_factory=list)
    references: set[str] = field(default_factory=set)


Line = tuple[int, str]




def _indent(line: str) -> int:
    n = 0
    for c in line:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def _blank(line: str) -> bool:
    return not line.strip(" \t")


def _break(line: str) -> bool:
    """Whether a line is a thematic break: three or more of one mark, with white space."""
    mark = line.lstrip(" ")[:1]
    return mark in ("*", "-", "_") and mark != "" and _indent(line) < 4 and not line.strip(f"{mark} \t") and line.count(mark) >= 3


def _interrupts(line: str) -> bool:
    """Whether a line may not continue a paragraph."""
    if _FENCE.match(line) or _ATX.match(line) or _break(line) or _QUOTE.match(line) or _HTML.match(line):
        return True
    item = _ITEM.match(line)
    return bool(item and not _blank(line[item.end() :]) and (not item[2][0].isdigit() or item[2][:-1] == "1"))


def _blocks(lines: list[Line], out: Structure) -> None:
    """Every container's lines are a task of their own; the order does not matter, as what they hold is sorted at last."""
    todo = [lines]
    while todo:
        _level(todo.pop(), out, todo)


def _level(lines: list[Line], out: Structure, todo: list[list[Line]]) -> None:
    i, n = 0, len(lines)
    paragraph: list[Line] = []

    def close() -> None:
        while paragraph and (m := _DEFINITION.match(paragraph[0][1])):
            out.references.add(_label(m[1]))
            paragraph.pop(0)
        if paragraph:
            out.open_paragraphs.append(paragraph[:])
        paragraph.clear()

    while i < n:
        at, line = lines[i]
        if _blank(line):
            close()
            i += 1
            continue
        if _indent(line) >= 4 and not paragraph:
            last = j = i
            while j < n and (_blank(lines[j][1]) or _indent(lines[j][1]) >= 4):
                if not _blank(lines[j][1]):
                    last = j
                j += 1
            out.code.append((at, lines[last][0] + len(lines[last][1]), True))
            i = last + 1
            continue
        m = _FENCE.match(line)
        if m:
            close()
            mark, j = m[1], i + 1
            end = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
            while j < n and not end.match(lines[j][1]):
                j += 1
            last = min(j, n - 1)
            out.code.append((at + m.start(1), lines[last][0] + len(lines[last][1]), True))
            i = j + 1
            continue
        if _ATX.match(line):
            close()
            out.waiting.append([(at, line)])
            i += 1
            continue
        if paragraph and _SETEXT.match(line):
            out.waiting.append(paragraph[:])
            paragraph.clear()
            i += 1
            continue
        if _break(line):
            close()
            i += 1
            continue
        if _HTML.match(line):
            close()
            stop = next((e for p, e in _HTML_END if p.match(line)), None)
            while i < n and not (_blank(lines[i][1]) if stop is None else stop in lines[i][1]):
                i += 1
            i += stop is not None
            continue
        if _QUOTE.match(line):
            close()
            inner: list[Line] = []
            shared, j = line[: _QUOTES.match(line).end()].count(">"), i + 1
            while j < n and ((q := _QUOTES.match(lines[j][1])) or (not _blank(lines[j][1]) and not _interrupts(lines[j][1]))):
                shared = min(shared, q[0].count(">")) if q else shared  # the levels that all lines of the quote have
                j += 1
            lazy = False
            while i < n:
                a, x = lines[i]
                if q := _QUOTE.match(x):
                    end, more = q.end(), 1
                    while more < shared:
                        end, more = _QUOTE.match(x, end).end(), more + 1
                    rest = x[end:]
                    inner.append((a + end, rest))
                    lazy = not _blank(rest) and not (_FENCE.match(rest) or _ATX.match(rest) or _break(rest) or _indent(rest) >= 4 and not lazy)
                elif lazy and not _blank(x) and not _interrupts(x):
                    inner.append((a + len(x) - len(x.lstrip(" \t")), x.lstrip(" \t")))
                else:
                    break
                i += 1
            todo.append(inner)
            continue
        item = _ITEM.match(line)
        if item and (not paragraph or _interrupts(line)):
            close()
            pad = len(item[3]) if 1 <= len(item[3]) <= 4 and not _blank(line[item.end() :]) else 1
            width = len(item[1]) + len(item[2]) + pad
            box = _TASK.match(line, width)
            start = box.end() if box else min(width, len(line))
            inner = [(at + start, line[start:])]
            lazy, gap = not _blank(line[width:]), False
            i += 1
            while i < n:
                a, x = lines[i]
                if _blank(x):
                    inner.append((a + len(x), ""))
                    gap = True
                elif _indent(x) >= width:
                    cut = min(width, len(x) - len(x.lstrip(" \t")))
                    inner.append((a + cut, x[cut:]))
                    gap = False
                elif lazy and not gap and not _interrupts(x) and not _ITEM.match(x):
                    cut = len(x) - len(x.lstrip(" \t"))
                    inner.append((a + cut, x[cut:]))
                else:
                    break
                i += 1
            while inner and _blank(inner[-1][1]):
                inner.pop()
            todo.append(inner)
            continue
        if not paragraph and "|" in line and i + 1 < n and "-" in lines[i + 1][1] and "|" in lines[i + 1][1] + line and _RULE_ROW.match(lines[i + 1][1]):
            j = i
            while j < n and not _blank(lines[j][1]) and (j < i + 2 or not _interrupts(lines[j][1])):
                out.waiting.append([lines[j]])
                j += 1
            i = j
            continue
        foot = _FOOTNOTE.match(line) if not paragraph else None
        if foot:
            at, line = at + foot.end(), line[foot.end() :]
        cut = len(line) - len(line.lstrip(" \t"))
        paragraph.append((at + cut, line[cut:]))
        i += 1
    close()


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


class _Text:
    """The lines of a paragraph joined, with offsets back into the source."""

    def __init__(self, lines: list[Line]):
        self.text = "\n".join(x for _, x in lines)
        self.starts, self.offsets, at = [], [], 0
        for offset, x in lines:
            self.starts.append(at)
            self.offsets.append(offset)
            at += len(x) + 1

    def source(self, i: int) -> int:
        k = bisect_right(self.starts, i) - 1
        return self.offsets[k] + i - self.starts[k]


def _inline(lines: list[Line], references: set[str]) -> tuple[str, list[tuple[int, int, bool]]]:
    """(visible text, code spans in source offsets)."""
    t = _Text(lines)
    text, n = t.text, len(t.text)
    out: list[str] = []
    spans: list[tuple[int, int, bool]] = []
    brackets: list[tuple[int, int]] = []  # position in out, and in the text after the bracket
    runs: list[list] = []  # emphasis: index in out, mark, length, opens, closes
    ticks: dict[int, list[int]] = {}
    for m in re.finditer(r"`+", text):
        ticks.setdefault(len(m[0]), []).append(m.start())
    at = 0
    for m in iter(lambda: _MARK.search(text, at), None):
        out.append(text[at : m.start()])
        mark, i = m[0], m.start()
        at = m.end()
        if mark[0] == "`":
            later = ticks[len(mark)]
            k = bisect_right(later, i)
            if k < len(later):
                inner = text[at : later[k]].replace("\n", " ")
                if inner[:1] == inner[-1:] == " " and inner.strip(" "):
                    inner = inner[1:-1]
                out.append(inner)
                at = later[k] + len(mark)
                spans.append((t.source(i), t.source(at - 1) + 1, False))
            else:
                out.append(mark)
        elif mark == "\\":
            if text[at : at + 1] == "\n":
                at += 1
            elif at < n and text[at] in _PUNCTUATION:
                out.append(text[at])
                at += 1
            else:
                out.append("\\")
        elif mark == "&":
            e = _ENTITY.match(text, i)
            out.append(unescape(e[0]) if e else "&")
            at = e.end() if e else at
        elif mark == "<":
            link, tag = _AUTOLINK.match(text, i), _INLINE_HTML.match(text, i)
            if link or tag:
                out.append(link[1] if link else "")
                at = (link or tag).end()
            else:
                out.append("<")
        elif mark == "[" and (note := _REFERENCE.match(text, i)):
            at = note.end()
        elif mark in ("[", "!["):
            brackets.append((len(out), at))
            out.append(mark)
        elif mark == "]":
            if not brackets:
                out.append("]")
                continue
            slot, inside = brackets.pop()
            target = _DESTINATION.match(text, at)
            ref = re.compile(r"\[([^\[\]]*)\]").match(text, at)
            if target is None and _label(ref[1] if ref and ref[1] else text[inside : at - 1]) in references:
                target = ref or re.compile("").match(text, at)
            if target:
                out[slot] = ""
                at = target.end()
            else:
                out.append("]")
        elif mark == "\n":
            held = out[-1] if out else ""
            if held.endswith("  "):
                out[-1] = held.rstrip(" ")
            else:
                if out:
                    out[-1] = held.rstrip(" ")
                out.append("\n")
        else:
            before, after = text[i - 1 : i] or " ", text[at : at + 1] or " "
            left = not after.isspace() and (not _is_mark(after) or before.isspace() or _is_mark(before))
            right = not before.isspace() and (not _is_mark(before) or after.isspace() or _is_mark(after))
            if mark[0] == "_":
                opens, closes = left and (not right or _is_mark(before)), right and (not left or _is_mark(after))
            else:
                opens, closes = left, right
            runs.append([len(out), mark[0], len(mark), opens, closes])
            out.append(mark)
    out.append(text[at:])
    _emphasis(runs)
    for slot, mark, left, *_ in runs:
        out[slot] = mark * left
    return "".join(out).rstrip(" \t"), spans


def _is_mark(c: str) -> bool:
    return c in _PUNCTUATION or (not c.isalnum() and not c.isspace() and not c.isidentifier())


def _emphasis(runs: list[list]) -> None:
    """Takes the matched delimiters from the runs' lengths."""
    waiting: dict[str, list[int]] = {"*": [], "_": [], "~": []}
    for k, run in enumerate(runs):
        _, mark, _, opens, closes = run
        stack = waiting[mark]
        while closes and run[2] and stack:
            opener = runs[stack[-1]]
            both = (opens or opener[4]) and (opener[2] + run[2]) % 3 == 0 and (opener[2] % 3 or run[2] % 3)
            if mark != "~" and both:
                break
            take = 2 if min(opener[2], run[2]) >= 2 else 1
            opener[2] -= take
            run[2] -= take
            # what lies between can no longer match across this pair
            for other in waiting.values():
                while other and other[-1] > stack[-1]:
                    other.pop()
            if not opener[2]:
                stack.pop()
        if opens and run[2]:
            stack.append(k)


def may_hold_code(text: str) -> bool:
    """Whether a text has any of what code needs: a fence, a code span's mark or an indent."""
    return "`" in text or "~~~" in text or "    " in text or "\t" in text


def parse(text: str, visible: bool = True) -> Structure:
    """Code ranges sorted by start, and the paragraphs in source order; if not visible, without their projected texts."""
    out = Structure()
    lines, at = [], 0
    for raw in re.split(r"(?<=\n)", text):
        body = raw.rstrip("\n").rstrip("\r")
        if raw:
            lines.append((at, body))
        at += len(raw)
    if lines and lines[0][1] == "---":
        close = next((k for k in range(1, len(lines)) if lines[k][1] in ("---", "...")), None)
        if close is not None:
            lines = lines[close + 1 :]
    _blocks(lines, out)
    for group in out.waiting:
        if any("`" in x for _, x in group):
            out.code += _inline(group, out.references)[1]
    for group in out.open_paragraphs:
        last, body = group[-1]
        group[-1] = (last, body.rstrip(" \t"))
        shown, spans = _inline(group, out.references) if visible or any("`" in x for _, x in group) else ("", [])
        out.code += spans
        out.paragraphs.append((shown, group[0][0], last + len(group[-1][1])))
    out.code.sort()
    out.paragraphs.sort(key=lambda p: p[1])
    return out
