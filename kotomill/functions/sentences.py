"""Sentence splitting in plain Python: terminators 。．！？!? end a sentence, outside pair marks.

A full stop ``.`` ends one too if white space or the text's end follows. Runs of terminators stay
together. An opening mark only protects its content if its closing mark follows in the same paragraph.
These choices are this library's where the contract leaves them open.
"""

from __future__ import annotations

import re

# What ends a sentence and what protects it.
PAIR = {"「": "」", "『": "』", "（": "）", "(": ")", "【": "】", "[": "]", "“": "”", "‘": "’"}
_STOP = re.compile(r"[。．！？!?]+|\.+(?=\s|\Z)")
_OPENER = re.compile(r"[「『（(【\[“‘]")
_MARKS = re.compile(r"[「『（(【\[“‘」』）)】\]”’]|\n[^\S\n]*\n")
_CLOSERS = frozenset(PAIR.values())
#: ECMAScript white space.
SPACE = "\t\n\v\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def _protected(text: str) -> list[tuple[int, int]]:
    """Outermost balanced spans (start, end) of pair marks, in order; a blank line ends all open ones."""
    stack: list[tuple[str, int]] = []
    where: dict[str, list[int]] = {c: [] for c in _CLOSERS}  # the places in the stack of each closing mark's openers
    spans: list[tuple[int, int]] = []
    for m in _MARKS.finditer(text):
        c = m[0]
        if c in PAIR:
            where[PAIR[c]].append(len(stack))
            stack.append((PAIR[c], m.start()))
        elif c in _CLOSERS:
            if where[c]:
                at = where[c][-1]
                start = stack[at][1]
                while len(stack) > at:
                    where[stack.pop()[0]].pop()
                while spans and spans[-1][0] > start:
                    spans.pop()
                spans.append((start, m.end()))
        else:
            while stack:
                where[stack.pop()[0]].pop()
    return spans


def split(text: str) -> list[tuple[int, int]]:
    """(start, end) of the trimmed sentences in code points."""
    spans = _protected(text) if _OPENER.search(text) else []
    out, at, k = [], 0, 0

    def add(end: int) -> None:
        part = text[at:end]
        body = part.lstrip(SPACE)
        if body := body.rstrip(SPACE) if (left := len(part) - len(body)) < len(part) else "":
            out.append((at + left, at + left + len(body)))

    for m in _STOP.finditer(text):
        start = m.start()
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        if k < len(spans) and spans[k][0] <= start:
            continue
        add(m.end())
        at = m.end()
    add(len(text))
    return out
