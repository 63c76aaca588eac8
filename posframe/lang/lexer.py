"""Text to tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..model import EngineError


@dataclass(frozen=True)
class Token:
    kind: str  # num, str, sym, name, verb, adverb, open, close, end
    value: object
    spaced: bool  # white space before it


NULL_INT, INF_INT = -(2**31), 2**31 - 1
NUMBER = re.compile(r"0N|0W|0n|0w|[01]+b|[0-9]+\.[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|[0-9]+(?:e[+-]?[0-9]+)?")
NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]*(?:\.[A-Za-z][A-Za-z0-9_]*)*")
SYMBOL = re.compile(r"`(?:\"((?:[^\"\\]|\\.)*)\"|([A-Za-z0-9_.]*))")
STRING = re.compile(r'"((?:[^"\\]|\\.)*)"')
ADVERBS = ("':", "/:", "\\:", "'", "/", "\\")
VERBS = "+-*%&|<>=~!,^#_$?@.:"
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


def _unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), s)


def number(text: str):
    """A literal's value: a list of bools for 0101b."""
    if text.endswith("b"):
        bits = [c == "1" for c in text[:-1]]
        return bits[0] if len(bits) == 1 else bits
    special = {"0N": NULL_INT, "0W": INF_INT, "0n": float("nan"), "0w": float("inf")}
    if text in special:
        return special[text]
    return float(text) if re.search(r"[.e]", text) else int(text)


def tokens(source: str) -> list[Token]:
    out: list[Token] = []
    i, n = 0, len(source)
    while i < n:
        start = i
        while i < n and source[i] in " \t":
            i += 1
        spaced = i > start or i == 0
        if i == n:
            break
        c = source[i]
        if c == "/" and (spaced or source[i - 1] == "\n"):
            while i < n and source[i] != "\n":
                i += 1
            continue
        if c in "\n;":
            out.append(Token("end", c, spaced))
            i += 1
            continue
        after_noun = bool(out) and (out[-1].kind in ("num", "str", "sym", "name") or out[-1].kind == "close")
        negative = c == "-" and i + 1 < n and (source[i + 1].isdigit() or source[i + 1] == ".") and (not after_noun or (spaced and out[-1].kind == "num"))
        if m := NUMBER.match(source, i + negative):
            value = number(m[0])
            out.append(Token("num", -value if negative else value, spaced))
            i = m.end()
        elif m := SYMBOL.match(source, i):
            out.append(Token("sym", _unescape(m[1]) if m[1] is not None else m[2], spaced))
            i = m.end()
        elif m := STRING.match(source, i):
            out.append(Token("str", _unescape(m[1]), spaced))
            i = m.end()
        elif m := NAME.match(source, i):
            out.append(Token("name", m[0], spaced))
            i = m.end()
        elif c in "([{":
            out.append(Token("open", c, spaced))
            i += 1
        elif c in ")]}":
            out.append(Token("close", c, spaced))
            i += 1
        elif a := next((a for a in ADVERBS if source.startswith(a, i)), None):
            out.append(Token("adverb", a, spaced))
            i += len(a)
        elif c in VERBS:
            double = source.startswith("::", i)
            out.append(Token("verb", "::" if double else c, spaced))
            i += 2 if double else 1
        else:
            raise EngineError("domain", f"character {c!r} at {i}")
    return out
