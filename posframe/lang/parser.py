"""Tokens to a tree. Evaluation is from right to left, without precedence; a verb is dyadic where a noun stands before it.

Nodes are tuples: ("lit", value), ("name", n), ("verb", v), ("adverb", f, a), ("apply", f, args), ("list", items),
("dict", [(name, node)]), ("table", keys, columns), ("lambda", params, body), ("assign", name, op, node), ("cond", parts),
("train", f, g) for verbs that follow one another without an argument.
"""

from __future__ import annotations

from ..model import EngineError
from .lexer import Token, tokens
from .values import Sym

NAMED_DYADS = {"in", "has", "mod", "div"}
NAMED_MONADS = {"sqrt", "exp", "log", "sin", "cos", "abs", "sqr", "avg", "var", "std", "med", "sort"}


class Parser:
    def __init__(self, source: str):
        self.tokens, self.i = tokens(source), 0

    def peek(self, ahead: int = 0) -> Token | None:
        return self.tokens[self.i + ahead] if self.i + ahead < len(self.tokens) else None

    def next(self) -> Token:
        t = self.peek()
        if t is None:
            raise EngineError("rank", "unexpected end")
        self.i += 1
        return t

    def at(self, kind: str, value: object = None) -> bool:
        t = self.peek()
        return t is not None and t.kind == kind and (value is None or t.value == value)

    def program(self) -> list:
        out = []
        while self.peek() is not None:
            if self.at("end"):
                self.next()
            else:
                out.append(self.expression())
                if self.peek() is not None and not self.at("end"):
                    raise EngineError("domain", f"unexpected {self.peek().value!r}")
        return out

    def block(self, close: str) -> list:
        """Expressions between separators up to the closing bracket; None for an empty place."""
        out, waiting = [], True
        while not self.at("close"):
            if self.at("end"):
                if waiting:
                    out.append(None)
                waiting = True
                self.next()
            else:
                out.append(self.expression())
                waiting = False
        if waiting and out:
            out.append(None)
        if self.next().value != close:
            raise EngineError("domain", f"expected {close}")
        return out

    def expression(self):
        """A term, and what stands right of it."""
        if self.stops():
            return ("lit", None)
        noun, verbal = self.term()
        if self.stops():
            return noun
        if verbal:
            return self.applied(noun)
        if (t := self.peek()).kind == "verb" and t.value in (":", "::") and noun[0] in ("name", "apply"):
            self.next()
            return ("assign", noun, None, self.expression())
        right, right_verbal = self.term()
        if not right_verbal:  # juxtaposition: apply or index
            return ("apply", noun, [self.continued(right)])
        if self.at("verb", ":") and right[0] == "verb" and noun[0] in ("name", "apply"):
            self.next()
            return ("assign", noun, right, self.expression())
        if self.stops():
            return ("partial", right, [noun])
        return ("apply", right, [noun, self.expression()])

    def continued(self, noun):
        """The rest of an expression whose first term is known to be a noun."""
        if self.stops():
            return noun
        right, verbal = self.term()
        if not verbal:
            return ("apply", noun, [self.continued(right)])
        if self.stops():
            return ("partial", right, [noun])
        return ("apply", right, [noun, self.expression()])

    def applied(self, f):
        """A verb with no noun before it: monadic, or the head of a train."""
        arg = self.expression()
        return ("train", f, arg) if arg[0] in ("verb", "adverb", "train") else ("apply", f, [arg])

    def stops(self) -> bool:
        return self.peek() is None or self.at("end") or self.at("close")

    def term(self):
        """(node, whether it acts as a verb)."""
        node, verbal = self.atom()
        while (t := self.peek()) is not None:
            if t.kind == "open" and t.value == "[" and not (t.spaced and node[0] == "lit"):
                self.next()
                args = self.block("]")
                if node == ("verb", "$") and len(args) >= 3:
                    node, verbal = ("cond", args), False
                else:
                    node, verbal = ("apply", node, args), False
            elif t.kind == "adverb" and not (t.spaced and t.value in ("/", "\\")):
                self.next()
                node, verbal = ("adverb", node, t.value), True
            else:
                break
        return node, verbal

    def atom(self):
        t = self.next()
        if t.kind == "num":
            return self.vector(t, "num", lambda x: x)
        if t.kind == "sym":
            return self.vector(t, "sym", Sym)
        if t.kind == "str":
            return ("lit", t.value), False
        if t.kind == "name":
            if t.value in NAMED_DYADS or t.value in NAMED_MONADS:
                return ("verb", t.value), True
            if "." in t.value:  # t.c is column c of t
                head, *rest = t.value.split(".")
                node = ("name", head)
                for r in rest:
                    node = ("apply", node, [("lit", Sym(r))])
                return node, False
            return ("name", t.value), False
        if t.kind == "verb":
            if t.value == "::":
                return ("lit", None), False
            return ("verb", t.value), True
        if t.kind == "open" and t.value == "(":
            return self.parenthesis(), False
        if t.kind == "open" and t.value == "{":
            return self.function(), False
        raise EngineError("domain", f"unexpected {t.value!r}")

    def vector(self, first: Token, kind: str, make):
        """Neighbouring literals are one vector; symbols also without space."""
        values = [make(first.value)]
        while (t := self.peek()) is not None and t.kind == kind and (t.spaced or kind == "sym") and not isinstance(t.value, list):
            if kind == "sym" and t.spaced:
                break
            values.append(make(self.next().value))
        if len(values) == 1:
            return ("lit", values[0]), False
        if any(isinstance(v, float) for v in values):
            values = [float(v) for v in values]
        return ("lit", values), False

    def parenthesis(self):
        if self.at("open", "["):  # table: ([keys] columns)
            self.next()
            keys = self.named("]")
            return ("table", keys, self.named(")"))
        start = self.i
        if self.at("name") and (n := self.peek(1)) is not None and n.kind == "verb" and n.value == ":" and (m := self.peek(2)) is not None and m.kind != "end":
            try:
                return ("dict", self.named(")"))
            except EngineError:
                self.i = start
        items = self.block(")")
        if len(items) == 1:
            # a parenthesised verb is a noun: it waits for its arguments
            return items[0]
        return ("list", items)

    def named(self, close: str) -> list:
        out = []
        while not self.at("close"):
            if self.at("end"):
                self.next()
                continue
            name = self.next()
            if name.kind != "name" or not self.at("verb", ":"):
                raise EngineError("domain", "expected name: value")
            self.next()
            out.append((name.value, self.expression()))
        if self.next().value != close:
            raise EngineError("domain", f"expected {close}")
        return out

    def function(self):
        params = None
        if self.at("open", "["):
            self.next()
            params = []
            while not self.at("close"):
                t = self.next()
                if t.kind == "name":
                    params.append(t.value)
            self.next()
        body = [e for e in self.block("}") if e is not None]
        if params is None:
            used = names_in(body)
            params = ["x", "y", "z"][: max([i + 1 for i, n in enumerate("xyz") if n in used], default=1)]
        if len(params) > 16:
            raise EngineError("rank", "more than 16 parameters")
        return ("lambda", params, body)


def names_in(node) -> set[str]:
    if isinstance(node, tuple) and node and node[0] == "name":
        return {node[1]}
    if isinstance(node, tuple) and node and node[0] in ("lit", "lambda"):
        return set()
    if isinstance(node, (tuple, list)):
        return set().union(*map(names_in, node)) if node else set()
    return set()


def parse(source: str) -> list:
    return Parser(source).program()
