"""Driver-side values and verbs on them: the model that small expressions run on, and that tests hold tables against."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from ..model import EngineError

NULL_INT = -(2**31)


class Sym(str):
    """A symbol."""

    def __repr__(self) -> str:
        return f"`{str(self)}"


@dataclass(frozen=True)
class Err:
    """An error as a value."""

    kind: str


@dataclass
class Dict:
    """Ordered keys and values."""

    keys: list
    values: list

    def __eq__(self, other) -> bool:
        return isinstance(other, Dict) and match(self.keys, other.keys) and match(self.values, other.values)

    def get(self, key):
        for k, v in zip(self.keys, self.values):
            if match(k, key):
                return v
        return null_like(self.values)


@dataclass(eq=False)
class Fn:
    """A function: a Python callable, how many arguments it takes, and its name."""

    call: Callable
    arity: int
    name: str = "fn"
    mark: dict = field(default_factory=dict)


def is_list(x) -> bool:
    return isinstance(x, (list, str)) and not isinstance(x, Sym)


def items(x) -> list:
    if isinstance(x, Dict):
        return list(x.values)
    return list(x) if is_list(x) else [x]


def joined(values: list):
    """Characters make a string again."""
    return "".join(values) if values and all(isinstance(v, str) and not isinstance(v, Sym) and len(v) == 1 for v in values) else values


def as_was(x, values: list):
    """Items of x as a value of its kind: no characters are still a string."""
    return "".join(values) if isinstance(x, str) else values


def null_like(values):
    sample = next(iter(values), 0)
    if isinstance(sample, bool):
        return False
    if isinstance(sample, int):
        return NULL_INT
    if isinstance(sample, float):
        return math.nan
    if isinstance(sample, Sym):
        return Sym("")
    return " " if isinstance(sample, str) else []


def wrap(n: int) -> int:
    return (n + 2**31) % 2**32 - 2**31


def number(x):
    if isinstance(x, str):
        if isinstance(x, Sym) or len(x) != 1:
            raise EngineError("type")
        return ord(x)
    return x


def pervade2(f: Callable, x, y):
    """A scalar function over atoms, lists, dicts and what nests of them."""
    if isinstance(x, str) and isinstance(y, str) and len(x) == len(y) == 1:
        return f(x, y)
    if isinstance(x, Dict) and isinstance(y, Dict):
        if not match(x.keys, y.keys):
            raise EngineError("length")
        return Dict(x.keys, [pervade2(f, a, b) for a, b in zip(x.values, y.values)])
    if isinstance(x, Dict):
        return Dict(x.keys, [pervade2(f, a, y) for a in x.values])
    if isinstance(y, Dict):
        return Dict(y.keys, [pervade2(f, x, b) for b in y.values])
    if is_list(x) and is_list(y):
        if len(x) != len(y):
            raise EngineError("length")
        return [pervade2(f, a, b) for a, b in zip(x, y)]
    if is_list(x) and not (isinstance(x, str) and len(x) == 1 and not is_list(y)):
        return [pervade2(f, a, y) for a in x]
    if is_list(y) and not (isinstance(y, str) and len(y) == 1):
        return [pervade2(f, x, b) for b in y]
    return f(x, y)


def pervade1(f: Callable, x):
    if isinstance(x, Dict):
        return Dict(x.keys, [pervade1(f, v) for v in x.values])
    return [pervade1(f, v) for v in x] if isinstance(x, list) else f(x)


def arith(op: Callable) -> Callable:
    def f(a, b):
        a, b = number(a), number(b)
        out = op(a, b)
        return out if isinstance(out, float) else wrap(int(out))

    return lambda x, y: pervade2(f, x, y)


def divide(a, b):
    a, b = float(number(a)), float(number(b))
    if b == 0:
        return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a)
    return a / b


def order_key(v):
    """The total order: nulls lowest, lists by items, shorter first."""
    if isinstance(v, (list, Dict)):
        return (2, [order_key(i) for i in items(v)])
    if isinstance(v, float) and math.isnan(v):
        return (0, -math.inf)
    return (1, v) if isinstance(v, str) else (0, v)


def compare(op: Callable) -> Callable:
    def f(a, b):
        if isinstance(a, str) != isinstance(b, str) and not (isinstance(a, Sym) or isinstance(b, Sym)):
            a, b = number(a), number(b)
        return bool(op(a, b))

    return lambda x, y: pervade2(f, x, y)


def equal(x, y):
    """`=`, with a symbol or string atom as one value."""
    if isinstance(x, Sym) or isinstance(y, Sym):
        whole = lambda a, b: isinstance(a, Sym) and isinstance(b, Sym) and str(a) == str(b)
        if isinstance(x, Sym) and isinstance(y, Sym):
            return whole(x, y)
        return [equal(a, y) for a in x] if isinstance(x, list) and not isinstance(y, list) else [equal(x, b) for b in y] if isinstance(y, list) and not isinstance(x, list) else [whole(a, b) for a, b in zip(x, y)] if isinstance(x, list) and isinstance(y, list) else False
    return compare(lambda a, b: a == b)(x, y)


def match(x, y) -> bool:
    if isinstance(x, Dict) or isinstance(y, Dict):
        return isinstance(x, Dict) and isinstance(y, Dict) and match(x.keys, y.keys) and match(x.values, y.values)
    if is_list(x) != is_list(y):
        return False
    if isinstance(x, list) or isinstance(y, list):
        return len(x) == len(y) and all(match(a, b) for a, b in zip(x, y))
    return type(x) is type(y) and x == y


def grade(x, desc: bool = False) -> list:
    keys = [order_key(v) for v in items(x)]
    up = sorted(range(len(keys)), key=functools.cmp_to_key(lambda a, b: (keys[a] > keys[b]) - (keys[a] < keys[b])))
    return up if not desc else sorted(range(len(keys)), key=functools.cmp_to_key(lambda a, b: (keys[a] < keys[b]) - (keys[a] > keys[b])))


def distinct(x):
    out: list = []
    for v in items(x):
        if not any(match(v, o) for o in out):
            out.append(v)
    return joined(out)


def group(x):
    if isinstance(x, Dict):
        found = group(x.values)
        return Dict(found.keys, [joined([x.keys[i] for i in at]) for at in found.values])
    keys = items(distinct(x))
    keys = [keys[i] for i in grade(keys)]
    return Dict(keys, [[i for i, v in enumerate(items(x)) if match(v, k)] for k in keys])


def where(x):
    if isinstance(x, Dict):
        return joined([k for k, n in zip(x.keys, x.values) for _ in range(n)])
    if any(n < 0 for n in items(x)):
        raise EngineError("domain")
    return [i for i, n in enumerate(items(x)) for _ in range(int(n))]


def find(x, y):
    """The first place of y in x, or of each of its items; the length of x where there is none."""
    hay = items(x)

    def one(value):
        return next((i for i, h in enumerate(hay) if match(h, value)), len(hay))

    if not is_list(y):
        return one(y)
    rows = isinstance(x, list) and bool(x) and is_list(x[0])
    if rows and not (y and is_list(y[0]) and isinstance(y, list)):  # y is one row of a list of rows
        return one(y)
    if isinstance(x, list) and isinstance(y, str) and len(y) == 1:
        return one(y)
    return [one(value) for value in items(y)]


def member(x, y):
    return [any(match(v, h) for h in items(y)) for v in items(x)] if is_list(x) and not (isinstance(y, list) and y and is_list(y[0])) else any(match(x, h) for h in items(y))


def index(x, i):
    if isinstance(x, Dict):
        return [x.get(k) for k in i] if isinstance(i, list) else x.get(i)
    if isinstance(i, Dict):
        return Dict(i.keys, [index(x, v) for v in i.values])
    if isinstance(i, list):
        if i and all(isinstance(b, bool) for b in i):
            return joined([v for v, b in zip(x, i) if b])
        return joined([index(x, k) for k in i])
    if not is_list(x):
        raise EngineError("rank")
    if not isinstance(i, int) or not 0 <= i < len(x):
        raise EngineError("index", str(i))
    return x[i]


def take(n, x):
    if isinstance(n, list):
        if n and isinstance(n[0], Sym) and isinstance(x, Dict):
            return Dict(n, [x.get(k) for k in n])
        return reshape(n, x)
    if isinstance(x, Dict):
        return Dict(items(take(n, x.keys)), items(take(n, x.values)))
    v = items(x)
    if not v:
        return joined([])
    return joined([v[i % len(v)] for i in (range(n) if n >= 0 else range(n, 0))])


def reshape(shape: list, x):
    v, total = items(x), 1
    known = [s for s in shape if s != NULL_INT]
    for s in known:
        total *= s
    if len(known) < len(shape):
        shape = [s if s != NULL_INT else len(v) // max(total, 1) for s in shape]
    flat = iter(range(10**9))

    def build(rest):
        if len(rest) == 1:
            return joined([v[next(flat) % len(v)] for _ in range(rest[0])])
        return [build(rest[1:]) for _ in range(rest[0])]

    return build(list(shape))


def drop(n, x):
    if isinstance(x, Dict):
        if isinstance(n, list):
            keep = [i for i, k in enumerate(x.keys) if not member(k, n)]
            return Dict([x.keys[i] for i in keep], [x.values[i] for i in keep])
        return Dict(items(drop(n, x.keys)), items(drop(n, x.values)))
    v = items(x)
    if isinstance(n, list):
        if n and all(isinstance(b, bool) for b in n):
            return joined([a for a, b in zip(v, n) if not b])
        ends = [min(s, len(v)) for s in n[1:]] + [len(v)]
        return [as_was(x, v[min(s, len(v)) : e]) for s, e in zip(n, ends)]
    return as_was(x, v[n:] if n >= 0 else v[:n])


def concat(x, y):
    if isinstance(x, Dict) and isinstance(y, Dict):
        out = Dict(list(x.keys), list(x.values))
        for k, v in zip(y.keys, y.values):
            at = find(out.keys, k) if out.keys else 0
            if at < len(out.keys):
                out.values[at] = v
            else:
                out.keys.append(k)
                out.values.append(v)
        return out
    return joined([*items(x), *items(y)])


def without(x, y):
    return joined([v for v in items(y) if not any(match(v, g) for g in items(x))])


def is_null(v) -> bool:
    return v == NULL_INT and not isinstance(v, bool) if isinstance(v, int) else math.isnan(v) if isinstance(v, float) else v in ("", " ") if isinstance(v, str) else v is None


def fill(x, y):
    if isinstance(x, list):
        return without(x, y)
    if isinstance(y, Dict):
        return Dict(y.keys, [fill(x, v) for v in y.values])
    return joined([x if is_null(v) else v for v in items(y)]) if is_list(y) else x if is_null(y) else y


def flip(x):
    if isinstance(x, Dict):
        return x
    n = max((len(r) for r in x if is_list(r)), default=1)
    if any(is_list(r) and len(r) != n for r in x):
        raise EngineError("length")
    return [joined([r[i] if is_list(r) else r for r in x]) for i in range(n)]


def iota(x):
    if isinstance(x, Dict):
        return x.keys
    if isinstance(x, list):
        total = math.prod(x)
        return [[i // math.prod(x[k + 1 :]) % x[k] for i in range(total)] for k in range(len(x))]
    if isinstance(x, Sym):
        raise EngineError(str(x))
    return list(range(x))


def pair(x, y):
    if not is_list(x):
        return Dict([x], [y])
    keys = items(x)
    values = items(y) if is_list(y) else [y] * len(keys)
    if len(keys) != len(values):
        raise EngineError("length")
    return Dict(keys, values)


def pad(n: int, s: str) -> str:
    return s[:n].ljust(n) if n >= 0 else s[n:].rjust(-n) if len(s) < -n else s[n:]


def text(v) -> str:
    if isinstance(v, bool):
        return "1b" if v else "0b"
    if isinstance(v, float):
        return "0n" if math.isnan(v) else ("-0w" if v < 0 else "0w") if math.isinf(v) else f"{v:.7g}".removesuffix(".0")
    return "0N" if v == NULL_INT else str(v)


def type_of(v) -> Sym:
    if isinstance(v, Dict):
        return Sym("m")
    if isinstance(v, list):
        kinds = {type_of(i) for i in v}
        return Sym(kinds.pop().upper()) if len(kinds) == 1 and len(next(iter(kinds), "")) == 1 and not any(is_list(i) or isinstance(i, Dict) for i in v) else Sym("L")
    if isinstance(v, Err):
        return Sym("!")
    if isinstance(v, Fn):
        return Sym("o")
    if isinstance(v, Sym):
        return Sym("s")
    if isinstance(v, str):
        return Sym("C") if len(v) != 1 else Sym("c")
    return Sym("b" if isinstance(v, bool) else "i" if isinstance(v, int) else "f" if isinstance(v, float) else "")


def shape(x) -> list:
    if not is_list(x):
        return []
    inner = [shape(v) for v in x] if isinstance(x, list) else []
    return [len(x), *(inner[0] if inner and all(i == inner[0] for i in inner) else [])]


def encode(radix, n: int) -> list:
    if isinstance(radix, list):
        out = []
        for r in reversed(radix):
            out.append(n % r)
            n //= r
        return out[::-1]
    n, out = abs(n), []
    while n:
        out.append(n % radix)
        n //= radix
    return out[::-1] or [0]


def decode(radix, digits: list) -> int:
    radices = radix if isinstance(radix, list) else [radix] * len(digits)
    total = 0
    for r, d in zip(radices, digits):
        total = total * r + d % r
    return total


def variance(v: list) -> float:
    m = sum(v) / len(v)
    return sum((a - m) ** 2 for a in v) / (len(v) - 1)


def median(v: list) -> float:
    s = sorted(v)
    return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
