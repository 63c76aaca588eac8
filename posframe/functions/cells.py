"""Array, map and JSON cells as column expressions: vectors that live inside a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EngineError

C = Column


def pair(keys: C, values: C) -> C:
    """A1: a map from lists of keys and values."""
    return F.map_from_arrays(keys, values)


def each(x: C, f: Callable[[C], C]) -> C:
    """H1: f over the items."""
    return F.transform(x, f)


def each_value(d: C, f: Callable[[C], C]) -> C:
    """H1 on a map: f over the values."""
    return F.transform_values(d, lambda _, v: f(v))


def zip_(x: C, y: C, f: Callable[[C, C], C]) -> C:
    """H2: f over pairs; unequal lengths are a length error when the plan runs."""
    return F.when(F.size(x) == F.size(y), F.zip_with(x, y, f)).otherwise(F.raise_error(F.lit("!length")))


def each_right(x: C, y: C, f: Callable[[C, C], C]) -> C:
    """H3: x as it is, with each item of y."""
    return F.transform(y, lambda b: f(x, b))


def each_left(x: C, y: C, f: Callable[[C, C], C]) -> C:
    """H3: each item of x, with y as it is."""
    return F.transform(x, lambda a: f(a, y))


def where(mask: C) -> C:
    """The places of the true items."""
    return F.filter(F.transform(mask, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())


def pick(x: C, indices: C) -> C:
    """P5: items at the indices; out of range is an index error when the plan runs."""
    return F.transform(indices, lambda i: F.when((i >= 0) & (i < F.size(x)), F.get(x, i)).otherwise(F.raise_error(F.lit("!index"))))


def find(x: C, value: C) -> C:
    """The first place of the value; the length where it has none."""
    at = F.array_position(x, value)
    return F.when(at == 0, F.size(x).cast("long")).otherwise(at - 1)


def grade(x: C, desc: bool = False) -> C:
    """O1: the places in sorted order, stable in both directions."""
    tagged = F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    if desc:
        compare = lambda a, b: F.when(a["v"] > b["v"], -1).when(a["v"] < b["v"], 1).when(a["i"] < b["i"], -1).otherwise(1)
        tagged = F.array_sort(tagged, compare)
    else:
        tagged = F.array_sort(tagged)
    return F.transform(tagged, lambda s: s["i"])


def take(x: C, n: int) -> C:
    """The first n items, the last -n; over and over where there are fewer."""
    size = F.size(x)
    if n >= 0:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(x, F.pmod(i, size))) if n else F.slice(x, 1, 0)
    return F.transform(F.sequence(F.lit(n), F.lit(-1)), lambda i: F.get(x, F.pmod(i, size)))


def drop(x: C, n: int) -> C:
    """Without the first n items, or the last -n."""
    size = F.size(x)
    return F.slice(x, n + 1, F.greatest(size - n, F.lit(0))) if n >= 0 else F.slice(x, 1, F.greatest(size + n, F.lit(0)))


def cut(x: C, starts: list[int]) -> C:
    """Segments that begin at the starts, clamped to the length; what lies before the first goes."""
    size = F.size(x)
    ends = [F.lit(s) for s in starts[1:]] + [size]
    return F.array(*[F.slice(x, F.least(F.lit(s), size) + 1, F.greatest(F.least(e, size) - F.least(F.lit(s), size), F.lit(0))) for s, e in zip(starts, ends)])


def windows(x: C, n: int) -> C:
    """All full windows of n items."""
    return F.when(F.size(x) >= n, F.transform(F.sequence(F.lit(0), F.size(x) - n), lambda i: F.slice(x, i + 1, n))).otherwise(F.slice(F.array(x), 1, 0))


def distinct(x: C) -> C:
    """Distinct items in the order of first sight."""
    return F.array_distinct(x)


def without(x: C, gone: C) -> C:
    """X without the items of gone; duplicates of the others stay."""
    return F.filter(x, lambda v: ~F.array_contains(gone, v))


def flatten(x: C, levels: int) -> C:
    """Nested lists razed `levels` times."""
    for _ in range(levels):
        x = F.flatten(x)
    return x


def iota(n: C | int) -> C:
    """0..n-1."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def dict_op(x: C, y: C, f: Callable[[C, C], C]) -> C:
    """F over the values of two maps with the same keys in the same order; else a length error when the plan runs."""
    made = F.map_from_arrays(F.map_keys(x), F.zip_with(F.map_values(x), F.map_values(y), f))
    return F.when(F.map_keys(x) == F.map_keys(y), made).otherwise(F.raise_error(F.lit("!length")))


def merge(x: C, y: C) -> C:
    """J5 on maps: the right's values win, the left's order stays, new keys follow."""
    kept = F.transform_values(x, lambda k, v: F.coalesce(F.try_element_at(y, k), v))
    return F.map_concat(kept, F.map_filter(y, lambda k, _: ~F.array_contains(F.map_keys(x), k)))


def json_value(text: C, path: str, kind: str = "string") -> C:
    """The value at a path such as $.a.b, in a type; null where the text has none."""
    return F.get_json_object(text, path).try_cast(kind)


def json_parse(text: C, schema: str) -> C:
    """S10 on a cell: JSON as a typed value; what does not fit is null."""
    return F.from_json(text, schema)


def json_text(value: C) -> C:
    """A value as JSON text."""
    return F.to_json(value)


def conditional(*parts: C) -> C:
    """Condition, value, condition, value, ..., other value."""
    if len(parts) < 3 or len(parts) % 2 == 0:
        raise EngineError("rank", "conditions and values come in pairs, then the other value")
    out = F.when(parts[0], parts[1])
    for c, v in zip(parts[2:-1:2], parts[3:-1:2]):
        out = out.when(c, v)
    return out.otherwise(parts[-1])
