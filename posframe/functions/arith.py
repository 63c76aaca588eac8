"""Arithmetic with the semantics of typed vectors, as column expressions.

Spark is in ANSI mode: overflow and division by zero raise. Each function here says what it does instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column


def wrap32(x: C) -> C:
    """M1: a long wrapped to 32 bits, as an int."""
    return F.shiftright(F.shiftleft(x.cast("long"), 32), 32).cast("int")


def add32(x: C, y: C) -> C:
    """M1 on 32-bit ints that wrap."""
    return wrap32(x.cast("long") + y.cast("long"))


def mul32(x: C, y: C) -> C:
    """M1 on 32-bit ints that wrap; the product of two ints fits a long."""
    return wrap32(x.cast("long") * y.cast("long"))


def divide(x: C, y: C, sentinel: bool = False) -> C:
    """M2: always a double. By zero: null, or with sentinel the infinities and NaN."""
    x, y = x.cast("double"), y.cast("double")
    if not sentinel:
        return F.try_divide(x, y)
    special = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(y == 0, special).otherwise(F.try_divide(x, y))


def fdiv(x: C, y: C | int) -> C:
    """M3: floored division of integers, exact for longs of either sign."""
    x, y = x.cast("long"), (F.lit(y) if isinstance(y, int) else y).cast("long")
    rest = x % y
    return _quotient(x, y) - ((rest != 0) & ((rest < 0) != (y < 0))).cast("long")


def _quotient(x: C, y: C) -> C:
    return F.call_function("div", x, y)


def fmod(x: C, y: C | int) -> C:
    """M3: the rest of floored division; it has the sign of y."""
    x, y = x.cast("long"), (F.lit(y) if isinstance(y, int) else y).cast("long")
    rest = x % y
    return F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest)


def lesser(x: C, y: C) -> C:
    """The smaller; null and NaN lose."""
    return F.least(F.nanvl(x.cast("double"), F.lit(None)), F.nanvl(y.cast("double"), F.lit(None)))


def larger(x: C, y: C) -> C:
    """The larger; null and NaN lose."""
    return F.greatest(F.nanvl(x.cast("double"), F.lit(None)), F.nanvl(y.cast("double"), F.lit(None)))


def is_null(x: C, floating: bool = False) -> C:
    """A2: the mask of nulls; NaN is one among floats."""
    return x.isNull() | F.coalesce(F.isnan(x), F.lit(False)) if floating else x.isNull()


def fill(x: C, value: C, floating: bool = False) -> C:
    """A3: nulls replaced."""
    return F.coalesce(F.nanvl(x, F.lit(None).cast("double")) if floating else x, value)


def cast(x: C, kind: str) -> C:
    """A4: a cast whose failures are null; "natural" saturates at 0 and 2^32-1."""
    if kind == "natural":
        return F.least(F.greatest(x.try_cast("long"), F.lit(0)), F.lit((1 << 32) - 1))
    if kind == "char":
        return F.chr(x.cast("long"))
    if kind == "code":
        return F.ascii(x)
    return x.try_cast(kind)


def is_not(x: C) -> C:
    """Logical not: true of 0 and of NaN."""
    return F.coalesce((x == 0) | F.isnan(x.cast("double")), F.lit(True))


def decode(digits: list[C], radices: list[int]) -> C:
    """M9: digits in mixed radix as one number; the first digit is taken by its radix too."""
    out = fmod(digits[0], radices[0])
    for d, r in zip(digits[1:], radices[1:]):
        out = out * r + fmod(d, r)
    return out


def encode(x: C, radices: list[int]) -> list[C]:
    """M9: the digits of a number in mixed radix, the first by its radix too."""
    out, weight = [], 1
    for r in reversed(radices):
        out.append(fmod(fdiv(x, weight), r))
        weight *= r
    return out[::-1]


def digits(x: C, base: int) -> C:
    """M9: the fewest digits of |x| in one base, as an array."""
    n = F.abs(x.cast("long"))
    count = F.when(n == 0, F.lit(1)).otherwise(F.floor(F.log(n.cast("double")) / F.log(F.lit(float(base))) + 1e-9).cast("int") + 1)
    powers = F.transform(F.sequence(count - 1, F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(float(base)), i).cast("long"))
    return F.transform(powers, lambda w: fmod(fdiv(n, w), base))


def clamp(x: C, low: C, high: C) -> C:
    """M11"""
    return F.least(F.greatest(x, low), high)


def mix(x: C, y: C, share: C) -> C:
    """Linear interpolation."""
    return x * (1 - share) + y * share


def step(edge: C, x: C) -> C:
    """M11"""
    return F.when(x < edge, 0.0).otherwise(1.0)


def smoothstep(low: C, high: C, x: C) -> C:
    """M11"""
    t = clamp((x - low) / (high - low), F.lit(0.0), F.lit(1.0))
    return t * t * (3 - 2 * t)


def fract(x: C) -> C:
    """M11"""
    return x - F.floor(x)


def morton(x: C, y: C) -> C:
    """The bits of two 16-bit numbers interleaved, x in the even places."""
    bits = [F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1)), 2 * i + o) for i in range(16) for v, o in ((x.cast("long"), 0), (y.cast("long"), 1))]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def fibonacci(n: C) -> C:
    """The n-th Fibonacci number, 0 and 1 first."""
    pair = F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.struct(F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b")), lambda s, _: F.struct(s["b"].alias("a"), (s["a"] + s["b"]).alias("b")))
    return F.when(n <= 0, F.lit(0).cast("long")).otherwise(pair["a"])


def choose(n: C, k: C) -> C:
    """Binomial coefficient, in exact steps."""
    return F.when(k > n, F.lit(0).cast("long")).when(k <= 0, F.lit(1).cast("long")).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), F.lit(1).cast("long"), lambda acc, i: _quotient(acc * (n.cast("long") - k.cast("long") + i), i.cast("long"))))


def catalan(n: C) -> C:
    """M10"""
    return _quotient(choose(2 * n, n), (n + 1).cast("long"))
