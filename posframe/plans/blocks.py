"""Running and sliding functions over a whole ordered table without a single-task window.

A window without PARTITION BY moves all rows to one task, and one by keys all rows of a hot key. Rows that carry a
contiguous position fall into blocks of BLOCK rows instead, within their keys. A running fold is three steps: fold each
block, fold the block totals (a row per block), and add the offset inside each block. A sliding frame needs only the rows
around it: each block gets copies of the rows that its frames reach into, however many blocks that are, which are dropped
again. With keys, frames count the rows of a key, which are numbered by a running count first.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import POS

BLOCK = 1 << 17

#: name: (aggregate, combination of an offset and a value)
FOLDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: a + b),
    "product": (F.product, lambda a, b: a * b),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "all": (F.bool_and, lambda a, b: a & b),
    "any": (F.bool_or, lambda a, b: a | b),
    "count": (F.count, lambda a, b: a + b),
}


def running(df: DataFrame, value: Column | str, fold: str, out: str, *, pos: str = POS, keys: Sequence[str] = (), seed=None, block: int = BLOCK) -> DataFrame:
    """df with `out`, the inclusive running fold of value in the order of pos, an integer; per key where keys are given.

    seed: a value that the fold starts from; it is not a result of its own.
    """
    aggregate, combine = FOLDS[fold]
    value = F.col(value) if isinstance(value, str) else value
    seeded = (lambda c: c) if seed is None else (lambda c: combine(F.lit(seed), c))
    upto = (W.unboundedPreceding, W.currentRow)
    split = df.withColumn("_block", F.expr(f"`{pos}` div {block}"))
    totals = split.groupBy(*keys, "_block").agg(aggregate(value).alias("_total"))
    before = aggregate(F.col("_total")) if fold != "count" else F.sum("_total")
    upper = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_of_{i}") for i, k in enumerate(keys)], F.col("_block").alias("_of"), before.over(upper).alias("_before"))
    inside = aggregate(value).over(W.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(*upto))
    met = F.col("_block") == F.col("_of")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_of_{i}"))
    joined = split.withColumn(out, inside).join(offsets, met)
    total = F.when(F.col("_before").isNull(), F.col(out)).when(F.col(out).isNull(), F.col("_before")).otherwise(combine(F.col("_before"), F.col(out)))
    return joined.withColumn(out, seeded(total)).drop("_block", "_of", "_before", *[f"_of_{i}" for i in range(len(keys))])


def framed(df: DataFrame, columns: Mapping[str, Callable[[WindowSpec], Column]], before: int, after: int, *, pos: str = POS, keys: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """df with further columns, each a function of the window that orders rows by pos and reaches `before` and `after`.

    The functions may take lag, lead and rows between -before and after; pos is an integer, contiguous where no keys are
    given. A row is copied to every block in which a frame reaches it.
    """
    if keys:
        numbered = running(df, F.lit(1), "count", "_nth", pos=pos, keys=keys, block=block)
        made = _framed(numbered, columns, before, after, "_nth", keys, block)
        return made.drop("_nth")
    return _framed(df, columns, before, after, pos, (), block)


def _framed(df: DataFrame, columns: Mapping[str, Callable[[WindowSpec], Column]], before: int, after: int, pos: str, keys: Sequence[str], block: int) -> DataFrame:
    place = F.col(pos).cast("long")
    of = lambda p: F.call_function("div", p, F.lit(block))
    homes = F.sequence(of(F.greatest(place - after, F.lit(0))), of(place + before))
    spread = df.select("*", of(place).alias("_home"), F.explode(homes).alias("_block"))
    w = W.partitionBy(*keys, "_block").orderBy(pos)
    out = spread.select("*", *[f(w).alias(name) for name, f in columns.items()])
    return out.filter("_block = _home").drop("_block", "_home")
