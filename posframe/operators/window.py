"""Functions of neighbours in order: running folds, differences, sliding windows, ranks, runs.

Without keys they work in blocks of positions (plans.blocks), so no task sees the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import POS
from ..plans.blocks import BLOCK, FOLDS, framed, running

__all__ = ["runs", "each_prior", "mavg", "mmax", "mmin", "running", "shift", "stencil", "windows", "overlapping", "scan"]


def each_prior(df: DataFrame, value: str, f: Callable[[Column, Column], Column], out: str, *, seed=None, keys: Sequence[str] = (), pos: str = POS, block: int = BLOCK) -> DataFrame:
    """f(current, previous); the first row is unchanged, or meets the seed where one is given."""
    flagged = framed(df, {"_prior": lambda w: F.lag(value).over(w), "_n": lambda w: F.lag(F.lit(1)).over(w)}, 1, 0, pos=pos, keys=keys, block=block)
    first = F.col(value) if seed is None else f(F.col(value), F.lit(seed))
    return flagged.withColumn(out, F.when(F.col("_n").isNull(), first).otherwise(f(F.col(value), F.col("_prior")))).drop("_prior", "_n")


def shift(df: DataFrame, value: str, by: int, out: str, *, fill=None, keys: Sequence[str] = (), pos: str = POS, block: int = BLOCK) -> DataFrame:
    """The value `by` rows earlier (later for negative by), `fill` where there is none."""
    return framed(df, {out: lambda w: F.lag(value, by, fill).over(w)}, max(by, 0), max(-by, 0), pos=pos, keys=keys, block=block)


def stencil(df: DataFrame, value: str | Column, n: int, fold: str, out: str, *, keys: Sequence[str] = (), pos: str = POS, block: int = BLOCK) -> DataFrame:
    """The fold of each full window of n rows, at its first row; the last n-1 rows have none and go."""
    v = F.col(value) if isinstance(value, str) else value
    made = {out: lambda w: FOLDS[fold][0](v).over(w.rowsBetween(0, n - 1)), "_n": lambda w: F.count(F.lit(1)).over(w.rowsBetween(0, n - 1))}
    return framed(df, made, 0, n - 1, pos=pos, keys=keys, block=block).filter(F.col("_n") == n).drop("_n")


def windows(df: DataFrame, value: str, n: int, out: str = "v", *, keys: Sequence[str] = (), pos: str = POS, block: int = BLOCK) -> DataFrame:
    """Each full window of n rows as a list, at its first row."""
    made = {"_w": lambda w: F.collect_list(F.struct(F.col(value).alias("v"))).over(w.rowsBetween(0, n - 1))}
    full = framed(df, made, 0, n - 1, pos=pos, keys=keys, block=block).filter(F.size("_w") == n)
    return full.withColumn(out, F.transform("_w", lambda s: s["v"])).drop("_w")


def _trailing(df: DataFrame, value: str, n: int, fold: Callable[[Column], Column], out: str, **how) -> DataFrame:
    return framed(df, {out: lambda w: fold(F.col(value)).over(w.rowsBetween(-(n - 1), 0))}, n - 1, 0, **how)


def mavg(df: DataFrame, value: str, n: int, out: str, **how) -> DataFrame:
    """The sum of the last n rows by n, at the start too, where there are fewer."""
    return _trailing(df, value, n, F.sum, out, **how).withColumn(out, F.col(out) / n)


def mmax(df: DataFrame, value: str, n: int, out: str, **how) -> DataFrame:
    """The largest of the last n rows, of those there are at the start."""
    return _trailing(df, value, n, F.max, out, **how)


def mmin(df: DataFrame, value: str, n: int, out: str, **how) -> DataFrame:
    """The smallest of the last n rows."""
    return _trailing(df, value, n, F.min, out, **how)


def runs(df: DataFrame, flag: Column, pos: str = POS, block: int = BLOCK) -> DataFrame:
    """(start, len) of each run of true flags in contiguous positions.

    Runs are found inside blocks; a run that crosses a block's end is joined with what follows it, by the gaps between
    starts among the few pieces, a row or so per run.
    """
    on = df.filter(flag).select(F.col(pos).alias("p"), F.expr(f"`{pos}` div {block}").alias("b"))
    island = F.col("p") - F.row_number().over(W.partitionBy("b").orderBy("p"))
    pieces = on.select("b", "p", island.alias("g")).groupBy("b", "g").agg(F.min("p").alias("start"), F.max("p").alias("end"))
    # pieces that touch a block's edge may continue; the others are runs already
    edge = (F.col("start") % block == 0) | (F.col("end") % block == block - 1)
    whole = pieces.filter(~edge).select("start", (F.col("end") - F.col("start") + 1).alias("len"))
    w = W.orderBy("start")
    touching = pieces.filter(edge).select("start", "end", F.coalesce((F.lag("end").over(w) + 1 != F.col("start")).cast("int"), F.lit(1)).alias("new"))
    joined = touching.select("start", "end", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("run"))
    return whole.unionByName(joined.groupBy("run").agg(F.min("start").alias("start"), (F.max("end") - F.min("start") + 1).alias("len")).select("start", "len"))


def scan(values: Column, f: Callable[[Column, Column], Column], seed: Column | None = None) -> Column:
    """W2 on an array cell: all results of a left fold of any function; the seed itself is not one."""
    rest = values if seed is not None else F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    start = F.array(seed) if seed is not None else F.slice(values, 1, 1)
    out = F.aggregate(rest, start, lambda acc, x: F.concat(acc, F.array(f(F.element_at(acc, -1), x))))
    return F.slice(out, 2, F.greatest(F.size(out) - 1, F.lit(0))) if seed is not None else out


def scan_groups(df: DataFrame, value: str, f: Callable[[float, float], float], out: str, *, keys: Sequence[str], seed: float | None = None, pos: str = POS) -> DataFrame:
    """W2, W12 on a table: all results of a left fold of any Python function of two numbers, per key, in order of pos.

    A group is one task's work and memory; without keys, or where the function is one of FOLDS, use `running`.
    """
    import pandas as pd
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group, held, results = group.sort_values(pos), seed, []
        for x in group[value]:
            held = float(x) if held is None else float(f(held, x))
            results.append(held)
        return group.assign(**{out: results})

    return df.groupBy(*keys).applyInPandas(run, schema)


def overlapping(values: Column, size: int, hop: int) -> Column:
    """Frames of `size` values, one every `hop`, from an array cell; only full ones."""
    starts = F.sequence(F.lit(0), F.size(values) - size, F.lit(hop))
    return F.when(F.size(values) >= size, F.transform(starts, lambda s: F.slice(values, s + 1, size))).otherwise(F.array().cast("array<array<double>>"))
