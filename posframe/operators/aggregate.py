"""Folds over tables and groups. All are built-in aggregates, so partial sums come before the shuffle.

First and last go by position, never by arrival; bools count as 0 and 1.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import POS


def _first(v: Column, pos: str) -> Column:
    return F.min_by(v, pos)


#: name: (value, position) -> aggregate
FOLDS: dict[str, Callable[[Column, str], Column]] = {
    "sum": lambda v, _: F.sum(v),  # G1
    "trues": lambda v, _: F.count_if(v),  # G1 on flags
    "product": lambda v, _: F.product(v),  # G2
    "min": lambda v, _: F.min(v),  # G3
    "max": lambda v, _: F.max(v),
    "all": lambda v, _: F.bool_and(v),
    "any": lambda v, _: F.bool_or(v),
    "count": lambda v, _: F.count(F.lit(1)),  # G4
    "first": _first,  # G5
    "last": lambda v, pos: F.max_by(v, pos),
    "raze": lambda v, pos: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), v.alias("v")))), lambda s: s["v"])),  # G6
    "list": lambda v, pos: F.transform(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), v.alias("v")))), lambda s: s["v"]),
    "avg": lambda v, _: F.avg(v),  # G15
    "var": lambda v, _: F.var_samp(v),  # G16
    "std": lambda v, _: F.stddev_samp(v),
    "median": lambda v, _: F.median(v),  # G17
    "distinct": lambda v, _: F.count_distinct(v),  # G14
    "about_distinct": lambda v, _: F.approx_count_distinct(v),
}


def fold(df: DataFrame, keys: Sequence[str | Column], *folds: tuple[str, str | Column, str], pos: str = POS) -> DataFrame:
    """G1..G5, G11, G12, G14..G17: one row per group (one in all without keys). folds: (name, value, result's name)."""
    made = [FOLDS[name](F.col(v) if isinstance(v, str) else v, pos).alias(out) for name, v, out in folds]
    return df.groupBy(*keys).agg(*made) if keys else df.agg(*made)


def group(df: DataFrame, *keys: str, pos: str = POS, out: str = POS) -> DataFrame:
    """Each distinct key with the ascending list of its positions."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(pos)).alias(out))


def group_dict(d: DataFrame, pos: str = POS) -> DataFrame:
    """Each distinct value of a dictionary with the list of its keys, in order."""
    return d.groupBy("v").agg(F.transform(F.sort_array(F.collect_list(F.struct(pos, "k"))), lambda s: s["k"]).alias("k"))


def freq(df: DataFrame, *keys: str, out: str = "n") -> DataFrame:
    """The size of each group."""
    return df.groupBy(*keys).agg(F.count("*").alias(out))


def distinct_first(df: DataFrame, name: str, pos: str = POS, out: str = "pos") -> DataFrame:
    """Distinct values with the position where each was first seen; order by it for the order of first sight."""
    return df.groupBy(name).agg(F.min(pos).alias(out))


def histogram(df: DataFrame, bin_: Column, weight: Column, bins: int, out: str = "w") -> DataFrame:
    """The sum of weights in each of the bins 0..bins-1, 0 where there is none."""
    sums = df.select(bin_.cast("bigint").alias("_b"), weight.alias("_w")).filter(F.col("_b").between(0, bins - 1)).groupBy("_b").agg(F.sum("_w").alias("_s"))
    grid = df.sparkSession.range(bins).select(F.col("id").alias("b"))
    return grid.join(sums, F.col("b") == F.col("_b"), "left").select("b", F.coalesce("_s", F.lit(0.0)).alias(out))


def dot(df: DataFrame, x: str, y: str, out: str = "d") -> DataFrame:
    """The sum of products."""
    return df.agg(F.sum(F.col(x) * F.col(y)).alias(out))


def argmax(df: DataFrame, keys: Sequence[str], value: str, pos: str = POS, out: str = "k") -> DataFrame:
    """The position of the largest value, the first of equal ones."""
    best = F.max_by(F.col(pos), F.struct(F.col(value), -F.col(pos))).alias(out)
    return df.groupBy(*keys).agg(best) if keys else df.agg(best)


def argmin(df: DataFrame, keys: Sequence[str], value: str, pos: str = POS, out: str = "k") -> DataFrame:
    """The position of the smallest value, the first of equal ones."""
    best = F.min_by(F.col(pos), F.struct(F.col(value), F.col(pos))).alias(out)
    return df.groupBy(*keys).agg(best) if keys else df.agg(best)


def general_fold(values: Column, f: Callable[[Column, Column], Column], seed: Column) -> Column:
    """A left fold of any function over an array cell."""
    return F.aggregate(values, seed, f)


def related(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """G21, extension: covariance, correlation and the least-squares line of y by x."""
    made = [F.covar_samp(x, y).alias("covar"), F.corr(x, y).alias("corr"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")]
    return df.groupBy(*keys).agg(*made) if keys else df.agg(*made)
