"""Sets and bags of values, with first-seen order and kept duplicates where the semantics have them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .join import anti, semi


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both, one after the other."""
    return left.unionByName(right)


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """The distinct values of both."""
    return left.unionByName(right).distinct()


def intersect(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """left's rows whose value right has; duplicates stay."""
    return semi(left, name, right, name)


def without(values: DataFrame, drop: DataFrame, name: str) -> DataFrame:
    """The rows whose value is not among those to drop; duplicates stay."""
    return anti(values, name, drop, name)


def symmetric(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """The rows of either side whose value the other side lacks."""
    return without(left, right, name).unionByName(without(right, left, name))


def subset(left: DataFrame, right: DataFrame, name: str) -> bool:
    """Whether right has every value of left."""
    return without(left, right, name).isEmpty()


def powerset(values: Column) -> Column:
    """All 2^n sub-lists of an array cell, in the order of their bit masks; bit i takes element i."""
    n = F.size(values)
    masks = F.sequence(F.lit(0), F.expr("1") * F.pow(F.lit(2), n).cast("int") - 1)
    return F.transform(masks, lambda m: F.filter(values, lambda x, i: F.getbit(m, i) == 1))


def gray_code(bits: int) -> list[int]:
    """The numbers below 2^bits, each one bit from the next."""
    return [i ^ i >> 1 for i in range(1 << bits)]


def combinations(df: DataFrame, name: str, k: int, pos: str = "_pos") -> DataFrame:
    """All k-subsets of a vector's values in order, as lists; a join per element, each on a range of positions."""
    out = df.select(F.array(F.col(name)).alias("c"), F.col(pos).alias("_last"))
    for _ in range(k - 1):
        nxt = df.select(F.col(name).alias("_x"), F.col(pos).alias("_p"))
        out = out.join(nxt, F.col("_p") > F.col("_last")).select(F.concat("c", F.array("_x")).alias("c"), F.col("_p").alias("_last"))
    return out.select("c")
