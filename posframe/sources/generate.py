"""Generated tables: ranges, grids, unit matrices, random vectors, literals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import POS, EngineError, Keyed, keyed
from ..operators.position import numbered


def iota(spark: SparkSession, n: int) -> DataFrame:
    """The vector 0..n-1."""
    if n < 0:
        raise EngineError("domain", str(n))
    return spark.range(n).select(F.col("id").alias(POS), F.col("id").alias("v"))


def odometer(spark: SparkSession, *radices: int) -> DataFrame:
    """Every index of a grid, the last digit fastest: _pos, d0, d1, ... From one range, without joins."""
    total = 1
    for r in radices:
        total *= r
    weight, out = total, []
    for i, r in enumerate(radices):
        weight //= max(r, 1)
        out.append((F.expr(f"id div {max(weight, 1)}") % max(r, 1)).alias(f"d{i}"))
    return spark.range(total).select(F.col("id").alias(POS), *out)


def unit(spark: SparkSession, n: int) -> DataFrame:
    """The rows of the unit matrix, as cells."""
    return spark.range(n).select(F.col("id").alias(POS), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: (j == F.col("id")).cast("int")).alias("v"))


def uniform(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """N numbers in [0, 1); each depends on the seed and its place alone, however the rows are split."""
    return spark.range(n).select(F.col("id").alias(POS), (F.xxhash64(F.lit(seed), "id") / F.lit(2.0**64) + 0.5).alias("v"))


def roll(spark: SparkSession, n: int, below: int, seed: int = 0) -> DataFrame:
    """N numbers below a bound, with repeats."""
    return spark.range(n).select(F.col("id").alias(POS), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(below)).alias("v"))


def deal(spark: SparkSession, n: int, below: int, seed: int = 0) -> DataFrame:
    """N different numbers below a bound, in random order."""
    if n > below:
        raise EngineError("length", f"{n} different numbers below {below}")
    order = spark.range(below).select(F.col("id").alias("v"), F.xxhash64(F.lit(seed), "id").alias("_r"))
    return numbered(order.orderBy("_r", "v").limit(n), "_r", "v").select(POS, "v")


def literal(spark: SparkSession, columns: Mapping[str, Sequence], schema: str | None = None) -> DataFrame:
    """A table from columns of driver values of one length."""
    lengths = {len(v) for v in columns.values()}
    if len(lengths) > 1:
        raise EngineError("length", "columns of several lengths")
    rows = [(*r, i) for i, r in enumerate(zip(*columns.values()))]
    if schema:
        return spark.createDataFrame(rows, f"{schema}, {POS} bigint")
    return spark.createDataFrame(rows, [*columns, POS])


def keyed_literal(spark: SparkSession, key: Mapping[str, Sequence], columns: Mapping[str, Sequence], schema: str | None = None) -> Keyed:
    """A keyed table from a key column and value columns."""
    if len(key) != 1:
        raise EngineError("rank", "one key column")
    return keyed(literal(spark, {**key, **columns}, schema), next(iter(key)))


def place(df: DataFrame) -> DataFrame:
    """A table held in memory, spilling to disk; release it with unpersist()."""
    return df.persist()


def fetch(df: DataFrame, pos: str = POS) -> dict[str, list]:
    """A small table as columns of driver values, in order."""
    rows = df.orderBy(pos).collect() if pos in df.columns else df.collect()
    return {c: [r[c] for r in rows] for c in df.columns if c != pos}
