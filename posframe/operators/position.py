"""Positions: giving rows contiguous numbers in an order, and moving rows by number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import POS, EngineError
from ..plans.lineage import checkpointed



def numbered(df: DataFrame, *order: Column | str, out: str = POS, ranges: int | None = None) -> DataFrame:
    """df with `out`, contiguous from 0 in the given order; the order should have no ties.

    Rows are dealt into ranges of the order (by default as many as the session's shuffle partitions), numbered in each,
    and the counts of the ranges before are added: no task sees the whole table, whatever its size. ranges=1 is for rows
    whose number the caller bounds, as a top-k does; one task numbers them.
    """
    order = tuple(F.col(c) if isinstance(c, str) else c for c in order)
    if ranges == 1:
        return df.withColumn(out, (F.row_number().over(W.orderBy(*order)) - 1).cast("bigint"))
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = counts.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn(out, inside).join(offsets, F.col("_range") == F.col("_of")).withColumn(out, (F.col(out) + F.col("_before")).cast("bigint")).drop("_range", "_of", "_before")


def renumbered(df: DataFrame, pos: str = POS) -> DataFrame:
    """Positions made contiguous again after rows were dropped or added."""
    return numbered(df.withColumnRenamed(pos, "_old"), "_old", out=pos).drop("_old")


def at(df: DataFrame, indices: DataFrame, pos: str = POS, check: bool = True) -> DataFrame:
    """P5: the rows at the positions of a vector (_pos, v), in its order; repeats and any order allowed.

    A position out of range raises an index error when the plan runs (check), or is left out.
    """
    rows = df.withColumnRenamed(pos, "_at")
    out = indices.withColumnRenamed(pos, "_out").join(rows, F.col("v") == F.col("_at"), "left" if check else "inner")
    if check:
        found = F.when(F.col("_at").isNull(), F.raise_error(F.lit("!index")).cast("bigint")).otherwise(F.col("_out"))
        out = out.withColumn("_out", found)
    return out.drop("v", "_at").withColumnRenamed("_out", pos)


def row(df: DataFrame, i: int, pos: str = POS) -> dict:
    """P5: the row at one position, as a dict."""
    found = df.filter(F.col(pos) == i).drop(pos).head(1)
    if not found:
        raise EngineError("index", str(i))
    return found[0].asDict()


def take(df: DataFrame, n: int, pos: str = POS, size: int | None = None) -> DataFrame:
    """The first n rows, the last -n of them; over and over where n exceeds the rows."""
    size = df.count() if size is None else size
    if abs(n) <= size:
        return df.filter(F.col(pos) < n) if n >= 0 else df.filter(F.col(pos) >= size + n).withColumn(pos, F.col(pos) - (size + n))
    if not size:
        return df
    # cyclic: position i shows row i mod size, counted from the end for negative n
    shift = (size - (-n) % size) % size if n < 0 else 0
    cycle = df.sparkSession.range(abs(n)).select(F.col("id").alias("_i"), F.pmod(F.col("id") + shift, F.lit(size)).alias("_at"))
    return cycle.join(df.withColumnRenamed(pos, "_from"), F.col("_at") == F.col("_from")).drop("_at", "_from").withColumnRenamed("_i", pos)


def drop(df: DataFrame, n: int, pos: str = POS, size: int | None = None) -> DataFrame:
    """Without the first n rows, or without the last -n."""
    if n >= 0:
        return df.filter(F.col(pos) >= n).withColumn(pos, F.col(pos) - n)
    return df.filter(F.col(pos) < (df.count() if size is None else size) + n)


def reverse(df: DataFrame, pos: str = POS, size: int | None = None) -> DataFrame:
    """Rows in the opposite order."""
    return df.withColumn(pos, F.lit((df.count() if size is None else size) - 1) - F.col(pos))


def delete_at(df: DataFrame, i: int, pos: str = POS, size: int | None = None) -> DataFrame:
    """Without the row at i; out of range is a length error."""
    size = df.count() if size is None else size
    if not 0 <= i < size:
        raise EngineError("length", str(i))
    return df.filter(F.col(pos) != i).withColumn(pos, F.when(F.col(pos) > i, F.col(pos) - 1).otherwise(F.col(pos)))


def splice(df: DataFrame, start: int, end: int, other: DataFrame, pos: str = POS) -> DataFrame:
    """Rows start..end-1 replaced by the rows of other."""
    m = other.count()
    head = df.filter(F.col(pos) < start)
    tail = df.filter(F.col(pos) >= end).withColumn(pos, F.col(pos) + (m - (end - start)))
    return head.unionByName(other.withColumn(pos, F.col(pos) + start)).unionByName(tail)


def concat(left: DataFrame, right: DataFrame, pos: str = POS) -> DataFrame:
    """The rows of right after those of left."""
    n = left.count()
    return left.unionByName(right.withColumn(pos, F.col(pos) + n))
