"""Grades, sorts, top-k, and reshaping by position. Ties keep the order of positions, descending too."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import POS
from .position import numbered


def order(df: DataFrame, names: Sequence[str], desc: bool = False, pos: str = POS) -> list[Column]:
    """O1, O3: the order by columns, left to right, all turned for desc; null and NaN are lowest; ties by position."""
    out: list[Column] = []
    for n in names:
        if isinstance(df.schema[n].dataType, (T.FloatType, T.DoubleType)):
            # Spark has NaN above all numbers
            out.append(F.isnan(n).asc_nulls_last() if desc else F.isnan(n).desc_nulls_first())
        out.append(F.col(n).desc_nulls_last() if desc else F.col(n).asc_nulls_first())
    return [*out, F.col(pos).asc()]


def grade(df: DataFrame, *names: str, desc: bool = False, pos: str = POS, out: str = "r", ranges: int | None = None) -> DataFrame:
    """Df with `out`, the place of each row in the sorted order, from 0. The grade vector is `pos` by `out`."""
    return numbered(df, *order(df, names, desc, pos), out=out, ranges=ranges)


def sort(df: DataFrame, *names: str, desc: bool = False, pos: str = POS) -> DataFrame:
    """O4..O6: rows in sorted order, positions anew."""
    return grade(df.withColumnRenamed(pos, "_old"), *names, desc=desc, pos="_old", out=pos).drop("_old")


def top(df: DataFrame, k: int, name: str, desc: bool = True, pos: str = POS) -> DataFrame:
    """The k first rows in sorted order; each task keeps k rows, no global sort."""
    return df.orderBy(*order(df, [name], desc, pos)).limit(k)


def top_of_groups(df: DataFrame, k: int, keys: Sequence[str], name: str, desc: bool = True, pos: str = POS) -> DataFrame:
    """O9 per group: Spark cuts each task's groups to k rows before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order(df, [name], desc, pos)))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def cut(df: DataFrame, starts: Sequence[int], pos: str = POS, out: str = "seg") -> DataFrame:
    """Each row with the number of its segment; rows before the first start go. starts ascend, repeats are empty segments."""
    segment = F.lit(None).cast("bigint")
    for i, s in enumerate(starts):
        segment = F.when(F.col(pos) >= s, F.lit(i).cast("bigint")).otherwise(segment)
    return df.withColumn(out, segment).filter(F.col(out).isNotNull())


def cut_fold(df: DataFrame, starts: Sequence[int], *aggregates: Column, pos: str = POS, out: str = "seg") -> DataFrame:
    """O11 with a fold of each segment, the empty ones too: theirs is the fold of no rows.

    Rows are folded before they meet the list of segments, so that a segment with most of the rows moves as partial folds.
    """
    all_ = df.sparkSession.range(len(starts)).select(F.col("id").alias("_seg"))
    rows = cut(df, starts, pos, out)
    fold = F.struct(*[a.alias(f"_{i}") for i, a in enumerate(aggregates)])
    folds = rows.groupBy(F.col(out).alias("_of")).agg(fold.alias("_fold"))
    none = rows.filter(F.lit(False)).agg(fold.alias("_none"))
    every = all_.join(folds, F.col("_seg") == F.col("_of"), "left").crossJoin(none).withColumn("_fold", F.coalesce("_fold", "_none"))
    return every.select(F.col("_seg").alias(out), *[F.col("_fold").getField(f"_{i}").alias(name) for i, name in enumerate(rows.agg(*aggregates).columns)])


def reshape(df: DataFrame, value: str, columns: int, pos: str = POS, row: str = "row", out: str = "r") -> DataFrame:
    """A vector as rows of `columns` values, the last one shorter where they do not divide."""
    cells = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v"))))
    return df.groupBy(F.expr(f"`{pos}` div {columns}").alias(row)).agg(F.transform(cells, lambda s: s["v"]).alias(out))


def reshape_cell(values: Column, rows: int | None, columns: int | None) -> Column:
    """O13 on an array cell: rows by columns, cycling to fill; None is inferred from the length."""
    n = F.size(values)
    r = F.lit(rows) if rows is not None else F.floor(n / columns).cast("int")
    c = F.lit(columns) if columns is not None else F.floor(n / rows).cast("int")
    line = lambda i: F.transform(F.sequence(F.lit(0), c - 1), lambda j: F.get(values, F.pmod(i * c + j, n)))
    return F.transform(F.sequence(F.lit(0), r - 1), line)


def shuffle(df: DataFrame, seed: int, pos: str = POS) -> DataFrame:
    """Rows in a random order that depends on the seed and their positions alone."""
    return numbered(df.withColumnRenamed(pos, "_old"), F.xxhash64(F.lit(seed), "_old"), "_old", out=pos).drop("_old")
