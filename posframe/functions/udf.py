"""User functions: how Python callables enter a plan (U1..U6).

A callable on columns that uses column operations only needs no UDF: call it. The others run in Arrow batches, never a row
at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EngineError

MOST_ARGUMENTS = 16


def vectorised(f: Callable[..., pd.Series], kind: str) -> Callable[..., Column]:
    """A function of pandas series as a function of columns."""

    def run(*columns: pd.Series) -> pd.Series:
        return f(*columns)

    run.__annotations__ = {"columns": pd.Series, "return": pd.Series}
    made = F.pandas_udf(run, kind)

    def call(*columns: Column) -> Column:
        if len(columns) > MOST_ARGUMENTS:
            raise EngineError("rank", f"more than {MOST_ARGUMENTS} arguments")
        return made(*columns)

    return call


def folding(f: Callable[[pd.Series], float], kind: str = "double") -> Callable[[Column], Column]:
    """A function from a group's series to one value, as an aggregate. A group must fit a worker's memory; where partial
    results can be merged, use built-in aggregates or `aggregate.general_fold` instead."""

    def run(column: pd.Series) -> float:
        return f(column)

    run.__annotations__ = {"column": pd.Series, "return": float}
    return F.pandas_udf(run, kind)


def registered(spark: SparkSession, name: str, f: Callable[..., pd.Series], kind: str) -> None:
    """A vectorised function under a name for SQL."""

    def run(*columns: pd.Series) -> pd.Series:
        return f(*columns)

    run.__annotations__ = {"columns": pd.Series, "return": pd.Series}
    spark.udf.register(name, F.pandas_udf(run, kind))


def rows_to_rows(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function of batches of rows to any number of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield f(batch)

    return df.mapInPandas(run, schema)


def projection(f: Callable, **fixed) -> Callable:
    """Some arguments fixed by name."""
    return functools.partial(f, **fixed)


def train(*functions: Callable) -> Callable:
    """A composition; the last function is applied first."""
    return functools.reduce(lambda f, g: lambda *x: f(g(*x)), functions)


def pipeline(df: DataFrame, systems: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Functions of tables applied from left to right, as one plan."""
    for system in systems:
        df = df.transform(system)
    return df
