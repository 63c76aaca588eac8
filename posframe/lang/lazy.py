"""Values that live in Spark: tables, their columns, and descriptions of places, orders, groups and folds of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import POS, EngineError
from ..operators.position import numbered
from ..plans.blocks import BLOCK


class Frame:
    """A table with a position column, and maybe a key column.

    Columns that need the whole table (running folds, differences) are derivations of it: functions that add a column to
    its plan. A plan holds those that its expressions name, and what these need.
    """

    def __init__(self, df: DataFrame, pos: str = POS, key: str | None = None, names: list[str] | None = None):
        self.base, self.pos, self.key = df, pos, key
        self.names = names or [c for c in df.columns if c != POS]
        self.derived: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {}

    @property
    def df(self) -> DataFrame:
        """The plan with all derivations."""
        return self._with(list(self.derived))

    def _with(self, names: list[str]) -> DataFrame:
        df = self.base
        for n in names:
            df = self.derived[n][0](df)
        return df

    def plan(self, *exprs: Column) -> DataFrame:
        """The plan with the derivations that the expressions name."""
        text, wanted = " ".join(e._jc.toString() for e in exprs), set()
        for n in reversed(self.derived):
            if n in text:
                wanted.add(n)
                text += " " + self.derived[n][1]
        return self._with([n for n in self.derived if n in wanted])

    def series(self, name: str) -> Series:
        if name not in self.names:
            raise EngineError("index", name)
        return Series(self, F.col(f"`{name}`"))

    def derive(self, make: Callable[[DataFrame, str], DataFrame], *exprs: Column) -> Series:
        """A further column from a function of the whole table that keeps its rows; exprs: what it is made of."""
        name = f"_d{len(self.derived)}_of_{id(self)}_"
        self.derived[name] = (lambda df: make(df, name)), " ".join(e._jc.toString() for e in exprs)
        return Series(self, F.col(name))

    def with_column(self, s: Series) -> str:
        """The name of a column that holds an expression, for operators that take names."""
        return self.derive(lambda df, name: df.withColumn(name, s.expr), s.expr).expr._jc.toString()

    def filtered(self, mask: Column) -> Frame:
        """The rows where mask holds; positions keep their order but have gaps until `packed`."""
        return Frame(self.df.filter(mask), self.pos, self.key, self.names)

    def packed(self) -> Frame:
        """The same rows with contiguous positions."""
        return Frame(numbered(self.df.withColumn("_old", F.col(self.pos)).drop(POS), "_old", out=POS).drop("_old"), POS, self.key, self.names)

    def table(self) -> DataFrame:
        """The visible columns in order of the rows."""
        return self.df.orderBy(self.pos).select(*[f"`{n}`" for n in self.names])


@dataclass
class Series:
    """A column: an expression over a frame."""

    frame: Frame
    expr: Column

    def over(self, f: Callable[[Column], Column]) -> Series:
        return Series(self.frame, f(self.expr))


@dataclass
class Fold:
    """A fold of a column to one value, not yet run."""

    frame: Frame
    expr: Column

    def value(self):
        return self.frame.plan(self.expr).agg(self.expr.alias("v")).first()["v"]


@dataclass
class Places:
    """The positions where a mask holds."""

    frame: Frame
    mask: Column


@dataclass
class Order:
    """A grade: the positions in sorted order, or the first `limit` of them."""

    frame: Frame
    by: list[Column]
    desc: bool = False
    limit: int | None = None

    def first(self, n: int) -> Order:
        return replace(self, limit=n if self.limit is None else min(n, self.limit))

    def sorted(self) -> DataFrame:
        order = [c.desc_nulls_last() if self.desc else c.asc_nulls_first() for c in self.by] + [F.col(self.frame.pos).asc()]
        df = self.frame.plan(*self.by)
        if self.limit is not None:
            df = df.orderBy(*order).limit(self.limit)
        return numbered(df.withColumn("_was", F.col(self.frame.pos)).drop(POS), *[o if i < len(self.by) else F.col("_was").asc() for i, o in enumerate(order)], out=POS, ranges=1 if self.limit is not None and self.limit <= BLOCK else None)

    def frame_(self) -> Frame:
        return Frame(replace(self, frame=Frame(self.frame.df, self.frame.pos, self.frame.key, self.frame.names)).sorted(), POS, self.frame.key, self.frame.names)


@dataclass
class Groups:
    """A column's distinct values, each with its positions."""

    frame: Frame
    keys: list[Column]


@dataclass
class Grouped:
    """A column in groups."""

    series: Series
    groups: Groups


@dataclass
class Mapping:
    """A dictionary in Spark: k (k1, k2... for several keys) and v."""

    df: DataFrame

    @property
    def keys(self) -> list[str]:
        return [c for c in self.df.columns if c != "v"]


def fold_groups(g: Grouped, f: Callable[[Series], Fold]) -> Mapping:
    """A fold of each group: one grouped aggregation, partial sums first."""
    made = f(g.series)
    if not isinstance(made, Fold):
        raise EngineError("nyi", "only folds apply to groups in Spark")
    names = ["k"] if len(g.groups.keys) == 1 else [f"k{i + 1}" for i in range(len(g.groups.keys))]
    return Mapping(g.groups.frame.plan(made.expr, *g.groups.keys).groupBy(*[k.alias(n) for k, n in zip(g.groups.keys, names)]).agg(made.expr.alias("v")))
