"""The data model: positions, vectors, dictionaries, keyed tables, errors.

=============  =======================================  ===========================================
value          DataFrame                                notes
=============  =======================================  ===========================================
vector         (_pos bigint, v T)                       a large vector; small ones are array cells
table          (columns..., _pos bigint)                _pos is contiguous from 0
dictionary     (k, v, _pos)                             ordered, keys unique
keyed table    Keyed(DataFrame, key)                    one key column, unique
atom           literal                                  `F.lit`
=============  =======================================  ===========================================

Nulls are SQL NULL; `nulls="sentinel"` at the edges maps the sentinels of typed vectors (smallest int, NaN, empty string)
to NULL and back. Errors known from schemas are raised when the plan is made, errors of the data when it runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POS = "_pos"
KINDS = ("domain", "length", "rank", "nyi", "memory", "type", "io")


class EngineError(Exception):
    """An error with a kind: one of KINDS, or a name that the user signals."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"!{kind}" + (f": {detail}" if detail else ""))
        self.kind = kind


@dataclass(frozen=True)
class Keyed:
    """A keyed table: one row per value of `key`; a plain table's operators apply to `df`."""

    df: DataFrame
    key: str

    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c not in (self.key, POS)]

    def __getitem__(self, key) -> DataFrame:
        """The value row of a key; no row where it is absent."""
        return self.df.filter(F.col(self.key).eqNullSafe(F.lit(key))).select(*self.values)


def keyed(df: DataFrame, key: str) -> Keyed:
    if key not in df.columns:
        raise EngineError("length", f"no column {key}")
    return Keyed(df, key)


def vec(spark: SparkSession, values: Sequence, kind: T.DataType | str) -> DataFrame:
    """A vector from driver values."""
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField(POS, T.LongType()), T.StructField("v", T._parse_datatype_string(kind) if isinstance(kind, str) else kind)]))


def dct(spark: SparkSession, keys: Sequence, values: Sequence, key_kind: str, value_kind: str) -> DataFrame:
    """A dictionary from driver keys and values; one value goes to all keys."""
    if len(values) == 1 and len(keys) > 1:
        values = list(values) * len(keys)
    if len(keys) != len(values):
        raise EngineError("length")
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(zip(keys, values))], f"k {key_kind}, v {value_kind}, {POS} bigint")


def columns_of(df: DataFrame) -> list[str]:
    """The visible columns: all but the position."""
    return [c for c in df.columns if c != POS]


def zero_of(kind: T.DataType) -> Column:
    """What a lookup join puts where nothing matched: the type's zero."""
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    return F.lit(None).cast(kind)


def same_kinds(left: DataFrame, right: DataFrame, names: Sequence[str]) -> None:
    """Shared columns must have one type: nothing is widened silently."""
    for name in names:
        if left.schema[name].dataType != right.schema[name].dataType:
            raise EngineError("type", f"{name}: {left.schema[name].dataType.simpleString()} and {right.schema[name].dataType.simpleString()}")


def type_symbol(kind: T.DataType) -> str:
    """The letter of a kind: b i n f d c s, upper case for vectors, L for lists of them, m for maps, M for rows."""
    letters = {T.BooleanType: "b", T.IntegerType: "i", T.LongType: "n", T.FloatType: "f", T.DoubleType: "d", T.StringType: "s"}
    if isinstance(kind, T.ArrayType):
        inner = type_symbol(kind.elementType)
        return inner.upper() if len(inner) == 1 and inner.islower() else "L"
    if isinstance(kind, T.MapType):
        return "m"
    if isinstance(kind, T.StructType):
        return "M"
    return letters.get(type(kind), "x")
