"""Columns, rows by condition, indexed updates."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import POS, EngineError, Keyed, columns_of, same_kinds, type_symbol


def column(df: DataFrame, name: str, pos: str = POS) -> DataFrame:
    """A column as a vector."""
    return df.select(pos, F.col(name).alias("v"))


def columns(df: DataFrame, *names: str, pos: str = POS) -> list[DataFrame]:
    """Several columns as a list of vectors, not as a table."""
    return [column(df, n, pos) for n in names]


def take_columns(df: DataFrame, *names: str, pos: str = POS) -> DataFrame:
    """P3 on a table: the named columns, with the position."""
    return df.select(*names, *([pos] if pos in df.columns else []))


def take_keys(d: DataFrame, keys: DataFrame, pos: str = POS) -> DataFrame:
    """P3 on a dictionary: the entries of the keys (_pos, v) in their order; a missing key gives null."""
    wanted = keys.select(F.col("v").alias("k"), F.col(pos).alias("_out"))
    return wanted.join(d.drop(pos), "k", "left").withColumnRenamed("_out", pos)


def drop_keys(d: DataFrame, keys: DataFrame) -> DataFrame:
    """P4 on a dictionary: without the entries of the keys (v)."""
    return d.join(keys.select(F.col("v").alias("k")), "k", "left_anti")


def drop_rows(u: Keyed, keys: DataFrame) -> Keyed:
    """P4 on a keyed table: without the rows of the keys (v)."""
    return Keyed(u.df.join(keys.select(F.col("v").alias(u.key)), u.key, "left_anti"), u.key)


def filter_mask(df: DataFrame, mask: Column) -> DataFrame:
    """The rows where the mask is true; a mask of two elements compresses like any other."""
    return df.filter(mask)


def pick_pair(mask: Column, first: Column, second: Column) -> Column:
    """A mask as an index into two values."""
    return F.when(mask, second).otherwise(first)


def weed_out(df: DataFrame, mask: Column) -> DataFrame:
    """The rows where the mask is false."""
    return df.filter(~mask)


def where(df: DataFrame, flag: Column, pos: str = POS, out: str = "v") -> DataFrame:
    """P8 on flags: the positions of the true ones."""
    return df.filter(flag).select(F.col(pos).alias(out))


def replicate(df: DataFrame, count: Column, keep: list[str], out: str = "rep") -> DataFrame:
    """P8 on counts: each row as often as its count says, `out` numbering the repeats; a negative count is a domain error."""
    checked = F.when(count < 0, F.raise_error(F.lit("!domain")).cast("int")).otherwise(count.cast("int"))
    return df.select(*keep, F.posexplode(F.array_repeat(F.lit(True), checked)).alias("_rep", "_true")).select(*keep, F.col("_rep").cast("bigint").alias(out))


def member(value: Column, values: list) -> Column:
    """P13 against a short list of driver values: a mask; another type is no member."""
    return F.coalesce(value.isin(*values), F.lit(False)) if values else F.lit(False)


def member_of(df: DataFrame, name: str, values: DataFrame, out: str) -> DataFrame:
    """P13 against a vector (v) of any size: df with the mask `out`."""
    distinct = values.select(F.col("v").alias("_member")).filter("_member is not null").distinct()
    return df.join(distinct, F.col(name) == F.col("_member"), "left").withColumn(out, F.col("_member").isNotNull()).drop("_member")


def find(df: DataFrame, name: str, values: DataFrame, size: int | None = None, out: str = "pos", pos: str = POS) -> DataFrame:
    """Df with the first position of its value in the vector (_pos, v); the vector's length where it has none."""
    size = values.count() if size is None else size
    first = values.groupBy(F.col("v").alias("_value")).agg(F.min(pos).alias(out))
    return df.join(first, F.col(name) == F.col("_value"), "left").withColumn(out, F.coalesce(out, F.lit(size)).cast("bigint")).drop("_value")


def amend(df: DataFrame, updates: Mapping[str, Column | Callable[[Column], Column]]) -> DataFrame:
    """Whole columns replaced, or updated by a function of themselves."""
    return df.withColumns({n: f(F.col(n)) if callable(f) and not isinstance(f, Column) else f for n, f in updates.items()})


def amend_at(df: DataFrame, name: str, changes: DataFrame, fold: str | None = None, pos: str = POS) -> DataFrame:
    """P20: the column changed at positions. changes (v: position, y: value, _pos: order).

    fold None assigns: of several changes at one position the last counts. "sum", "product", "min", "max" accumulate.
    """
    y = F.max_by("y", pos) if fold is None else getattr(F, fold)("y")
    by = changes.groupBy(F.col("v").alias("_at")).agg(y.alias("_y"))
    combined = {None: lambda a, b: b, "sum": lambda a, b: a + b, "product": lambda a, b: a * b, "min": F.least, "max": F.greatest}[fold](F.col(name), F.col("_y"))
    kind = df.schema[name].dataType
    return df.join(by, F.col(pos) == F.col("_at"), "left").withColumn(name, F.when(F.col("_at").isNotNull(), combined).otherwise(F.col(name)).cast(kind)).drop("_at", "_y")


def drill(value: Column, path: list[str | int], f: Callable[[Column], Column]) -> Column:
    """A nested cell with the place at `path` (field names, array places from 0) updated by f."""
    if not path:
        return f(value)
    step, rest = path[0], path[1:]
    if isinstance(step, str):
        return value.withField(step, drill(value.getField(step), rest, f))
    return F.transform(value, lambda x, i: F.when(i == step, drill(x, rest, f)).otherwise(x))


def deep(value: Column, path: list[str | int]) -> Column:
    """One step of indexing per item of the path."""
    for step in path:
        value = value.getField(step) if isinstance(step, str) else F.get(value, F.lit(step))
    return value


def map_through(d: DataFrame, values: DataFrame, pos: str = POS) -> DataFrame:
    """A dictionary of positions (k, v) with each replaced by the value at it; keys stay, in lists, in order."""
    got = d.select("k", F.col("v").alias("_i"), F.col(pos).alias("_p")).join(values.select(F.col(pos).alias("_i"), F.col("v")), "_i")
    return got.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "v"))), lambda s: s["v"]).alias("v"), F.min("_p").alias(pos))


def flip(df: DataFrame, pos: str = POS) -> DataFrame:
    """P24 on a table: a dictionary from column names to lists, as rows (k, v); columns must share a type."""
    names = columns_of(df)
    kinds = {df.schema[n].dataType.simpleString() for n in names}
    if len(kinds) > 1:
        raise EngineError("type", "columns of several types flip into a variant list: cast them first")
    long = df.select(F.col(pos).alias("_p"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("k"), F.col(n).alias("v")) for i, n in enumerate(names)])).alias("e")).select("_p", "e.*")
    return long.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "v"))), lambda s: s["v"]).alias("v"), F.first("i").cast("bigint").alias(pos))


def transpose(m: DataFrame) -> DataFrame:
    """P24 on a matrix in long form (i, j, v)."""
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def keys(df: DataFrame) -> list[str]:
    """P25: the names of a table."""
    return columns_of(df)


def tally(df: DataFrame) -> DataFrame:
    """The number of rows, as a one-row table."""
    return df.agg(F.count("*").alias("n"))


def shape(df: DataFrame, name: str) -> tuple[int, ...]:
    """(rows, length of the cells) of an array column, (rows,) where lengths differ."""
    got = df.agg(F.count("*").alias("n"), F.min(F.size(name)).alias("lo"), F.max(F.size(name)).alias("hi")).first()
    return (got["n"], got["lo"]) if got["lo"] == got["hi"] and got["n"] else (got["n"],)


def types(df: DataFrame) -> dict[str, str]:
    """Each column's type symbol, as vectors."""
    return {f.name: type_symbol(f.dataType).upper() for f in df.schema if f.name != POS}


def match(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables are identical: names, types, rows and their positions."""
    if [(f.name, f.dataType) for f in left.schema] != [(f.name, f.dataType) for f in right.schema]:
        return False
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def insert(df: DataFrame, row: dict, pos: str = POS) -> DataFrame:
    """A row appended; every column is required and types are strict."""
    names = columns_of(df)
    if set(row) != set(names):
        raise EngineError("length", f"columns are {names}")
    new = df.sparkSession.createDataFrame([tuple(row[n] for n in names)], names)
    for n in names:
        got, want = type_symbol(new.schema[n].dataType), type_symbol(df.schema[n].dataType)
        if got != want and {got, want} not in ({"n", "i"}, {"d", "f"}):
            raise EngineError("type", n)
    new = new.select(*[F.col(n).cast(df.schema[n].dataType) for n in names], F.lit(df.count()).cast("bigint").alias(pos))
    return df.unionByName(new)


def check_kinds(left: DataFrame, right: DataFrame) -> None:
    same_kinds(left, right, [c for c in columns_of(left) if c in right.columns])
