"""Lookup joins, upserts, membership, and joins by condition.

Join strategies are left to Catalyst and adaptive execution: a small side is broadcast by its measured size, a skewed key is
split; nothing here forces a broadcast. `within` alone asks for a merge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import POS, EngineError, Keyed, columns_of, same_kinds, zero_of
from ..plans.lineage import checkpointed


def _first_of(k: DataFrame, key: str, pos: str) -> DataFrame:
    """One row per key, the first by position, or without positions the least one; merged before the shuffle."""
    rest = [c for c in columns_of(k) if c != key]
    row = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_none"))
    picked = F.min_by(row, pos) if pos in k.columns else F.min(row)
    return k.groupBy(key).agg(picked.alias("_row"))


def left_lookup(t: DataFrame, k: Keyed, fill: str = "zero", pos: str = POS) -> DataFrame:
    """Every row of t once, in its order, with the columns of the first row of k that has its key.

    A shared column takes k's value where matched and keeps t's otherwise; a column of k alone is filled with its type's
    zero (fill="zero") or null (fill="null"). The match is a flag of its own: a matched null stays null.
    """
    if k.key not in t.columns:
        raise EngineError("length", f"no column {k.key}")
    shared = [c for c in k.values if c in t.columns]
    same_kinds(t, k.df, [k.key, *shared])
    right = _first_of(k.df, k.key, pos).select(F.col(k.key).alias("_key"), "_row", F.lit(True).alias("_hit"))
    joined = t.join(right, F.col(k.key) == F.col("_key"), "left")
    hit = F.coalesce("_hit", F.lit(False))
    new = []
    for c in k.values:
        value = F.col("_row").getField(c)
        other = F.col(c) if c in t.columns else zero_of(k.df.schema[c].dataType) if fill == "zero" else F.lit(None).cast(k.df.schema[c].dataType)
        new.append((c, F.when(hit, value).otherwise(other)))
    return joined.withColumns(dict(new)).drop("_key", "_row", "_hit")


def upsert(k1: Keyed, k2: Keyed, pos: str = POS) -> Keyed:
    """k2's rows put into k1 by key: replaced where the key exists, appended after k1's rows where not.

    Columns that only k2 has are dropped; k2 must have all value columns of k1, or only replace what it has where no row
    is appended. Of equal keys in k2 the last wins, or without positions the greatest row.
    """
    if k1.key != k2.key:
        raise EngineError("length", "keys differ")
    shared = [c for c in k1.values if c in k2.values]
    same_kinds(k1.df, k2.df, [k1.key, *shared])
    ordered = pos in k1.df.columns and pos in k2.df.columns
    row = F.struct(*[F.col(c) for c in shared], *([F.col(pos)] if ordered else []), F.lit(True).alias("_in"))
    right = k2.df.groupBy(F.col(k2.key).alias("_key")).agg((F.max_by(row, pos) if ordered else F.max(row)).alias("_new"), *([F.min(pos).alias("_first")] if ordered else []))
    joined = k1.df.withColumn("_old", F.lit(True)).join(right, F.col(k1.key) == F.col("_key"), "full")
    fresh = F.col("_old").isNull()
    if len(shared) < len(k1.values):
        missing = F.raise_error(F.lit("!length")).cast("boolean")
        joined = joined.filter(~fresh | missing)
    out = joined.withColumns({c: F.when(F.col("_new").isNotNull(), F.col("_new").getField(c)).otherwise(F.col(c)) for c in shared}).withColumn(k1.key, F.coalesce(k1.key, "_key"))
    if ordered:
        n = k1.df.count()
        out = out.withColumn(pos, F.coalesce(F.col(pos), F.col("_first") + n))
    return Keyed(out.select(*k1.df.columns), k1.key)


def merge(left: DataFrame, right: DataFrame, pos: str = POS) -> DataFrame:
    """Dictionaries (k, v, _pos) merged: the right's values win, the left's order stays, new keys follow."""
    return upsert(Keyed(left, "k"), Keyed(right, "k"), pos).df


def lookup_default(t: DataFrame, name: str, k: Keyed, value: str, default, out: str, pos: str = POS) -> DataFrame:
    """T with `out`, k's value for its key, or the default."""
    right = _first_of(k.df.select(k.key, value, *([pos] if pos in k.df.columns else [])), k.key, pos).select(F.col(k.key).alias("_key"), F.col("_row").getField(value).alias("_value"))
    return t.join(right, F.col(name) == F.col("_key"), "left").withColumn(out, F.coalesce("_value", F.lit(default))).drop("_key", "_value")


def semi(t: DataFrame, name: str, values: DataFrame, value: str) -> DataFrame:
    """The rows whose value is among the others; duplicates and order stay."""
    return t.join(values.select(F.col(value).alias("_value")), F.col(name) == F.col("_value"), "left_semi")


def anti(t: DataFrame, name: str, values: DataFrame, value: str) -> DataFrame:
    """The rows whose value is not among the others; duplicates and order stay."""
    return t.join(values.select(F.col(value).alias("_value")), F.col(name) == F.col("_value"), "left_anti")


def equi(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Each row with all rows of its bucket."""
    return left.join(right, on)


def theta(left: DataFrame, right: DataFrame, equal: Sequence[Column], condition: Column) -> DataFrame:
    """The pairs for which a condition holds; the equalities among its parts, given apart, make it a hash or merge join."""
    on = condition
    for e in equal:
        on = e & on
    return left.join(right, on)


def within(left: DataFrame, right: DataFrame, x: str, y: str, radius: float) -> DataFrame:
    """Pairs of points at most `radius` apart, by grid cells: a point meets the nine cells about it, not all points.

    The left is copied to the three cells about it along x and the right to the three along y, so that a pair meets once.
    Sizes are estimated without the copies, so a side that is to be broadcast may be far too large for it: they are merged,
    which can spill. Both sides have columns x and y; the right's come back as r_<name>.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius))).cast("long")
    about = lambda c: F.explode(F.array(*[F.try_add(cell(c), F.lit(i)) for i in (-1, 0, 1)]))
    other = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    other = other.select("*", cell(f"r_{x}").alias("_cx"), about(f"r_{y}").alias("_cy"))
    spread = left.select("*", about(x).alias("_lx"), cell(y).alias("_ly"))
    square = (F.col(x) - F.col(f"r_{x}")) * (F.col(x) - F.col(f"r_{x}")) + (F.col(y) - F.col(f"r_{y}")) * (F.col(y) - F.col(f"r_{y}"))
    near = spread.hint("merge").join(other, (F.col("_lx") == F.col("_cx")) & (F.col("_ly") == F.col("_cy"))).withColumn("distance", F.sqrt(square))
    return near.filter(F.col("distance") <= radius).drop("_lx", "_ly", "_cx", "_cy")


def as_of(left: DataFrame, right: DataFrame, time: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Extension: each left row with the values of the latest right row of its keys at or before its time.

    The rows of both sides are ordered once, in ranges of (keys, time). A range finds the latest rows inside itself; what
    was last before it comes from the last right rows of the ranges, a few rows each, so a hot key is many ranges.
    """
    both = left.select("*", *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values], F.lit(1).alias("_side")).unionByName(
        right.select(*keys, time, *[F.col(v).alias(f"_{v}") for v in values], F.lit(0).alias("_side")), allowMissingColumns=True
    )
    ranged = checkpointed(both.repartitionByRange(*keys, time, "_side").withColumn("_range", F.spark_partition_id()))
    own = F.when(F.col("_side") == 0, F.struct(*[F.col(f"_{v}") for v in values]))
    upto = (W.unboundedPreceding, 0)
    inside = F.last(own, ignorenulls=True).over(W.partitionBy(*keys, "_range").orderBy(time, "_side").rowsBetween(*upto))
    ends = ranged.groupBy(*keys, "_range").agg(F.max_by(own, F.when(F.col("_side") == 0, F.col(time))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select(*[F.col(k).alias(f"_of_{i}") for i, k in enumerate(keys)], F.col("_range").alias("_of"), before.alias("_before"))
    met = F.col("_range") == F.col("_of")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_of_{i}"))
    out = ranged.withColumn("_row", inside).filter("_side = 1").join(ends, met, "left").withColumn("_row", F.coalesce("_row", "_before"))
    return out.select(*left.columns, *[F.col("_row").getField(f"_{v}").alias(v) for v in values])
