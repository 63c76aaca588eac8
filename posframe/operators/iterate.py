"""Bounded iteration: n times, while, until nothing changes; tree depth; closures.

Over tables the driver loops and only decides whether to go on; the rows stay where they are, and every few rounds a
checkpoint cuts the plan. Over cells a fold of a sequence does it inside one expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import POS, EngineError
from ..plans.lineage import checkpointed

EVERY = 8


def n_do(df: DataFrame, n: int, f: Callable[[DataFrame], DataFrame], every: int = EVERY) -> DataFrame:
    """H4: f applied n times."""
    for i in range(n):
        df = f(df)
        if (i + 1) % every == 0 and i + 1 < n:
            df = checkpointed(df)
    return df


def while_do(df: DataFrame, condition: Callable[[DataFrame], bool], f: Callable[[DataFrame], DataFrame], limit: int = 10_000) -> DataFrame:
    """H5: f applied as long as the condition holds of the table."""
    for _ in range(limit):
        if not condition(df):
            return df
        df = checkpointed(f(df))
    raise EngineError("limit", f"{limit} rounds")


def converge(df: DataFrame, f: Callable[[DataFrame], DataFrame], same: Callable[[DataFrame, DataFrame], bool] | None = None, limit: int = 10_000) -> DataFrame:
    """H6, K8: f applied until the table stays as it was; `same` may compare by a tolerance."""
    same = same or (lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())
    for _ in range(limit):
        new = checkpointed(f(df))
        if same(df, new):
            return new
        df = new
    raise EngineError("limit", f"{limit} rounds")


def within_tolerance(key: str, value: str, tolerance: float) -> Callable[[DataFrame, DataFrame], bool]:
    """K8: a comparison for converge: no value further than the tolerance from its last one."""

    def same(old: DataFrame, new: DataFrame) -> bool:
        pairs = old.select(F.col(key).alias("_k"), F.col(value).alias("_v")).join(new, F.col("_k") == F.col(key))
        return (pairs.agg(F.max(F.abs(F.col("_v") - F.col(value)))).first()[0] or 0.0) <= tolerance

    return same


def n_do_cell(x: Column, n: Column | int, f: Callable[[Column], Column]) -> Column:
    """H4 on a cell."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), x, lambda acc, _: f(acc))).otherwise(x)


def states_cell(x: Column, f: Callable[[Column], Column], go_on: Callable[[Column], Column], limit: int) -> Column:
    """H4..H6 on a cell: x and all further states while go_on(state) holds, limit of them at most."""
    step = lambda acc, _: F.when(go_on(F.element_at(acc, -1)), F.concat(acc, F.array(f(F.element_at(acc, -1))))).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(1), F.lit(limit)), F.array(x), step)


def depth(parents: DataFrame, pos: str = POS, parent: str = "v", out: str = "depth") -> DataFrame:
    """A5: each node's depth from a vector of parents. A parent that is negative, the node itself or no node makes a root.

    Pointers are doubled: after k rounds every node knows its ancestor 2^k steps up, so the rounds are the logarithm of
    the depth. A depth beyond the number of nodes means a cycle, a domain error.
    """
    known = parents.select(F.col(pos).alias("_id"))
    ups = parents.join(known, F.col(parent) == F.col("_id"), "left").select(F.col(pos).alias("n"), F.when((F.col("_id") == F.col(pos)) | (F.col("_id") < 0), None).otherwise(F.col("_id")).alias("up"))
    state = checkpointed(ups.select("n", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("d")))
    nodes = state.count()
    while True:
        left = state.filter("up is not null")
        if left.isEmpty():
            return state.select(F.col("n").alias(pos), F.col("d").alias(out))
        higher = state.select(F.col("n").alias("_n"), F.col("up").alias("_up"), F.col("d").alias("_d"))
        moved = left.join(higher, F.col("up") == F.col("_n")).select("n", F.col("_up").alias("up"), (F.col("d") + F.col("_d")).alias("d"))
        state = checkpointed(state.filter("up is null").unionByName(moved))
        if state.agg(F.max("d")).first()[0] > nodes:  # longer than any path without a cycle
            raise EngineError("domain", "cycle")


def closure(edges: DataFrame, start: DataFrame, limit: int = 10_000) -> DataFrame:
    """All nodes (n) that edges (a, b) reach from the start nodes (n), the start among them; breadth first.

    Each frontier is written once; every EVERY rounds those seen so far become one table.
    """
    seen = frontier = checkpointed(start.select("n").distinct())
    for i in range(limit):
        step = frontier.join(edges, F.col("n") == F.col("a")).select(F.col("b").alias("n")).distinct()
        frontier = checkpointed(step.join(seen, "n", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if (i + 1) % EVERY == 0:
            seen = checkpointed(seen)
    raise EngineError("limit", f"{limit} rounds")
