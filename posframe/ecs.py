"""Entities as rows of a table: spawn, despawn, query, and systems that are functions of tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import POS, EngineError, Keyed
from .operators import join


@dataclass(frozen=True)
class World:
    """A table of entities and the name of its id column; every change gives a new world."""

    df: DataFrame
    id: str

    def spawn(self, entities: DataFrame) -> World:
        """Entities added; they must have the table's columns and types."""
        if sorted(entities.columns) != sorted(self.df.columns):
            raise EngineError("length", f"columns are {self.df.columns}")
        return World(self.df.unionByName(entities), self.id)

    def despawn(self, condition: Column) -> World:
        """Without the entities for which the condition holds."""
        return World(self.df.filter(~F.coalesce(condition, F.lit(False))), self.id)

    def where(self, condition: Column) -> World:
        return World(self.df.filter(condition), self.id)

    def get(self, *columns: str) -> DataFrame:
        return self.df.select(*columns)

    def count(self, condition: Column | None = None) -> int:
        return (self.df if condition is None else self.df.filter(condition)).count()

    def tick(self, *systems: Callable[[DataFrame], DataFrame]) -> World:
        """The systems applied from left to right: one plan, however many there are."""
        df = self.df
        for system in systems:
            df = df.transform(system)
        return World(df, self.id)

    def put(self, rows: DataFrame) -> World:
        """Keyed spawn: replaced by id where it exists, added where not."""
        pos = POS if POS in self.df.columns else "_none"
        return World(join.upsert(Keyed(self.df, self.id), Keyed(rows, self.id), pos).df, self.id)

    def remove(self, *ids) -> World:
        """Keyed despawn."""
        return World(self.df.filter(~self.df[self.id].isin(*ids)), self.id)

    def one(self, id_) -> dict | None:
        """Keyed get: an entity, or None."""
        found = self.df.filter(self.df[self.id] == id_).head(1)
        return found[0].asDict() if found else None
