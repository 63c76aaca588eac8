"""Ordered array analytics on Spark DataFrames.

Tables, vectors and dictionaries are DataFrames whose rows carry a position; operators take and give DataFrames and leave
the physical plan to Catalyst. See README.md for the map of the package.
"""

from .model import POS, EngineError, Keyed, dct, keyed, vec

__all__ = ["POS", "EngineError", "Keyed", "dct", "keyed", "vec"]
