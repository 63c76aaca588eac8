"""A terse array language over tables: lexer, parser, values and evaluation.

    s = Session(spark)
    s.table("t", df, pos="event_id")
    s("(+/)'t.value@=t.event_type")

Small values live on the driver as Python objects. A table's columns are lazy: an expression over a column is a column
expression of the table's plan, and groups, positions and grades stay descriptions until a verb says what is wanted of
them, so that `(+/)'v@=k` is one grouped sum and `k#>v` one top-k.
"""

from .session import Session
from .values import Dict, Sym

__all__ = ["Dict", "Session", "Sym"]
