"""Spans of regular expressions with their places, in DataFrame functions only: for secrets and personal data.

A span is a struct (kind, start, end, match): code points, the end exclusive. Matches are leftmost and do not overlap;
their places follow from the lengths of the pieces between them, so each comes from the same matcher that found it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches whose places are added up together.
BLOCK = 128
SPANS = "array<struct<kind:int,start:int,end:int,match:string>>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value computed once, also inside the functions of array expressions, which else compute it at each call."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def found(text: Column, kind: int, pattern: str, guard: str | None = None, keep: Callable[[Column], Column] | None = None) -> Column:
    """Array of the spans of `pattern` in text for which keep(match) holds; a match that fails is not tried again inside.

    guard: a regular expression that every text with a match has, cheaper than the pattern; by default the pattern. Only
    texts that pass it are split. Places are added up in blocks of BLOCK matches, so that a text of very many matches does
    not copy all spans found so far at each of them.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match"))
    length = lambda piece: F.length(piece["gap"]) + F.coalesce(F.length(piece["match"]), F.lit(0))

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["gap"])
        end = start + F.coalesce(F.length(piece["match"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), piece["match"].alias("match"))
        taken = piece["match"].isNotNull() if keep is None else piece["match"].isNotNull() & keep(piece["match"])
        return F.struct(end.alias("at"), F.when(taken, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    def block(all_: Column, i: Column) -> Column:
        return F.slice(all_, i * BLOCK + 1, F.lit(BLOCK))

    def spans_of(all_: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

        def offset(state: Column, i: Column) -> Column:
            total = F.aggregate(block(all_, i), F.lit(0), lambda n, piece: n + length(piece))
            return F.struct((state["at"] + total).alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts"))

        starts = F.aggregate(blocks, first, offset, lambda state: state["starts"])
        in_block = lambda start, i: F.aggregate(block(all_, i), F.struct(start.alias("at"), no_spans().alias("spans")), step, lambda state: state["spans"])
        return F.flatten(F.transform(starts, in_block))

    return F.when(F.regexp(text, F.lit(guard or pattern)), let(pieces, spans_of)).otherwise(no_spans())


def apart(spans: Column, others: Column) -> Column:
    """Those of spans that overlap none of others.

    The others, sorted, stand in blocks as long as the root of their number; a span looks into the blocks that it reaches.
    """
    sorted_ = F.array_sort(F.transform(others, lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end"))))
    meet = lambda s, o: (s["start"] < o["end"]) & (o["start"] < s["end"])

    def blocks(all_: Column) -> Column:
        side = F.greatest(F.ceil(F.sqrt(F.size(all_))), F.lit(1)).cast("int")
        starts = F.filter(F.transform(all_, lambda o, i: i), lambda i: i % side == 0)
        parts = F.transform(starts, lambda i: F.slice(all_, i + 1, side))
        return F.transform(parts, lambda p: F.struct(F.get(p, F.lit(0))["start"].alias("start"), F.array_max(F.transform(p, lambda o: o["end"])).alias("end"), p.alias("part")))

    def free(reached: Column) -> Column:
        return F.filter(spans, lambda s: ~F.exists(reached, lambda b: meet(s, b) & F.exists(b["part"], lambda o: meet(s, o))))

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(let(sorted_, lambda all_: let(blocks(all_), free)))


def written(spans: Column, kinds: Sequence[str], by_start: bool) -> Column:
    """kind:start:end of each span, comma-joined, by start and then kind, or by kind and then start."""
    names = F.array(*map(F.lit, kinds))
    order = ("start", "kind", "end") if by_start else ("kind", "start", "end")
    placed = F.array_sort(F.transform(spans, lambda s: F.struct(*[s[k].alias(k) for k in order])))
    return F.array_join(F.transform(placed, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
