"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions.

Every source's documents stand in a queue in shuffled order, one queue behind the other for each repeat, and are served
in packets of PACKET words. A packet's virtual finish time is the cumulative count of its source's words, its own
included, divided by the source's target. The mix is all packets in the order of finish times (a range sort), cut where
their words reach the total budget: a packet before the cut is in, the one on the cut gives the words that are left, and
what follows is out. Packets keep one long document from holding back its source or handing its share to others: a source
ends within a packet of its target. Where whole documents are wanted (`mixed`), one is in if at least half of it is.

A source of a third of the corpus is no hot key: cumulative counts are taken in blocks of the shuffled order, and block
offsets come from block totals.

Defined results
---------------
* Null or empty text has no words: size 0, taken 0. Null source is a source of its own, after the others.
* Null ids and repeated rows are documents like any other; rows alike in all columns are interchangeable.
* An empty table gives an empty result; other columns are neither read nor in the way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, cut, fresh, text_of, word_count

BLOCK_ROWS, RANGE_ROWS, PACKET = 50_000, 200_000, 128


def targets(sources: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(source, source_size) -> these and target, the words the mix should take of each source.

    Weights are dealt to the sources by code point, null last, over and over. A target stops at `repeats` times the
    source's size and what is above is shared again by weight: in the order of size by weight, sources fill up one after
    another, and the first that does not fill sets the level of all that follow. One row per source: the windows without
    partition see the sources, never the documents.
    """
    everything = W.partitionBy()
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    filling = W.orderBy("fills_at", "rank").rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("most").over(filling), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0.0)))
    leveled = (
        ranked.withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * repeats)
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("fills_at", F.col("most") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("full", F.col("level") >= F.col("fills_at"))
    )
    common = F.min(F.when(~F.col("full"), F.struct("fills_at", "rank", "level"))).over(everything)
    return leveled.withColumn("common", common["level"]).select("source", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("common") * F.col("weight")).alias("target"))


def _queued(docs: DataFrame, names: dict[str, str], weights: Sequence[float], share: float, repeats: int, seed: int) -> tuple[DataFrame, float, int]:
    """(doc_id, source, place, size, source_size, target, upto), the budget in words, and about how many packets there are."""
    body = text_of(docs, names["text"])
    light = docs.select(docs[names["doc_id"]].alias("doc_id"), docs[names["source"]].alias("source"), F.xxhash64(F.lit(seed), docs[names["doc_id"]], body).alias("place"), word_count(body).alias("size"))
    light = cut(light, "sizes")
    rows = light.count()
    blocks = max(64, rows // BLOCK_ROWS)
    light = light.withColumn("block", F.floor((F.col("place") / F.lit(2.0**64) + 0.5) * blocks).cast("long"))
    totals = cut(light.groupBy("source", "block").agg(F.sum("size").alias("words")), "block-words")
    aims = targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, repeats)
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.withColumn("before", before).alias("o").join(aims.alias("a"), F.col("o.source").eqNullSafe(F.col("a.source")))
    offsets = cut(offsets.select(F.col("o.source").alias("of"), F.col("block").alias("at"), "before", "source_size", "target"), "offsets")
    within = F.sum("size").over(W.partitionBy("source", "block").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    placed = light.withColumn("within", within).join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    queued = cut(placed.select("doc_id", "source", "place", "size", "source_size", "target", (F.col("before") + F.col("within")).alias("upto")), "queued")
    total = totals.agg(F.sum("words")).first()[0] or 0
    return queued, total * share, total // PACKET + rows


def _packets() -> Column:
    """The numbers of a document's packets."""
    return F.sequence(F.lit(1), F.ceil(F.col("size") / PACKET).cast("int"))


def _turn(repeat: Column, packet: Column) -> Column:
    """Where a packet of a document's repeat stands in the mix."""
    served = F.least(packet.cast("long") * PACKET, F.col("size"))
    finish = (repeat * F.col("source_size") + F.col("upto") - F.col("size") + served) / F.col("target")
    return F.struct(finish.alias("finish"), F.col("place").alias("place"), F.col("doc_id").alias("id"), F.col("source").alias("source"), repeat.cast("int").alias("repeat"), packet.cast("int").alias("packet"))


def _words(packet: Column) -> Column:
    """The words of a packet."""
    return F.least(F.col("size") - (packet.cast("long") - 1) * PACKET, F.lit(PACKET).cast("long"))


def in_order(queued: DataFrame, rows: int, repeats: int) -> DataFrame:
    """Every packet of every repeat of all documents that have words, range-sorted by finish time: turn, words, part (the range)."""
    turns = queued.filter("size > 0 and target > 0").select("*", F.explode(_packets()).alias("packet"))
    turns = turns.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    turns = turns.select(_turn(F.col("repeat"), F.col("packet")).alias("turn"), _words(F.col("packet")).alias("words"))
    parts = max(8, rows * repeats // RANGE_ROWS)
    ranged = turns.repartitionByRange(parts, *[F.col(f"turn.{f}") for f in ("finish", "place", "id", "source", "repeat", "packet")])
    return cut(ranged.withColumn("part", F.spark_partition_id()), "in-order")


def _end(ordered: DataFrame, budget: float):
    """(turn, left): the first packet that the budget does not hold whole, and the words that are left for it; None where it holds all.

    Range totals say in which range the budget ends; only that range's rows are then added up one by one.
    """
    upto = F.sum("words").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0))
    totals = ordered.groupBy("part").agg(F.sum("words").alias("words")).withColumn("upto", upto)
    broken = totals.filter(F.col("upto") > budget).agg(F.min(F.struct("upto", "words", "part"))).first()[0]
    if broken is None:
        return None
    running = F.sum("words").over(W.partitionBy("part").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)) + (broken["upto"] - broken["words"])
    inside = ordered.filter(F.col("part") == broken["part"]).withColumn("upto", running).filter(F.col("upto") > budget)
    first = inside.agg(F.min(F.struct("turn", "upto", "words"))).first()[0]
    return first["turn"], int(budget - (first["upto"] - first["words"]))


def planned(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, source, place (its random place), size, source_size, target, taken, times.

    taken: the words that the mix takes, repeats counted; times: how often it takes the document as a whole.
    """
    queued, budget, rows = _queued(docs, {"doc_id": doc_id, "text": text, "source": source}, weights, share, repeats, seed)
    end = _end(in_order(queued, rows, repeats), budget)
    served = (F.col("size") > 0) & (F.col("target") > 0)

    def words_of(repeat: Column) -> Column:
        """The words of a document's repeat that come before the cut."""
        if end is None:
            return F.col("size")
        turn, left = end
        kinds = {"finish": "double", "place": "long", "id": queued.schema["doc_id"].dataType, "source": queued.schema["source"].dataType, "repeat": "int", "packet": "int"}
        last = F.struct(*[F.lit(turn[f]).cast(kind).alias(f) for f, kind in kinds.items()])
        whole = F.size(F.filter(_packets(), lambda p: _turn(repeat, p) < last))
        here = F.exists(_packets(), lambda p: _turn(repeat, p) == last)
        return F.least(whole.cast("long") * PACKET, F.col("size")) + F.when(here, left).otherwise(0)

    words = [F.when(served, words_of(F.lit(r))).otherwise(0) for r in range(repeats)]
    taken = sum(words[1:], words[0])
    times = sum([F.when(served & (w * 2 >= F.col("size")), 1).otherwise(0) for w in words], F.lit(0))
    return queued.select("doc_id", "source", "place", "size", "source_size", "target", taken.cast("long").alias("taken"), times.cast("int").alias("times"))


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes them, all columns as they are.

    A source's documents are taken in the order of their places, so that the last one of each repeat tells all others: a
    row per source goes to the documents, and no text moves.
    """
    plan = planned(docs, weights, share, repeats, seed, doc_id, text, source)
    key, lasts = fresh(docs, "mix_source", "mix_lasts")
    last = [F.max(F.when(F.col("times") > r, F.struct("place", "doc_id"))) for r in range(repeats)]
    ends = cut(plan.filter("times > 0").groupBy(F.col("source").alias(key)).agg(F.array(*last).alias(lasts)), "ends")
    body = text_of(docs, text)
    own = F.struct(F.xxhash64(F.lit(seed), docs[doc_id], body).alias("place"), docs[doc_id].alias("doc_id"))
    times = F.size(F.filter(lasts, lambda end: own <= end))
    taken = docs.join(ends, docs[source].eqNullSafe(ends[key])).filter(body.rlike(WORD))
    return taken.withColumn(lasts, F.explode(F.array_repeat(F.lit(0), times))).select(*[docs[c] for c in docs.columns])
