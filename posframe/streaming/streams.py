"""Structured Streaming forms of message handlers, timers, connection hooks and mutable state.

The array language knows messages, timers and global state that handlers change; it has no event time. Handlers become
`foreachBatch`, a timer a processing-time trigger, hooks a query listener, state a keyed table or a state store. Windows
with watermarks, sessions and deduplication in a watermark are extensions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener


def listen(spark: SparkSession, path: str, schema: str | StructType, format_: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of the files that arrive in a folder."""
    reader = spark.readStream.format(format_).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def on_message(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, seconds: float | None = None) -> StreamingQuery:
    """A handler for each batch; with seconds, no sooner than that after the last one, without catching up."""
    writer: DataStreamWriter = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


class Hooks(StreamingQueryListener):
    """What to do when a query starts, and when it ends."""

    def __init__(self, opened: Callable[[str], None] | None = None, closed: Callable[[str, str | None], None] | None = None):
        self.opened, self.closed = opened, closed

    def onQueryStarted(self, event) -> None:
        if self.opened:
            self.opened(str(event.id))

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.closed:
            self.closed(str(event.id), event.exception)


class KeyedStore:
    """A keyed table on shared storage that batches are upserted into, in order.

    A batch writes only its own rows, the last of each key: a delta, named by the batch's number, so that a batch that is
    tried again replaces its own. The table is the newest row of each key over the base and the deltas since. Every EVERY
    batches they are merged into a new base, and what it replaces is removed one merge later, when no reader needs it.
    """

    EVERY = 16

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema
        self.columns = [f.name for f in StructType.fromDDL(schema).fields]

    def _folder(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _written(self, kind: str) -> list[int]:
        """The numbers of the folders of a kind that were written to their end."""
        path, system = self._folder()
        if not system.exists(path):
            return []
        names = [status.getPath().getName() for status in system.listStatus(path)]
        numbers = [int(n.removeprefix(kind)) for n in names if n.startswith(kind)]
        return sorted(n for n in numbers if system.exists(self._folder(f"{kind}{n}/_SUCCESS")[0]))

    def _newest(self, before: int | None = None, base_before: int | None = None) -> DataFrame:
        """(columns, _batch): the newest row of each key, of the batches and from a base before a number where one is given."""
        kept = lambda numbers, most: [n for n in numbers if most is None or n < most]
        base = kept(self._written("base-"), before if base_before is None else base_before)[-1:]
        folders = [f"base-{n}" for n in base] + [f"delta-{n}" for n in kept(self._written("delta-"), before) if not base or n > base[0]]
        schema = f"{self.schema}, _batch bigint"
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])
        if len(folders) == 1:
            return rows
        held = [F.col(c) for c in self.columns if c != self.key]
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*held, "_batch"), "_batch").alias("_r")).select(self.key, "_r.*")
        return newest.select(*self.columns, "_batch")

    def table(self, before: int | None = None) -> DataFrame:
        """The table as of the last batch (or of the last one before a batch)."""
        return self._newest(before).select(*self.columns)

    def upsert(self, batch: DataFrame, number: int, order: str) -> None:
        """The batch's rows by key, the last by `order` winning, put into the table: the handler for on_message."""
        held = [c for c in self.columns if c != self.key]
        rows = batch.groupBy(self.key).agg(F.max_by(F.struct(*held), order).alias("_r")).select(self.key, "_r.*")
        rows.select(*self.columns, F.lit(number).cast("bigint").alias("_batch")).write.mode("overwrite").parquet(f"{self.path}/delta-{number}")
        if (number + 1) % self.EVERY == 0:
            old = [n for n in self._written("base-") if n < number][-1:]
            self._newest(number + 1, number).write.mode("overwrite").parquet(f"{self.path}/base-{number}")
            for kind in ("delta-", "base-"):
                for n in self._written(kind):
                    if old and n < old[0]:
                        path, system = self._folder(f"{kind}{n}")
                        system.delete(path, True)


def running_state(stream: DataFrame, key: str, value: str, fold: Callable[[float, float], float], seed: float) -> DataFrame:
    """A fold per key that goes on from batch to batch: (key, state) for each key of a batch.

    The state is one number per key in the state store; a batch's rows of a key come in chunks.
    """

    def step(keys: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else seed
        for chunk in chunks:
            for v in chunk[value]:
                held = fold(held, float(v))
        state.update((held,))
        yield pd.DataFrame({key: [keys[0]], "state": [held]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, state double", "held double", "update", "NoTimeout")


def tumbling(stream: DataFrame, time: str, width: str, keys: Sequence[str], *aggregates: Column, late: str = "0 seconds", slide: str | None = None) -> DataFrame:
    """Extension: folds per window of event time; rows later than `late` are dropped by the watermark."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(window.alias("window"), *keys).agg(*aggregates)


def sessions(stream: DataFrame, time: str, gap: str, keys: Sequence[str], *aggregates: Column, late: str = "0 seconds") -> DataFrame:
    """Extension: folds per session, a session ending after a gap."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("window"), *keys).agg(*aggregates)


def once(stream: DataFrame, time: str, keys: Sequence[str], late: str) -> DataFrame:
    """Extension: the first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
