"""Cutting a plan's lineage with reliable checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark import SparkContext
from pyspark.sql import DataFrame

_known: set[str] = set()


def _drop(context: SparkContext, path: str) -> None:
    """Remove this application's checkpoints; where its JVM has gone first, they stay for the folder's own retention."""
    try:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        return


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the session's checkpoint folder until the driver ends.

    The folder is what spark.checkpoint.dir names; only a local master may go without it.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="posframe-checkpoint-")
        atexit.register(shutil.rmtree, path, True)
        context.setCheckpointDir(path)
    own = context._jsc.sc().getCheckpointDir().get()  # a folder of this application alone, below the one that is set
    if own not in _known:
        _known.add(own)
        atexit.register(_drop, context, own)
    return df.checkpoint(eager=True)
