"""Helpers that every operator of the subpackage uses: cutting lineage, fresh column names, table access."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; what lies between is a word.
WORD = r"[^\x20\x09-\x0D]+"


@lru_cache(maxsize=1)
def _local_dir() -> str:
    """A folder of the driver alone, gone when it ends."""
    path = tempfile.mkdtemp(prefix="posframe-")
    atexit.register(shutil.rmtree, path, True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one, which only a local master may use."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_dir()


#: Bounds of an Arrow batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session's executors, once per application.

    Batches are bounded by bytes as well as by rows from then on, in the whole session: a batch of 10,000 texts of any
    length, which is the default, would be held by the JVM and the worker at once.
    """
    _ship(spark.sparkContext.applicationId, spark.sparkContext)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        size = re.match(r"\d+$", now or "")
        if size is None or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


_shipped: set[str] = set()


def _ship(application: str, context) -> None:
    if application in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    context.addPyFile(shutil.make_archive(f"{_local_dir()}/{application}/{package.name}", "zip", package.parent, package.name))
    _shipped.add(application)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, whose worker gives its free memory back to the system when a task ends.

    Workers wait for further tasks beside the executor's JVM, of this stage or any other, with all the memory that they
    have not given back.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


_cutting: set[str] = set()


def _own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/posframe/{spark.sparkContext.applicationId}"
    if path not in _cutting:
        _cutting.add(path)
        atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)
    except Exception:  # the JVM has gone first: the folder's own retention takes over
        shutil.rmtree(re.sub("^file:(//)?", "", path), True)


def clean(spark: SparkSession) -> None:
    """Drop all tables that this application has cut so far; results not yet written can no longer be computed."""
    _drop(spark, _own_dir(spark))


#: The tables (name, path) that the innermost `scratch` of this thread has to drop.
_written: ContextVar[list[tuple[str, str]] | None] = ContextVar("written", default=None)


@contextmanager
def scratch(spark: SparkSession, *kept: str) -> Iterator[None]:
    """What is cut inside goes at the end, but the tables named; those are left to the scratch around, if any.

    Nothing that reads the others may be used later. The JVM is asked to collect its garbage, since Spark removes the
    shuffle files of a finished plan when the plan is collected, which a driver of much memory puts off.
    """
    token = _written.set([])
    try:
        yield
        written = _written.get()
    finally:
        _written.reset(token)
    for name, path in written:
        if name not in kept:
            _drop(spark, path)
        elif (around := _written.get()) is not None:
            around.append((name, path))
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    The plan that follows starts at replicated files: a lost executor costs no recomputation of what came before, and
    later joins see a true size. The files live until the application ends, or until `clean`, or the `scratch` about it does.
    """
    path = f"{_own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (written := _written.get()) is not None:
        written.append((name, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores put before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, text: str = "text") -> Column:
    """The text column, null as the empty text."""
    return F.coalesce(df[text], F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that `decided` (doc_id, mark, kept: a row for each row of docs) keeps, all columns as they are.

    mark is xxhash64 of the text, null as empty: rows that share an id but not a text have decisions of their own. Rows
    that share both are one document, of which one stays. Only ids and marks are gathered; texts move at most once.
    """
    decided = cut(decided, "decided")
    key, mark, count = fresh(docs, "kept_id", "kept_mark", "kept_n")
    own = F.xxhash64(text_of(docs, text))
    named = decided.select(F.col("doc_id").alias(key), F.col("mark").alias(mark), "kept")
    going = cut(named.filter(~F.col("kept")).select(key, mark).distinct(), "going")
    stays = docs.join(going, docs[id_col].eqNullSafe(going[key]) & (own == going[mark]), "left_anti")
    again = cut(named.filter("kept").groupBy(key, mark).agg(F.count("*").alias(count)).filter(F.col(count) > 1), "again")
    if again.isEmpty():
        return stays
    repeats = stays[id_col].eqNullSafe(again[key]) & (own == again[mark])
    once = stays.join(again, repeats, "left_semi").dropDuplicates([id_col, text])
    return stays.join(again, repeats, "left_anti").unionByName(once)
