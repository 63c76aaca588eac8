"""Lines, bytes, tables of text formats, directories."""

from __future__ import annotations

import importlib
import os
import subprocess
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import POS, EngineError, columns_of
from ..operators.position import numbered

NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
INTEGER = r"[+-]?[0-9]+"


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(_pos, line) of text files, in the order of path and place.

    The files are split and read in parallel; a split's lines are numbered in it and splits are put in order.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    return numbered(lines, "_file", "_start", "_id").drop("_file", "_start", "_id")


def write_lines(df: DataFrame, path: str, line: str = "line", pos: str = POS, single: bool = False) -> None:
    """The lines in order, as a folder of part files, or as a single one."""
    ordered = df.orderBy(pos).select(line)
    (ordered.coalesce(1) if single else ordered).write.mode("overwrite").text(path)


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """S3: (path, length, content) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def write_bytes(content: bytes, path: str) -> None:
    """Bytes from the driver to a file of its own file system."""
    with open(path, "wb") as f:
        f.write(content)


def read_module(name: str):
    """A code module, by name."""
    return importlib.import_module(name)


def listing(spark: SparkSession, path: str, skip: Sequence[str] = (".git", "build", "node_modules", "target")) -> DataFrame:
    """(path, length, modified) of all files below a folder, without those in build folders; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    for folder in skip:
        files = files.filter(~F.contains("path", F.lit(f"/{folder}/")))
    return files


def read_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A CSV file by the rules of array languages.

    Cells are split at every separator, without quoting, and trimmed. The first line is a header where none of its cells is
    a number, else columns are c0, c1, ... A column is int where all cells are ints that fit 32 bits, float where all are
    numbers, else string; one empty cell makes it string. Types take one aggregate over the file.
    """
    first = spark.read.text(path).head(1)
    if not first:
        raise EngineError("length", f"{path} is empty")
    head = [x.strip() for x in first[0][0].split(separator)]
    import re

    named = not any(re.fullmatch(NUMBER, x) for x in head)
    names = head if named else [f"c{i}" for i in range(len(head))]
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])
    # a quote that occurs in no text turns quoting off
    raw = spark.read.schema(schema).option("sep", separator).option("quote", "\u0001").option("header", named).option("mode", "PERMISSIVE").option("nullValue", "\u0001").csv(path)
    cells = raw.select(*[F.trim(F.coalesce(F.col(f"_{i}"), F.lit(""))).alias(f"_{i}") for i in range(len(names))])
    fits = lambda c: F.regexp(c, F.lit(rf"^{INTEGER}$")) & c.try_cast("int").isNotNull()
    tests = [t for i in range(len(names)) for t in (F.bool_and(fits(F.col(f"_{i}"))).alias(f"i{i}"), F.bool_and(F.regexp(F.col(f"_{i}"), F.lit(rf"^{NUMBER}$"))).alias(f"f{i}"))]
    found = cells.agg(*tests).first()
    kinds = ["int" if found[f"i{i}"] else "float" if found[f"f{i}"] else "string" for i in range(len(names))]
    return cells.select(*[F.col(f"_{i}").cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds))])


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    """S8 written: a header and unquoted cells."""
    df.select(*columns_of(df)).write.mode("overwrite").option("sep", separator).option("header", True).option("quote", "").csv(path)


def read_parquet(spark: SparkSession, path: str, kinds: str = "wide") -> DataFrame:
    """A Parquet table. kinds="wide" keeps Parquet's types; "k32" narrows: ints to 32 bits (null where they do not
    fit), doubles to floats; nested columns are an error there."""
    df = spark.read.parquet(path)
    if kinds == "wide":
        return df
    out = []
    for f in df.schema:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise EngineError("nyi", f"nested column {f.name}")
        c: Column = F.col(f.name)
        if isinstance(f.dataType, T.LongType):
            c = c.try_cast("int")
        elif isinstance(f.dataType, T.DoubleType):
            c = c.cast("float")
        out.append(c.alias(f.name))
    return df.select(*out)


def with_row_index(spark: SparkSession, path: str) -> DataFrame:
    """A single Parquet file with _pos, the place of each row in it; no shuffle."""
    return spark.read.parquet(path).select("*", F.col("_metadata.row_index").alias(POS))


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """A JSON file as a table: an array of objects, or with lines an object per line. Give a schema to read it once."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """An object per line."""
    df.select(*columns_of(df)).write.mode("overwrite").json(path)


def execute(spark: SparkSession, *command: str) -> DataFrame:
    """The lines (_pos, line) that a program of the driver's machine writes; its failure is an error. No shell reads the command."""
    done = subprocess.run(command, capture_output=True, check=False)
    if done.returncode:
        raise EngineError("io", f"{command[0]}: {done.returncode}")
    return spark.createDataFrame(list(enumerate(done.stdout.decode().splitlines())), f"{POS} bigint, line string")


def environment(name: str) -> str | None:
    """A host setting."""
    return os.environ.get(name)
