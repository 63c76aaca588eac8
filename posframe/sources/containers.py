"""Binary containers read on the executors: archives, tensors, attribute tables and shapes, serialised values.

Each file is read whole by one task (`binaryFile`) and parsed there; its rows leave in Arrow batches.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _each_file(parse, schema: str, types: list[tuple[str, pa.DataType]]):
    """A function for mapInArrow that parses one file at a time into rows (dicts), in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[dict] = []
                for row in parse(path, content.as_py()):
                    rows.append(row)
                    if len(rows) == 1024:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(types))
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(types))

    return run, schema


def zip_list(spark: SparkSession, path: str) -> DataFrame:
    """The entries of archives: path, name, size, compressed, crc."""

    def parse(p: str, content: bytes) -> Iterator[dict]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for e in z.infolist():
                yield {"path": p, "name": e.filename, "size": e.file_size, "compressed": e.compress_size, "crc": e.CRC}

    run, schema = _each_file(parse, "path string, name string, size bigint, compressed bigint, crc bigint", [("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("compressed", pa.int64()), ("crc", pa.int64())])
    return _files(spark, path).mapInArrow(run, schema)


def zip_read(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The contents of an archive's entries (or of one): path, name, content."""

    def parse(p: str, content: bytes) -> Iterator[dict]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for e in z.infolist():
                if not e.is_dir() and name in (None, e.filename):
                    yield {"path": p, "name": e.filename, "content": z.read(e)}

    run, schema = _each_file(parse, "path string, name string, content binary", [("path", pa.string()), ("name", pa.string()), ("content", pa.binary())])
    return _files(spark, path).mapInArrow(run, schema)


def zip_write(entries: dict[str, bytes], path: str) -> None:
    """An archive from driver values."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in entries.items():
            z.writestr(name, content)


_SAFE = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "u1"}


def read_safetensors(spark: SparkSession, path: str) -> DataFrame:
    """The tensors of files: path, name, dtype, shape, data; half-width floats are widened."""

    def parse(p: str, content: bytes) -> Iterator[dict]:
        size = struct.unpack_from("<Q", content)[0]
        header, base = json.loads(content[8 : 8 + size]), 8 + size
        for name, t in header.items():
            if name == "__metadata__":
                continue
            start, end = (base + x for x in t["data_offsets"])
            if t["dtype"] == "BF16":
                data = (np.frombuffer(content[start:end], "<u2").astype(np.uint32) << 16).view(np.float32)
            else:
                data = np.frombuffer(content[start:end], _SAFE[t["dtype"]])
            yield {"path": p, "name": name, "dtype": t["dtype"], "shape": t["shape"], "data": data.astype(float).tolist()}

    run, schema = _each_file(parse, "path string, name string, dtype string, shape array<bigint>, data array<double>", [("path", pa.string()), ("name", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("data", pa.list_(pa.float64()))])
    return _files(spark, path).mapInArrow(run, schema)


def read_dbf(spark: SparkSession, path: str) -> DataFrame:
    """The records of attribute tables: path, record, and a map from field names to trimmed text (cast as needed)."""

    def parse(p: str, content: bytes) -> Iterator[dict]:
        count, header, width = struct.unpack_from("<IHH", content, 4)
        fields, at = [], 32
        while content[at] != 0x0D:
            fields.append((content[at : at + 11].split(b"\0")[0].decode("latin-1"), content[at + 16]))
            at += 32
        for i in range(count):
            record = content[header + i * width : header + (i + 1) * width]
            if record[:1] == b"*":  # deleted
                continue
            values, at = {}, 1
            for name, size in fields:
                values[name] = record[at : at + size].decode("latin-1").strip()
                at += size
            yield {"path": p, "record": i, "fields": list(values.items())}

    run, schema = _each_file(parse, "path string, record bigint, fields map<string,string>", [("path", pa.string()), ("record", pa.int64()), ("fields", pa.map_(pa.string(), pa.string()))])
    return _files(spark, path).mapInArrow(run, schema)


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """The shapes of geometry files: path, record, kind, parts (starts of rings), xs, ys."""

    def parse(p: str, content: bytes) -> Iterator[dict]:
        at = 100
        while at + 8 <= len(content):
            number, words = struct.unpack_from(">II", content, at)
            at += 8
            kind = struct.unpack_from("<I", content, at)[0]
            parts, points = [], np.zeros((0, 2))
            if kind in (1, 11, 21):
                points = np.frombuffer(content, "<f8", 2, at + 4).reshape(1, 2)
            elif kind in (3, 5, 13, 15, 23, 25):
                n_parts, n = struct.unpack_from("<II", content, at + 36)
                parts = np.frombuffer(content, "<i4", n_parts, at + 44).tolist()
                points = np.frombuffer(content, "<f8", 2 * n, at + 44 + 4 * n_parts).reshape(n, 2)
            elif kind in (8, 18, 28):
                n = struct.unpack_from("<I", content, at + 36)[0]
                points = np.frombuffer(content, "<f8", 2 * n, at + 40).reshape(n, 2)
            yield {"path": p, "record": number - 1, "kind": kind, "parts": parts, "xs": points[:, 0].tolist(), "ys": points[:, 1].tolist()}
            at += 2 * words

    types = [("path", pa.string()), ("record", pa.int64()), ("kind", pa.int64()), ("parts", pa.list_(pa.int64())), ("xs", pa.list_(pa.float64())), ("ys", pa.list_(pa.float64()))]
    run, schema = _each_file(parse, "path string, record bigint, kind bigint, parts array<bigint>, xs array<double>, ys array<double>", types)
    return _files(spark, path).mapInArrow(run, schema)


def to_bytes(df: DataFrame) -> bytes:
    """A small table as bytes (an Arrow stream)."""
    table = df.toArrow()
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue()


def from_bytes(spark: SparkSession, content: bytes) -> DataFrame:
    """The table again."""
    return spark.createDataFrame(pa.ipc.open_stream(content).read_all())


def explode_tensor(tensors: DataFrame, name: str) -> DataFrame:
    """A two-dimensional tensor as (i, j, v)."""
    one = tensors.filter(F.col("name") == name).select(F.element_at("shape", -1).alias("w"), F.posexplode("data").alias("p", "v"))
    return one.select(F.expr("p div w").alias("i"), (F.col("p") % F.col("w")).alias("j"), "v")
