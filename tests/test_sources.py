"""Readers, writers, generators and streams, against files made here."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from posframe import EngineError
from posframe.sources import containers, files, generate
from posframe.streaming import streams


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_lines_keep_their_order(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("".join(f"line {i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = files.read_lines(spark, str(path)).orderBy("_pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["_pos"], r["line"]) for r in got] == [(i, f"line {i}") for i in range(5000)]
    files.write_lines(files.read_lines(spark, str(path)), str(tmp_path / "out"), single=True)
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_text() == path.read_text()


def test_bytes_and_listing(spark, tmp_path):
    files.write_bytes(b"\x00\x01", str(tmp_path / "x.bin"))
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "y.bin").write_bytes(b"y")
    assert bytes(files.read_bytes(spark, str(tmp_path / "x.bin")).first()["content"]) == b"\x00\x01"
    assert files.listing(spark, str(tmp_path)).count() == 1


@pytest.mark.parametrize(
    "content, dtypes, first",
    [
        ("name,age\nAlice,23\nBob,47\n", [("name", "string"), ("age", "int")], ("Alice", 23)),
        ("1,2.5\n3,4\n", [("c0", "int"), ("c1", "float")], (1, 2.5)),
        ("a,b\n1, x \n,y\n", [("a", "string"), ("b", "string")], ("", "y")),
        ('a,b\n"q,1\n', [("a", "string"), ("b", "int")], ('"q', 1)),
        ("a,b\n3000000000,1e3\n", [("a", "float"), ("b", "float")], (3e9, 1000.0)),
    ],
)
def test_csv_rules(spark, tmp_path, content, dtypes, first):
    path = tmp_path / "t.csv"
    path.write_text(content)
    df = files.read_csv(spark, str(path))
    assert df.dtypes == dtypes and rows(df, df.columns[0])[0] == first


def test_parquet_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, 5_000_000_000, 1.5), (2, 7, 2.5)], "a int, b bigint, c double")
    df.write.parquet(str(tmp_path / "p"))
    narrow = files.read_parquet(spark, str(tmp_path / "p"), "k32")
    assert narrow.dtypes == [("a", "int"), ("b", "int"), ("c", "float")] and rows(narrow, "a") == [(1, None, 1.5), (2, 7, 2.5)]
    df.select(F.array("a").alias("x")).write.parquet(str(tmp_path / "n"))
    with pytest.raises(EngineError):
        files.read_parquet(spark, str(tmp_path / "n"), "k32")
    (tmp_path / "j.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]))
    assert rows(files.read_json(spark, str(tmp_path / "j.json")), "a") == [(1, "x"), (2, "y")]
    files.write_json(df, str(tmp_path / "jl"))
    assert files.read_json(spark, str(tmp_path / "jl"), lines=True).count() == 2
    one = tmp_path / "one"
    df.coalesce(1).write.parquet(str(one))
    assert rows(files.with_row_index(spark, str(one)).select("_pos", "a"), "_pos") == [(0, 1), (1, 2)]


def test_generators(spark):
    assert rows(generate.odometer(spark, 2, 3), "_pos") == [(i, i // 3, i % 3) for i in range(6)]
    assert [r["v"] for r in generate.unit(spark, 3).orderBy("_pos").collect()] == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    assert generate.iota(spark, 4).count() == 4
    u = [r["v"] for r in generate.uniform(spark, 1000, 3).collect()]
    assert all(0 <= x < 1 for x in u) and 0.45 < sum(u) / 1000 < 0.55
    assert sorted(r["v"] for r in generate.deal(spark, 10, 10).collect()) == list(range(10))
    assert len({r["v"] for r in generate.deal(spark, 5, 100).collect()}) == 5
    assert all(0 <= r["v"] < 6 for r in generate.roll(spark, 100, 6).collect())
    with pytest.raises(EngineError):
        generate.deal(spark, 11, 10)
    with pytest.raises(EngineError):
        generate.literal(spark, {"a": [1], "b": [1, 2]})
    assert generate.fetch(generate.literal(spark, {"a": [3, 1]})) == {"a": [3, 1]}


def test_archives(spark, tmp_path):
    path = str(tmp_path / "a.zip")
    containers.zip_write({"x.txt": b"hello", "d/y.txt": b"yy"}, path)
    assert [r["name"] for r in containers.zip_list(spark, path).orderBy("name").collect()] == ["d/y.txt", "x.txt"]
    assert containers.zip_list(spark, path).filter("name = 'x.txt'").first()["crc"] == zlib.crc32(b"hello")
    assert bytes(containers.zip_read(spark, path, "d/y.txt").first()["content"]) == b"yy"


def test_tensors(spark, tmp_path):
    a, b = np.array([[1, 2, 3], [4, 5, 6]], "<f4"), np.array([1.0, -2.0], "<f4")
    half = (b.view(np.uint32) >> 16).astype("<u2")
    header = json.dumps({"a": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}, "b": {"dtype": "BF16", "shape": [2], "data_offsets": [24, 28]}}).encode()
    (tmp_path / "t.safetensors").write_bytes(struct.pack("<Q", len(header)) + header + a.tobytes() + half.tobytes())
    got = containers.read_safetensors(spark, str(tmp_path / "t.safetensors"))
    assert {r["name"]: (r["shape"], r["data"]) for r in got.collect()} == {"a": ([2, 3], [1, 2, 3, 4, 5, 6]), "b": ([2], [1.0, -2.0])}
    assert rows(containers.explode_tensor(got, "a"), "i", "j")[4] == (1, 1, 5.0)


def test_geometry(spark, tmp_path):
    fields = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([5, 0]) + bytes(14)
    dbf = struct.pack("<BBBBIHH", 3, 0, 0, 0, 2, 32 + 32 + 1, 6) + bytes(20) + fields + b"\r" + b" " + b"ab   " + b"*" + b"zz   "
    (tmp_path / "t.dbf").write_bytes(dbf)
    assert [r["fields"] for r in containers.read_dbf(spark, str(tmp_path / "t.dbf")).collect()] == [{"NAME": "ab"}]
    line = struct.pack("<I4dII", 3, 0, 0, 1, 1, 1, 2) + struct.pack("<i", 0) + struct.pack("<4d", 0, 0, 1, 1)
    point = struct.pack("<I2d", 1, 5.0, 6.0)
    body = b"".join(struct.pack(">II", i + 1, len(s) // 2) + s for i, s in enumerate((point, line)))
    (tmp_path / "t.shp").write_bytes(bytes(100) + body)
    got = containers.read_shapes(spark, str(tmp_path / "t.shp")).orderBy("record").collect()
    assert [(r["kind"], r["parts"], r["xs"], r["ys"]) for r in got] == [(1, [], [5.0], [6.0]), (3, [0], [0.0, 1.0], [0.0, 1.0])]


def test_serialised_values(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, None)], "a int, b array<int>")
    back = containers.from_bytes(spark, containers.to_bytes(df))
    assert rows(back, "a") == rows(df, "a")


def test_keyed_store_from_a_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    for i, batch in enumerate(([(1, 1.0, 0), (2, 2.0, 1)], [(2, 5.0, 2), (2, 6.0, 3), (3, 3.0, 4)])):
        spark.createDataFrame(batch, "k int, v double, t int").coalesce(1).write.mode("append").parquet(str(inbox))
    store = streams.KeyedStore(spark, str(tmp_path / "store"), "k", "k int, v double, t int")
    assert store.table().count() == 0
    stream = streams.listen(spark, str(inbox), "k int, v double, t int", files_per_batch=1)
    query = streams.on_message(stream, lambda batch, n: store.upsert(batch, n, "t"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert rows(store.table().select("k", "v"), "k") == [(1, 1.0), (2, 6.0), (3, 3.0)]
    store.upsert(spark.createDataFrame([(9, 9.0, 9)], "k int, v double, t int"), 1, "t")  # a batch tried again replaces its version
    assert [r[0] for r in rows(store.table(before=1).select("k"), "k")] == [1, 2] or [r[0] for r in rows(store.table(before=1).select("k"), "k")] == [2, 3]


def test_keyed_store_merges_its_deltas(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams.KeyedStore, "EVERY", 3)
    store = streams.KeyedStore(spark, str(tmp_path / "store"), "k", "k int, v string, t int")
    want: dict = {}
    for n in range(11):
        batch = [(k, f"{n}-{k}", 10 * n + k) for k in range(n % 4, n % 4 + 3)] + [(n % 4, None if n == 5 else f"{n}-late", 1000)]
        for _ in range(2 if n in (2, 4) else 1):  # a batch that is tried again
            store.upsert(spark.createDataFrame(batch, "k int, v string, t int"), n, "t")
        want |= {k: v for k, v, _ in batch}
        assert {r["k"]: r["v"] for r in store.table().collect()} == want
    folders = {p.name for p in (tmp_path / "store").iterdir()}
    assert "base-8" in folders and "base-2" not in folders and "delta-1" not in folders and "delta-9" in folders


def test_running_state_and_windows(spark, tmp_path):
    inbox = str(tmp_path / "in")
    spark.sql("select * from values (1, timestamp'2024-01-01 00:00:10', 2.0), (1, timestamp'2024-01-01 00:00:50', 3.0), (2, timestamp'2024-01-01 00:01:10', 4.0) t(k, ts, v)").selectExpr("k", "ts", "cast(v as double) v").coalesce(1).write.parquet(inbox)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name)

    stream = streams.listen(spark, inbox, "k int, ts timestamp, v double")
    assert sorted((r["k"], r["state"]) for r in run(streams.running_state(stream, "k", "v", lambda a, b: a + b, 10.0), "st", "update").collect()) == [(1, 15.0), (2, 14.0)]
    tumbled = streams.tumbling(stream, "ts", "1 minute", ["k"], F.sum("v").alias("s"))
    assert sorted((r["k"], r["s"]) for r in run(tumbled, "tw", "complete").collect()) == [(1, 5.0), (2, 4.0)]


def test_hooks(spark, tmp_path):
    seen = []
    hooks = streams.Hooks(lambda i: seen.append("open"), lambda i, e: seen.append("close"))
    spark.streams.addListener(hooks)
    spark.range(2).write.parquet(str(tmp_path / "in"))
    q = streams.on_message(streams.listen(spark, str(tmp_path / "in"), "id bigint"), lambda b, n: None, str(tmp_path / "cp"))
    q.awaitTermination(60)
    import time

    for _ in range(50):
        if "close" in seen:
            break
        time.sleep(0.1)
    spark.streams.removeListener(hooks)
    assert seen == ["open", "close"]
