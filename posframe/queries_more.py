"""More of the query catalogue: files written and read again, shapes, cells, iteration, numerics, the language, streams.

Registered beside those of `queries`; the driver contract imports both.
"""

from __future__ import annotations

import json
import operator
import struct
import zipfile
from collections.abc import Iterator
from io import BytesIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ecs import World
from .functions import arith, cells, hashes, numeric, text, udf
from .operators import iterate, project, sets, sort, window
from .queries import EVENTS, QUERIES, SQL, _folder, _streamed, program, query, table
from .sources import containers, files, generate
from .streaming import streams

c = F.col


def written(sql: str):
    """Register a function of (spark, sf_dir, folder) that writes files into the folder and reads them again."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, sf_dir, _folder(spark))
        SQL[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- files


@written("select event_id::bigint as pos, event_type || ' ' || event_id as line from events")
def lines_round_trip(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Lines keep their order."""
    rows = table(spark, sf_dir, "events").select(c("event_id").alias("_pos"), F.concat_ws(" ", "event_type", "event_id").alias("line"))
    files.write_lines(rows, f"{folder}/lines")
    return files.read_lines(spark, f"{folder}/lines").select(c("_pos").alias("pos"), "line")


@written("select c_custkey, c_name, c_mktsegment, c_nationkey, round(c_acctbal::float::double, 2) as bal from customer")
def csv_round_trip(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Types are inferred from the cells: ints, floats, text."""
    files.write_csv(table(spark, sf_dir, "customer"), f"{folder}/csv")
    got = files.read_csv(spark, f"{folder}/csv")
    return got.select(c("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_mktsegment", "c_nationkey", F.round(c("c_acctbal").cast("double"), 2).alias("bal"))


@written("select n_nationkey, n_name, n_regionkey from nation")
def json_round_trip(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """An object per line."""
    files.write_json(table(spark, sf_dir, "nation"), f"{folder}/json")
    return files.read_json(spark, f"{folder}/json", "n_nationkey int, n_name string, n_regionkey int", lines=True)


@written("select count(*)::bigint as n, sum(strlen(c_name) + 1)::bigint as bytes from customer")
def bytes_and_listing(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The bytes of written files, their listing, and the lines they hold."""
    rows = table(spark, sf_dir, "customer").select(c("c_custkey").alias("_pos"), c("c_name").alias("line"))
    files.write_lines(rows, f"{folder}/names")
    held = files.read_bytes(spark, f"{folder}/names/part-*").select(F.length("content").alias("n"), "path", F.regexp_count(c("content").cast("string"), F.lit("\n")).alias("lines"))
    listed = files.listing(spark, f"{folder}/names").select(c("path").alias("of"), "length")
    both = held.join(listed, (c("path") == c("of")) & (c("n") == c("length")))
    return both.agg(F.sum("lines").cast("bigint").alias("n"), F.sum("length").cast("bigint").alias("bytes"))


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An archive per batch, an entry per row."""
    for batch in batches:
        if batch.num_rows:
            out = BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    z.writestr(name, content)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["content"])


@written("select s_name as name, strlen(s_name || ' in ' || s_nationkey)::bigint as size, s_name || ' in ' || s_nationkey as content from supplier")
def zip_entries(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Entries listed and read from archives."""
    rows = table(spark, sf_dir, "supplier").select("s_name", F.concat(c("s_name"), F.lit(" in "), c("s_nationkey")).alias("text"))
    made = rows.mapInArrow(_zipped, "content binary")
    archive = made.select(F.hex("content").alias("hex"))
    archive.write.text(f"{folder}/hex")
    # archives as files: the driver writes the few bytes of this small table to where Spark's readers find them
    for i, row in enumerate(spark.read.text(f"{folder}/hex").collect()):
        _put(spark, f"{folder}/zips/{i}.zip", bytes.fromhex(row[0]))
    listed = containers.zip_list(spark, f"{folder}/zips").select("path", "name", "size")
    read = containers.zip_read(spark, f"{folder}/zips").select("path", "name", c("content").cast("string").alias("content"))
    return listed.join(read, ["path", "name"]).select("name", "size", "content")


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    """Bytes of the driver to a file of any file system that Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(content)
    finally:
        out.close()


@written("select n_nationkey::bigint as i, 0::bigint as j, n_nationkey::double as v from nation union all select n_nationkey, 1, n_regionkey from nation")
def tensor_round_trip(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """A small table as a two-column tensor in a file, read as (i, j, v)."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey", "n_regionkey").collect()
    data = struct.pack(f"<{2 * len(rows)}f", *[x for r in rows for x in r])
    head = json.dumps({"t": {"dtype": "F32", "shape": [len(rows), 2], "data_offsets": [0, len(data)]}}).encode()
    _put(spark, f"{folder}/tensors/t.safetensors", struct.pack("<Q", len(head)) + head + data)
    made = containers.explode_tensor(containers.read_safetensors(spark, f"{folder}/tensors"), "t")
    return made.select(c("i").cast("bigint").alias("i"), c("j").cast("bigint").alias("j"), "v")


@written("select n_nationkey::bigint as record, n_name as name, n_regionkey as region, n_nationkey::double as x, n_regionkey::double as y from nation")
def geometry_files(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """A small table as an attribute table and a file of points, read and joined by record."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    field = lambda name, kind, size: name.ljust(11, "\0").encode() + kind.encode() + bytes(4) + bytes([size]) + bytes(15)
    records = b"".join(b" " + r["n_name"].ljust(20).encode() + str(r["n_regionkey"]).rjust(4).encode() for r in rows)
    head = b"\x03" + bytes(3) + struct.pack("<IHH", len(rows), 97, 25) + bytes(20)
    _put(spark, f"{folder}/n.dbf", head + field("NAME", "C", 20) + field("REGION", "N", 4) + b"\r" + records)
    points = b"".join(struct.pack(">II", i + 1, 10) + struct.pack("<Idd", 1, r["n_nationkey"], r["n_regionkey"]) for i, r in enumerate(rows))
    _put(spark, f"{folder}/n.shp", bytes(100) + points)
    shapes = containers.read_shapes(spark, f"{folder}/n.shp").select("record", F.get("xs", F.lit(0)).alias("x"), F.get("ys", F.lit(0)).alias("y"))
    names = containers.read_dbf(spark, f"{folder}/n.dbf").select("record", c("fields")["NAME"].alias("name"), c("fields")["REGION"].cast("int").alias("region"))
    return names.join(shapes, "record")


@written("select n_nationkey, n_name, n_regionkey from nation")
def bytes_of_a_table(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """A small table as bytes, and the table again."""
    return containers.from_bytes(spark, containers.to_bytes(table(spark, sf_dir, "nation")))


@written("select c_custkey, adler, true as gzip, true as zlib, true as smaller from (select c_custkey, (len(b) + list_sum(list_transform(b, lambda x, i: (len(b) - i + 1) * x))) % 65521 * 65536 + (1 + list_sum(b)) % 65521 as adler from (select c_custkey, list_transform(string_split(repeat(c_name, 8), ''), lambda x: ord(x)) as b from customer))")
def compressed_bytes(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """What is decompressed has the checksum of the text; containers begin as they should and repeats take less."""
    name = F.repeat(c("c_name"), F.lit(8))
    rows = table(spark, sf_dir, "customer").select("c_custkey", name.alias("t"))
    packed = rows.select("c_custkey", "t", hashes.compress(c("t"), "gzip").alias("g"), hashes.compress(c("t"), "zlib").alias("z"), hashes.compress(c("t"), "deflate").alias("d"))
    back = packed.select("*", hashes.decompress(c("d"), "deflate").alias("back"), hashes.decompress(c("g"), "gzip").alias("again"))
    same = (c("back") == c("again")) & (F.substring("g", 1, 2) == F.unhex(F.lit("1f8b")))
    return back.select("c_custkey", hashes.adler32(c("back")).alias("adler"), same.alias("gzip"), (F.substring("z", 1, 1) == F.unhex(F.lit("78"))).alias("zlib"), (F.length("d") < F.length("t")).alias("smaller"))


# ---------------------------------------------------------------- rows, shapes, random tables


@query("select event_id, case when value > 100 then 'high' else 'low' end as level from events", "events")
def pick_of_two(events):
    return events.select("event_id", project.pick_pair(c("value") > 100, F.lit("low"), F.lit("high")).alias("level"))


@query("select event_id, value = 0 as zero, event_type = 'error' as same from events", "events")
def not_and_match(events):
    return events.select("event_id", arith.is_not(c("value")).alias("zero"), (c("event_type") == "error").alias("same"))


@query("select event_id, (value > 50) and (user_id % 2 = 0) as both_, (value > 50) or (user_id % 2 = 0) as either, least(value, user_id::double) as lo, greatest(value, user_id::double) as hi from events", "events")
def lesser_larger(events):
    a, b = c("value") > 50, c("user_id") % 2 == 0
    return events.select("event_id", (a & b).alias("both_"), (a | b).alias("either"), arith.lesser(c("value"), c("user_id")).alias("lo"), arith.larger(c("value"), c("user_id")).alias("hi"))


@query("select n_nationkey as k, n_name as v from nation", "nation")
def keyed_rows(nation):
    """The row of each key, through a dictionary per row."""
    whole = nation.select("n_nationkey", cells.pair(F.array("n_nationkey"), F.array("n_name")).alias("d"))
    return whole.select(c("n_nationkey").alias("k"), F.element_at("d", c("n_nationkey")).alias("v"))


@query("select event_id, (props->>'$.k')::bigint as k, 'k' as name from events", "events")
def deep_index(events):
    parsed = events.select("event_id", cells.json_parse(c("props"), "k bigint").alias("p"))
    nested = parsed.select("event_id", F.struct(F.array(c("p")).alias("list")).alias("x"))
    return nested.select("event_id", project.deep(c("x"), ["list", 0, "k"]).alias("k"), F.lit("k").alias("name"))


@query("select count(*)::bigint as n from lineitem", "lineitem")
def tally_rows(lineitem):
    return project.tally(lineitem)


@query("select 'n_name' as name, 'S' as type union all select 'n_nationkey', 'I' union all select 'n_regionkey', 'I'", "nation")
def column_types(nation):
    kinds = project.types(nation)
    return nation.sparkSession.createDataFrame([(n, kinds[n]) for n in project.keys(nation)], "name string, type string")


@query("select count(*)::bigint as n, 64::bigint as width from embeddings", "embeddings")
def shape_of_cells(embeddings):
    return embeddings.sparkSession.createDataFrame([project.shape(embeddings, "embedding")], "n bigint, width bigint")


@query("select n_nationkey::bigint as pos, n_nationkey, n_name, n_regionkey from nation union all select 25, 99, 'NOWHERE', 7", "nation")
def insert_row(nation):
    placed = nation.withColumn("_pos", c("n_nationkey").cast("bigint"))
    return project.insert(placed, {"n_nationkey": 99, "n_name": "NOWHERE", "n_regionkey": 7}).withColumnRenamed("_pos", "pos")


@query("select n_nationkey, case when n_nationkey = 3 then 'THREE' else n_name end as n_name from nation union all select 77, 'NEW'", "nation")
def keyed_amend(nation):
    """Rows put by key."""
    rows = nation.sparkSession.createDataFrame([(3, "THREE"), (77, "NEW")], "n_nationkey int, n_name string")
    return World(nation.select("n_nationkey", "n_name"), "n_nationkey").put(rows).df


@query("select row_number() over (order by o_totalprice, o_orderkey) - 1 as pos, o_orderkey from orders", "orders")
def sort_by_column(orders):
    rows = sort.sort(orders.select(c("o_orderkey").alias("_pos"), "o_orderkey", "o_totalprice"), "o_totalprice")
    return rows.select(c("_pos").alias("pos"), "o_orderkey")


@query("select row_number() over (order by n desc, first) - 1 as pos, k, n from (select event_type as k, count(*) as n, min(event_id) as first from events group by 1)", "events")
def sort_dictionary(events):
    """A dictionary by its values, descending; ties by position."""
    counts = events.groupBy(c("event_type").alias("k")).agg(F.count("*").alias("v"), F.min("event_id").alias("_pos"))
    return sort.sort(counts, "v", desc=True).select(c("_pos").alias("pos"), "k", c("v").alias("n"))


@query("select count(*)::bigint as n, count(distinct event_id)::bigint as ids, min(event_id) as lo, max(event_id) as hi, true as moved from events", "events")
def shuffle_rows(events):
    """A permutation: every row once, at positions 0 to n-1, not where it was."""
    rows = sort.shuffle(events.select(c("event_id").alias("_pos"), "event_id"), 5)
    facts = rows.agg(F.count("*").alias("n"), F.count_distinct("_pos").alias("ids"), F.min("_pos").alias("lo"), F.max("_pos").alias("hi"), F.avg((c("_pos") == c("event_id")).cast("int")).alias("still"))
    return facts.select("n", "ids", "lo", "hi", (c("still") < 0.5).alias("moved"))


@query("select 1000::bigint as rolls, true as below, 100::bigint as dealt, 100::bigint as different, true as uniform", "region")
def random_vectors(region):
    """Rolls below their bound, a deal without repeats, uniform numbers about a half."""
    spark = region.sparkSession
    roll, deal, uniform = generate.roll(spark, 1000, 6, 1), generate.deal(spark, 100, 1000, 2), generate.uniform(spark, 5000, 3)
    a = roll.agg(F.count("*").alias("rolls"), ((F.min("v") >= 0) & (F.max("v") < 6)).alias("below"))
    b = deal.agg(F.count("*").alias("dealt"), F.count_distinct("v").alias("different"))
    u = uniform.agg((F.abs(F.avg("v") - 0.5) < 0.05).alias("uniform"))
    return a.join(b).join(u)


@query("select 0::bigint as pos, 1 as a, 'x' as b union all select 1, 2, 'y' union all select 2, 3, 'z'", "region")
def table_literal(region):
    return generate.literal(region.sparkSession, {"a": [1, 2, 3], "b": ["x", "y", "z"]}, "a int, b string").withColumnRenamed("_pos", "pos")


@query("select i::bigint as i, xor(i, i >> 1)::bigint as gray from range(0, 16) r(i)", "region")
def gray_codes(region):
    return region.sparkSession.createDataFrame(list(enumerate(sets.gray_code(4))), "i bigint, gray bigint")


@query("select n_nationkey, u.m::bigint as mask, (case when u.m & 1 > 0 then n_nationkey else 0 end + case when u.m & 2 > 0 then n_regionkey else 0 end + case when u.m & 4 > 0 then 7 else 0 end)::bigint as s from nation, range(0, 8) u(m)", "nation")
def powersets(nation):
    """The sum of each sub-list, by its mask."""
    made = nation.select("n_nationkey", F.posexplode(sets.powerset(F.array("n_nationkey", "n_regionkey", F.lit(7)))).alias("m", "part"))
    return made.select("n_nationkey", c("m").cast("bigint").alias("mask"), F.aggregate("part", F.lit(0), lambda n, x: n + x).cast("bigint").alias("s"))


# ---------------------------------------------------------------- cells, folds and scans


@query("select n_nationkey, [n_nationkey * 2, n_regionkey * 2] as doubled, [n_nationkey + 10, n_regionkey + 20] as zipped, [n_nationkey + 1, n_nationkey + 2] as right_, [1 - n_nationkey, 2 - n_nationkey] as left_ from nation", "nation")
def each_and_zip(nation):
    """H1, H2, H3."""
    x, n = F.array("n_nationkey", "n_regionkey"), c("n_nationkey")
    some = F.array(F.lit(1), F.lit(2))
    return nation.select(
        "n_nationkey",
        cells.each(x, lambda v: v * 2).alias("doubled"),
        cells.zip_(x, F.array(F.lit(10), F.lit(20)), operator.add).alias("zipped"),
        cells.each_right(n, some, operator.add).alias("right_"),
        cells.each_left(some, n, operator.sub).alias("left_"),
    )


@query("select n_nationkey, [n_nationkey, n_regionkey, n_nationkey, 1] as flat, n_nationkey + n_regionkey as a, n_regionkey * 2 as b from nation", "nation")
def flatten_and_dict_arithmetic(nation):
    """A6, A7."""
    n, r = c("n_nationkey"), c("n_regionkey")
    nested = F.array(F.array(F.array(n, r)), F.array(F.array(n, F.lit(1))))
    d = cells.dict_op(F.create_map(F.lit("a"), n, F.lit("b"), r), F.create_map(F.lit("a"), r, F.lit("b"), r), operator.add)
    return nation.select("n_nationkey", cells.flatten(nested, 2).alias("flat"), F.element_at(d, "a").alias("a"), F.element_at(d, "b").alias("b"))


@query("select n_nationkey, [2*n_nationkey + 1, 2*(2*n_nationkey + 1) + 2, 2*(2*(2*n_nationkey + 1) + 2) + 3] as seeded from nation", "nation")
def general_scan(nation):
    """All results of a fold that no built-in has, from a seed."""
    three = F.array(F.lit(1), F.lit(2), F.lit(3))
    return nation.select("n_nationkey", window.scan(three, lambda a, b: a * 2 + b, c("n_nationkey")).alias("seeded"))


@query("select vec_id, len(list_filter(range(0, 64, 16), lambda s: s + 32 <= 64))::bigint as frames, round(list_sum(embedding[17:48])::double, 4) as second from embeddings", "embeddings")
def overlapping_frames(embeddings):
    """W13."""
    framed = embeddings.select("vec_id", window.overlapping(c("embedding").cast("array<double>"), 32, 16).alias("f"))
    return framed.select("vec_id", F.size("f").cast("bigint").alias("frames"), F.round(numeric.total(F.get("f", F.lit(1))), 4).alias("second"))


@query("select n_nationkey, (n_nationkey * 8 + 7)::bigint as three, case when n_nationkey = 0 then 0 else 1 end::bigint as fixed from nation", "nation")
def n_times_and_converge(nation):
    """H4, H6: a number of steps, and steps until nothing changes."""
    n = c("n_nationkey").cast("bigint")
    stepped = iterate.n_do_cell(n, 3, lambda x: x * 2 + 1)
    halves = iterate.states_cell(n, lambda x: F.expr("0") + F.ceil(x / 2).cast("bigint"), lambda x: x > 1, 40)
    return nation.select("n_nationkey", stepped.alias("three"), F.element_at(halves, -1).alias("fixed"))


@query("with recursive r as (select 0::bigint as n union select n_nationkey::bigint from nation, r where n_nationkey = n * 2 + 1 or n_nationkey = n * 2 + 2) select n from r", "nation")
def reached_nodes(nation):
    """What a tree's edges reach from its root, breadth first."""
    edges = nation.filter("n_nationkey > 0").select(F.expr("(n_nationkey - 1) div 2").cast("bigint").alias("a"), c("n_nationkey").cast("bigint").alias("b"))
    return iterate.closure(edges, nation.sparkSession.createDataFrame([(0,)], "n bigint"))


@query("with recursive s as (select l_orderkey::bigint as k, sum(l_quantity)::double as x, 0 as i from lineitem group by 1 union all select k, floor(x / 2), i + 1 from s where x >= 1) select k, 0::double as x from s group by 1", "lineitem")
def converge_table(lineitem):
    """H6 on a table: halved until nothing changes."""
    rows = lineitem.groupBy(c("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("x"))
    return iterate.converge(rows, lambda t: t.withColumn("x", F.floor(c("x") / 2).cast("double")))


# ---------------------------------------------------------------- scalars and text


@query("select p_partkey, round(tan(p_size), 6) as t, round(asin(p_size / 100.0), 6) as s, round(acos(p_size / 100.0), 6) as o, round(atan(p_size), 6) as n, round(atan2(p_size, p_retailprice), 6) as n2, round(cbrt(p_size), 6) as b from part", "part")
def trigonometry(part):
    x = c("p_size")
    made = {"t": F.tan(x), "s": F.asin(x / 100.0), "o": F.acos(x / 100.0), "n": F.atan(x), "n2": F.atan2(x, c("p_retailprice")), "b": F.cbrt(x)}
    return part.select("p_partkey", *[F.round(v, 6).alias(k) for k, v in made.items()])


@query("select c_custkey, c_custkey::varchar as t, lpad(c_custkey::varchar, 6, '0') as z, printf('%.2f', c_acctbal) as d, printf('%.1f%%', c_nationkey * 100 / 25.0) as p from customer", "customer")
def number_formats(customer):
    """T1, T9."""
    n = c("c_custkey")
    return customer.select("c_custkey", text.fmt(n).alias("t"), text.zeros(n, 6).alias("z"), text.decimals(c("c_acctbal"), 2).alias("d"), text.percent(c("c_nationkey") / 25.0, 1).alias("p"))


@query("select word as term, p_partkey, place::bigint as place from (select p_partkey, unnest(w) as word, generate_subscripts(w, 1) - 1 as place from (select p_partkey, string_split(lower(p_name), ' ') as w from part))", "part")
def posting_places(part):
    return text.postings(part, "p_partkey", "p_name")


@query(
    """with w as (select p_partkey, string_split(lower(p_name), ' ') as ws from part), l as (select p_partkey, len(ws) as len, unnest(ws) as term from w),
    stats as (select count(*) as n, avg(len(ws)) as mean from w), hits as (select p_partkey, len, term, count(*) as tf from l where term in ('small', 'ring') group by 1, 2, 3),
    dfs as (select term, count(*) as df from hits group by 1)
    select p_partkey, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) as score from hits join dfs using (term), stats group by 1""",
    "part",
)
def bm25_scores(part):
    """T8."""
    return text.bm25(part, "p_partkey", "p_name", ["small", "ring"]).select("p_partkey", F.round("score", 6).alias("score"))


@query("select c_custkey, sha256(o || unhex(sha256(i || c_name::blob))) as mac from (select *, unhex(repeat('5d', 3) || repeat('36', 61)) as i, unhex(repeat('37', 3) || repeat('5c', 61)) as o from customer)", "customer")
def keyed_digest(customer):
    """HMAC with the key 'kkk', against its definition by two digests."""
    return customer.select("c_custkey", hashes.hmac(c("c_name"), b"kkk").alias("mac"))


# ---------------------------------------------------------------- numerics


@query("select n_nationkey, round((3.0 * n_nationkey - n_regionkey) / 5, 6) as x, round((2.0 * n_regionkey - n_nationkey) / 5, 6) as y from nation", "nation")
def linear_system(nation):
    """L1: the system ((2, 1), (1, 3)) of each row."""
    matrix = F.array(*map(F.lit, (2.0, 1.0, 1.0, 3.0)))
    solved = nation.select("n_nationkey", numeric.solve(matrix, F.array(c("n_nationkey").cast("double"), c("n_regionkey").cast("double"))).alias("s"))
    return solved.select("n_nationkey", F.round(F.get("s", F.lit(0)), 6).alias("x"), F.round(F.get("s", F.lit(1)), 6).alias("y"))


@query("select n_nationkey, round(greatest(n_nationkey + 1, n_regionkey + 1)::double, 6) as most, round(least(n_nationkey + 1, n_regionkey + 1)::double, 6) as least_, (n_nationkey + n_regionkey + 2)::double as trace from nation", "nation")
def singular_values_of_diagonals(nation):
    """L2."""
    zero, n, r = F.lit(0), c("n_nationkey") + 1, c("n_regionkey") + 1
    square = numeric.diagonal(F.array(n, r))
    values = nation.select("n_nationkey", numeric.singular_values(F.array(n, zero, zero, r), 2).alias("s"), numeric.total(F.flatten(square)).alias("trace"))
    return values.select("n_nationkey", F.round(F.get("s", F.lit(0)), 6).alias("most"), F.round(F.get("s", F.lit(1)), 6).alias("least_"), "trace")


@query("with e as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as t from embeddings) select vec_id, k::bigint as k, round(sum(x * cos(2 * pi() * k * t / 64)), 4) + 0.0 as re, round(-sum(x * sin(2 * pi() * k * t / 64)), 4) + 0.0 as im from e, range(0, 64) r(k) group by 1, 2", "embeddings")
def fourier_bins(embeddings):
    """L3: every bin of the transform."""
    bins = embeddings.select("vec_id", numeric.fft(c("embedding").cast("array<double>")).alias("f")).select("vec_id", F.posexplode("f").alias("p", "v"))
    paired = bins.groupBy("vec_id", F.expr("p div 2").cast("bigint").alias("k")).agg(F.sum(F.when(c("p") % 2 == 0, c("v"))).alias("re"), F.sum(F.when(c("p") % 2 == 1, c("v"))).alias("im"))
    return paired.select("vec_id", "k", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))


@query("with f as (select vec_id, unnest([0, 16, 32]) as s, embedding from embeddings) select vec_id, s::bigint as s, round(embedding[s + 2]::double - 0.5 * embedding[s + 1]::double, 5) as v from f", "embeddings")
def shaped_frames(embeddings):
    """L4: frames of a signal after emphasis; the second value of each."""
    made = embeddings.select("vec_id", numeric.frames(c("embedding").cast("array<double>"), 32, 16, 0.5).alias("f"))
    each = made.select("vec_id", F.posexplode("f").alias("i", "frame"))
    return each.select("vec_id", (c("i") * 16).cast("bigint").alias("s"), F.round(F.get("frame", F.lit(1)), 5).alias("v"))


@query("with e as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as j from embeddings) select vec_id, round(sum(greatest(x, 0)), 4) as relu, round(sum(x / (1 + exp(-x))), 4) as silu, round(sum(case when j <= 32 then x end * 1), 4) + 1 as dense from e group by 1", "embeddings")
def activations(embeddings):
    """Activations, and a dense layer that adds up the first half."""
    x = c("embedding").cast("array<double>")
    dense = numeric.linear(x, [[1.0] * 32 + [0.0] * 32], [1.0])
    return embeddings.select("vec_id", F.round(numeric.total(numeric.relu(x)), 4).alias("relu"), F.round(numeric.total(numeric.silu(x)), 4).alias("silu"), F.round(F.get(dense, F.lit(0)) - 1, 4).alias("d")).select("vec_id", "relu", "silu", (c("d") + 1).alias("dense"))


@query("select vec_id, s::bigint as s, round(embedding[s + 1]::double - 2 * embedding[s + 2]::double + embedding[s + 3]::double, 5) + 0.0 as v from embeddings, range(0, 62, 2) r(s)", "embeddings")
def convolutions(embeddings):
    """Second differences, every other one."""
    made = embeddings.select("vec_id", F.posexplode(numeric.convolve(c("embedding"), [1.0, -2.0, 1.0], 2)).alias("i", "v"))
    return made.select("vec_id", (c("i") * 2).cast("bigint").alias("s"), (F.round("v", 5) + 0.0).alias("v"))


@query(
    """with t as (select vec_id, r, j, embedding[r * 8 + j + 1]::double as x from embeddings, range(0, 8) a(r), range(0, 8) b(j)),
    s as (select q.vec_id, q.r, k.r as o, sum(q.x * k.x) / sqrt(8) as score from t q join t k using (vec_id, j) group by 1, 2, 3),
    w as (select *, exp(score) / sum(exp(score)) over (partition by vec_id, r) as w from s)
    select w.vec_id, w.r::bigint as r, t.j::bigint as j, round(sum(w * x), 5) + 0.0 as v from w join t on t.vec_id = w.vec_id and t.r = w.o group by 1, 2, 3""",
    "embeddings",
)
def self_attention(embeddings):
    """Eight rows of eight numbers attend to each other."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice(c("embedding"), r * 8 + 1, 8))
    made = embeddings.select("vec_id", F.posexplode(numeric.attention(rows, rows, rows)).alias("r", "row")).select("vec_id", "r", F.posexplode("row").alias("j", "v"))
    return made.select("vec_id", c("r").cast("bigint").alias("r"), c("j").cast("bigint").alias("j"), (F.round("v", 5) + 0.0).alias("v"))


@query(
    """with recursive s as (select vec_id, embedding, 0 as t, 0::double as h, 0::double as c from embeddings union all
    select vec_id, embedding, t + 1, tanh(c2) / (1 + exp(-(x + 0.25))), c2 from (select *, c / (1 + exp(-(x - h))) + tanh(0.5 * x + h) / (1 + exp(-(x + h))) as c2
    from (select *, embedding[t + 1]::double as x from s where t < 16)))
    select vec_id, round(h, 5) + 0.0 as h from s where t = 16""",
    "embeddings",
)
def recurrent_state(embeddings):
    """One hidden unit over the first sixteen numbers."""
    steps = F.transform(F.slice(c("embedding"), 1, 16), lambda x: F.array(x.cast("double")))
    state = numeric.lstm(steps, [[1.0, 1.0], [1.0, -1.0], [0.5, 1.0], [1.0, 0.0]], [0.0, 0.0, 0.0, 0.25], 1)
    return embeddings.select("vec_id", (F.round(F.get(state, F.lit(0)), 5) + 0.0).alias("h"))


@query("select n_nationkey, (n_nationkey * 2 + n_regionkey * 3 + 1)::double as dot, (n_nationkey * 3 - n_regionkey * 2)::double as xy, (n_nationkey - 2)::double as xz, (n_regionkey - 3)::double as yz, 0::double as null_ from nation", "nation")
def multivectors(nation):
    """The product of the directions (key, region, 1) and (2, 3, 1): their dot product and the planes between them."""
    put = lambda x, y, z: F.array(*[v.cast("double") if (v := {2: x, 4: y, 8: z}.get(i)) is not None else F.lit(0.0) for i in range(16)])
    p = numeric.geometric(put(c("n_nationkey"), c("n_regionkey"), F.lit(1)), put(F.lit(2), F.lit(3), F.lit(1)))
    at = lambda i: F.get(p, F.lit(i))
    return nation.select("n_nationkey", at(0).alias("dot"), at(6).alias("xy"), at(10).alias("xz"), at(12).alias("yz"), at(3).alias("null_"))


@query("select 0::bigint as pos, 'one' as line union all select 1, 'two'", "region")
def program_lines(region):
    """What a program writes."""
    return files.execute(region.sparkSession, "printf", "one\\ntwo\\n").withColumnRenamed("_pos", "pos")


# ---------------------------------------------------------------- user functions


@query("select event_id, value * 2 + user_id as r from events", "events")
def vectorised_function(events):
    """A function of series, one argument fixed by a projection."""
    scaled = udf.projection(lambda x, k, y: x * k + y, k=2)
    return events.select("event_id", udf.vectorised(lambda x, y: scaled(x, y=y), "double")(c("value"), c("user_id").cast("double")).alias("r"))


@query("select event_type, max(value) - min(value) as spread from events group by 1", "events")
def user_aggregate(events):
    """An aggregate of the user's."""
    return events.groupBy("event_type").agg(udf.folding(lambda s: float(s.max() - s.min()))(c("value")).alias("spread"))


@query("select n_nationkey, n_nationkey + 1 as next from nation", "nation")
def function_for_sql(nation):
    """A function by name, called from SQL."""
    udf.registered(nation.sparkSession, "next_one", lambda x: x + 1, "int")
    return nation.select("n_nationkey", F.expr("next_one(n_nationkey)").alias("next"))


@query("select n_nationkey, u.i::bigint as copy from nation, range(0, 2) u(i)", "nation")
def rows_of_rows(nation):
    """A function from batches of rows to any number of rows."""
    return udf.rows_to_rows(nation.select("n_nationkey"), lambda p: pd.concat([p.assign(copy=0), p.assign(copy=1)]), "n_nationkey int, copy bigint")


# ---------------------------------------------------------------- the language

for _name, _sql, _source in (
    ("lang_globals", "select event_type as k, max(value) as v from events group by 1", "m:t.value;(|/)'m@=t.event_type"),
    ("lang_lambda", "select event_type as k, sum(value * 2) as v from events group by 1", "f:{x*2};(+/)'f[t.value]@=t.event_type"),
    ("lang_projection", "select event_type as k, min(value + 3) as v from events group by 1", "g:{x+y};h:g[;3];(&/)'h[t.value]@=t.event_type"),
    ("lang_condition", "select event_type as k, count(*) as v from events where value > 10 group by 1", "u:t@&t.value>10;#'=u.event_type"),
):
    QUERIES[_name] = program(_sql, _source, EVENTS)
    SQL[_name] = _sql


# ---------------------------------------------------------------- streams


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A handler with hooks; the sum of each user goes on from batch to batch in the state store."""
    folder, seen = _folder(spark), []
    hooks = streams.Hooks(opened=seen.append, closed=lambda i, e: seen.append(i))
    spark.streams.addListener(hooks)
    try:
        states = streams.running_state(_streamed(spark, sf_dir), "user_id", "value", lambda held, v: held + v, 0.0)
        writer = states.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        writer.foreachBatch(lambda batch, n: batch.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).start().awaitTermination()
    finally:
        spark.streams.removeListener(hooks)
    newest = F.row_number().over(W.partitionBy("user_id").orderBy(c("batch").desc()))
    rows = spark.read.schema("user_id bigint, state double, n int, batch int").parquet(f"{folder}/out").withColumn("r", newest)
    return rows.filter("r = 1").select("user_id", F.round("state", 2).alias("state"))


QUERIES["stream_state"] = stream_state
SQL["stream_state"] = "select user_id, round(sum(value), 2) as state from events group by 1"
