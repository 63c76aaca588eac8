"""Operators against golden values, plain Python models and each other, on small inputs with ties, nulls and edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from posframe import EngineError, Keyed, dct, keyed, vec
from posframe.ecs import World
from posframe.functions import arith, cells, hashes, numeric, text
from posframe.model import type_symbol, zero_of
from posframe.operators import aggregate as agg
from posframe.operators import iterate, join, position, project, sets, sort, window
from posframe.sources import generate

c = F.col


def values(df, name="v", pos="_pos"):
    return [r[name] for r in df.orderBy(pos).collect()]


def cell(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(*items):
    return F.array(*[F.lit(i) for i in items])


@pytest.fixture(scope="module")
def mixed(spark):
    return generate.literal(spark, {"i": [1, 2, 3, 4, 5], "f": [1.5, 2.5, 3.5, 4.5, 5.5], "s": list("abcde"), "b": [True, False, False, False, True], "t": list("vwxyz")}, "i int, f double, s string, b boolean, t string")


def moved(df):
    """The rows that each exchange of a plan has moved, by kind, once it has run."""
    df.collect()
    out, nodes = [], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind in ("ShuffleExchangeExec", "BroadcastExchangeExec"):
            name = "shuffleRecordsWritten" if kind == "ShuffleExchangeExec" else "numOutputRows"
            out.append((kind, node.metrics().apply(name).value()))
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            nodes.append(node.plan())
        else:
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    return out


# ------------------------------------------------------------------------------------------------ tables


def test_rows_by_index_and_mask(spark, mixed):
    assert values(position.at(mixed, vec(spark, [4, 0, 2], "bigint")), "i") == [5, 1, 3]
    assert values(position.at(mixed, vec(spark, [1, 1, 1], "bigint")), "s") == ["b", "b", "b"]
    assert position.row(mixed, 2)["s"] == "c"
    assert project.filter_mask(mixed, F.lit(False)).dtypes == mixed.dtypes
    with pytest.raises(EngineError):
        position.row(mixed, 9)
    with pytest.raises(Exception, match="!index"):
        position.at(mixed, vec(spark, [7], "bigint")).collect()
    assert values(project.weed_out(mixed, c("b")), "i") == [2, 3, 4]
    assert [r["v"] for r in project.where(mixed, c("b")).collect()] == [0, 4]


def test_columns_types_shape(spark, mixed):
    assert project.types(mixed) == {"i": "I", "f": "D", "s": "S", "b": "B", "t": "S"}
    assert project.keys(mixed) == ["i", "f", "s", "b", "t"]
    assert [values(v) for v in project.columns(mixed, "i", "s")] == [[1, 2, 3, 4, 5], list("abcde")]
    assert project.tally(mixed).first()["n"] == 5
    m = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "_pos bigint, v array<int>")
    assert project.shape(m, "v") == (2, 2)
    assert type_symbol(m.schema["v"].dataType) == "I"
    flipped = project.flip(mixed.select("i", "_pos", (c("i") * 2).alias("j")))
    assert {r["k"]: r["v"] for r in flipped.collect()} == {"i": [1, 2, 3, 4, 5], "j": [2, 4, 6, 8, 10]}
    assert project.match(mixed, mixed) and not project.match(mixed, position.reverse(mixed))


def test_take_drop_reverse_delete_splice(spark):
    v = vec(spark, [10, 20, 30], "int")
    assert values(position.take(v, 2)) == [10, 20] and values(position.take(v, -2)) == [20, 30]
    assert values(position.take(v, 7)) == [10, 20, 30, 10, 20, 30, 10] and values(position.take(v, -4)) == [30, 10, 20, 30]
    assert values(position.drop(v, 1)) == [20, 30] and values(position.drop(v, -1)) == [10, 20] and values(position.drop(v, 5)) == []
    assert values(position.reverse(v)) == [30, 20, 10] and values(position.delete_at(v, 1)) == [10, 30]
    with pytest.raises(EngineError):
        position.delete_at(v, 3)
    assert values(position.splice(v, 1, 2, vec(spark, [7, 8], "int"))) == [10, 7, 8, 30]
    assert values(position.concat(v, v)) == [10, 20, 30, 10, 20, 30]


def test_amend(spark, mixed):
    v = vec(spark, [0, 0, 0, 0], "int")
    changes = spark.createDataFrame([(1, 5, 0), (1, 7, 1), (3, 2, 2)], "v bigint, y int, _pos bigint")
    assert values(project.amend_at(v, "v", changes)) == [0, 7, 0, 2]
    assert values(project.amend_at(v, "v", changes, "sum")) == [0, 12, 0, 2]
    assert values(project.amend(mixed, {"f": lambda x: x * 2}), "f") == [3.0, 5.0, 7.0, 9.0, 11.0]
    nested = spark.createDataFrame([((1, [1, 2, 3]),)], "s struct<a:int,b:array<int>>")
    got = nested.select(project.drill(c("s"), ["b", 1], lambda x: x * 10).alias("s")).first()["s"]
    assert got["b"] == [1, 20, 3] and nested.select(project.deep(c("s"), ["b", 2]).alias("x")).first()["x"] == 3


def test_dictionaries(spark):
    d = dct(spark, ["a", "b", "c"], [1, 2, 3], "string", "bigint")
    assert [(r["k"], r["v"]) for r in project.take_keys(d, vec(spark, ["c", "z"], "string")).orderBy("_pos").collect()] == [("c", 3), ("z", None)]
    assert sorted(r["k"] for r in project.drop_keys(d, vec(spark, ["b"], "string")).collect()) == ["a", "c"]
    merged = join.merge(d, dct(spark, ["b", "q"], [20, 9], "string", "bigint"))
    assert [(r["k"], r["v"]) for r in merged.orderBy("_pos").collect()] == [("a", 1), ("b", 20), ("c", 3), ("q", 9)]
    groups = dct(spark, ["x", "x", "y"], [2, 0, 1], "string", "bigint")
    assert {r["k"]: r["v"] for r in project.map_through(groups, vec(spark, [10, 11, 12], "int")).collect()} == {"x": [12, 10], "y": [11]}
    with pytest.raises(EngineError):
        dct(spark, [1, 2, 3], [1, 2], "int", "int")


# ------------------------------------------------------------------------------------------------ joins


def test_left_lookup(spark):
    t = generate.literal(spark, {"s": ["a", "b", "c"], "p": [1, 2, 3], "q": [7, 8, 9]})
    k = generate.keyed_literal(spark, {"s": ["a", "b", "x", "y"]}, {"q": [101, 102, 103, 104], "r": [51, 52, 53, 54]})
    got = join.left_lookup(t, k).orderBy("_pos").collect()
    assert [(r["q"], r["r"]) for r in got] == [(101, 51), (102, 52), (9, 0)]
    assert [r["r"] for r in join.left_lookup(t, k, fill="null").orderBy("_pos").collect()] == [51, 52, None]
    twice = Keyed(k.df.unionByName(k.df.withColumns({"q": F.lit(5).cast("long"), "_pos": c("_pos") + 10})), "s")
    assert [r["q"] for r in join.left_lookup(t, twice).orderBy("_pos").collect()] == [101, 102, 9]
    null = Keyed(spark.createDataFrame([("a", None, 0)], "s string, q bigint, _pos bigint"), "s")
    assert [r["q"] for r in join.left_lookup(t, null).orderBy("_pos").collect()] == [None, 8, 9]
    with pytest.raises(EngineError):
        join.left_lookup(t.withColumn("q", c("q").cast("double")), k)
    with pytest.raises(EngineError):
        keyed(t, "zz")


def test_sparse_lookup_fills_zero(spark):
    t = generate.literal(spark, {"id": [1, 2, 3, 4], "px": [1.0, 2.0, 3.0, 4.0]})
    k = generate.keyed_literal(spark, {"id": [2, 4]}, {"boost": [5.0, 9.0]})
    assert [r["boost"] for r in join.left_lookup(t, k).orderBy("_pos").collect()] == [0.0, 5.0, 0.0, 9.0]


def test_upsert(spark):
    k1 = generate.keyed_literal(spark, {"s": ["a", "b"]}, {"p": [1, 2], "q": [3, 4]})
    k2 = generate.keyed_literal(spark, {"s": ["b", "c"]}, {"p": [9, 8], "q": [7, 6]})
    assert [tuple(r) for r in join.upsert(k1, k2).df.orderBy("_pos").select("s", "p", "q").collect()] == [("a", 1, 3), ("b", 9, 7), ("c", 8, 6)]
    part = generate.keyed_literal(spark, {"s": ["b"]}, {"p": [0]})
    assert [tuple(r) for r in join.upsert(k1, part).df.orderBy("_pos").select("s", "p", "q").collect()] == [("a", 1, 3), ("b", 0, 4)]
    with pytest.raises(Exception, match="!length"):
        join.upsert(k1, generate.keyed_literal(spark, {"s": ["new"]}, {"p": [0]})).df.collect()
    with pytest.raises(EngineError):
        project.insert(k1.df, {"s": "z", "p": 1.5, "q": 2})
    assert project.insert(k1.df, {"s": "z", "p": 1, "q": 2}).count() == 3
    assert [tuple(r) for r in k1["b"].collect()] == [(2, 4)]


def test_find_member_radius_as_of(spark):
    a = vec(spark, [4, 9, 3], "int")
    assert values(project.find(a, "v", vec(spark, [3, 1, 4], "int")), "pos") == [2, 3, 0]
    assert values(project.member_of(a, "v", vec(spark, [3, 4, 4, None], "int"), "m"), "m") == [True, False, True]
    r = random.Random(1)
    pts = spark.createDataFrame([(i, r.uniform(-3, 3), r.uniform(-3, 3)) for i in range(60)], "id int, x double, y double")
    got = {(x["id"], x["r_id"]) for x in join.within(pts, pts, "x", "y", 0.7).collect()}
    rows = pts.collect()
    assert got == {(p["id"], q["id"]) for p in rows for q in rows if math.hypot(p["x"] - q["x"], p["y"] - q["y"]) <= 0.7}
    left = spark.createDataFrame([("k", 5), ("k", 1), ("j", 9)], "key string, t int")
    right = spark.createDataFrame([("k", 2, 20), ("k", 5, 50)], "key string, t int, v int")
    assert {tuple(x) for x in join.as_of(left, right, "t", ["key"], ["v"]).collect()} == {("k", 5, 50), ("k", 1, None), ("j", 9, None)}


def test_radius_copies_are_few_and_not_broadcast(spark, tmp_path):
    spark.range(500).select("id", (c("id") % 25 * 0.5).alias("x"), F.floor(c("id") / 25).cast("double").alias("y")).write.parquet(str(tmp_path / "grid"))
    pts = spark.read.parquet(str(tmp_path / "grid"))
    pairs = join.within(pts, pts, "x", "y", 1.0)
    exchanges = moved(pairs)
    assert {kind for kind, _ in exchanges} == {"ShuffleExchangeExec"} and sum(n for _, n in exchanges) <= 6 * 500
    rows = pts.collect()
    met = [(p["id"], q["id"]) for p in rows for q in rows if math.hypot(p["x"] - q["x"], p["y"] - q["y"]) <= 1]
    assert sorted((p["id"], p["r_id"]) for p in pairs.collect()) == sorted(met)


def test_radius_edges(spark):
    pts = spark.createDataFrame([(0, -0.5, 0.0), (1, 0.5, 0.0), (2, None, 0.0), (3, float("nan"), 0.0), (4, float("inf"), 0.0), (5, 0.0, float("-inf")), (6, 1e300, 0.0)], "id int, x double, y double")
    assert sorted((p["id"], p["r_id"]) for p in join.within(pts, pts, "x", "y", 1.0).collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (6, 6)]
    assert join.within(pts.limit(0), pts, "x", "y", 1.0).collect() == []


# ------------------------------------------------------------------------------------------------ groups


def test_groups(spark):
    v = vec(spark, [-3, 5, -3, 5, 0], "int")
    assert {r["v"]: r["_pos"] for r in agg.group(v, "v").collect()} == {-3: [0, 2], 0: [4], 5: [1, 3]}
    letters = vec(spark, list("mississippi"), "string")
    assert {r["v"]: r["_pos"] for r in agg.group(letters, "v").collect()} == {"i": [1, 4, 7, 10], "m": [0], "p": [8, 9], "s": [2, 3, 5, 6]}
    assert [r["n"] for r in agg.freq(vec(spark, [1, 1, 2, 3, 3, 3], "int"), "v").orderBy("v").collect()] == [2, 1, 3]
    assert [r["v"] for r in agg.distinct_first(vec(spark, [3, 1, 3, 2, 1], "int"), "v").orderBy("pos").collect()] == [3, 1, 2]
    scores = generate.literal(spark, {"p": list("xyxy"), "s": [1, 4, 8, 5]})
    folded = {r["p"]: (r["m"], r["t"]) for r in agg.fold(scores, ["p"], ("max", "s", "m"), ("sum", "s", "t")).collect()}
    assert folded == {"x": (8, 9), "y": (5, 9)}
    assert agg.argmax(vec(spark, [1, 9, 9, 2], "int"), [], "v").first()["k"] == 1 and agg.argmin(vec(spark, [1, 9, 1], "int"), [], "v").first()["k"] == 0
    d = dct(spark, ["a", "b", "c"], [1, 2, 1], "string", "int")
    assert {r["v"]: r["k"] for r in agg.group_dict(d).collect()} == {1: ["a", "c"], 2: ["b"]}
    assert [r["w"] for r in agg.histogram(vec(spark, [0, 2, 2], "int"), c("v"), c("v") * 1.5, 4).orderBy("b").collect()] == [0.0, 0.0, 6.0, 0.0]


# ------------------------------------------------------------------------------------------------ windows, in small blocks


@pytest.mark.parametrize("block", [2, 3, 1000])
def test_windows_do_not_depend_on_blocks(spark, block):
    r = random.Random(block)
    data = [r.choice([None, *range(-5, 6)]) for _ in range(23)]
    v = vec(spark, data, "int").repartition(3)
    clean = [x for x in data]

    def folds(f):
        out, held = [], None
        for x in clean:
            held = x if held is None else held if x is None else f(held, x)
            out.append(held)
        return out

    for name, f in (("sum", lambda a, b: a + b), ("min", min), ("max", max)):
        assert values(window.running(v, "v", name, "o", block=block), "o") == folds(f)
    full = vec(spark, list(range(1, 24)), "int")
    assert values(window.each_prior(full, "v", lambda a, b: a - b, "o", block=block), "o") == [1] * 23
    assert values(window.each_prior(full, "v", lambda a, b: a - b, "o", seed=10, block=block), "o") == [-9] + [1] * 22
    assert values(window.stencil(full, "v", 3, "sum", "o", block=block), "o") == [3 * i + 6 for i in range(21)]
    assert values(window.shift(full, "v", 1, "o", fill=0, block=block), "o") == list(range(23))
    flags = [x is not None and x > -2 for x in data]
    runs, start = [], None
    for i, on in enumerate([*flags, False]):
        if on and start is None:
            start = i
        elif not on and start is not None:
            runs.append((start, i - start))
            start = None
    assert sorted(tuple(x) for x in window.runs(v, F.coalesce(c("v") > -2, F.lit(False)), block=block).collect()) == runs


@pytest.mark.parametrize("n", [2, 4, 6, 12, 40])
@pytest.mark.parametrize("keyed", [False, True])
def test_windows_wider_than_a_block(spark, n, keyed):
    """Widths of half a block, one, one and a half, three, and more than the table has, against plain Python."""
    data = [(i * 7) % 13 - 4 for i in range(25)]
    key = [i % 3 if i % 5 else 0 for i in range(25)] if keyed else [0] * 25
    v = vec(spark, data, "int").withColumn("k", F.element_at(F.array(*map(F.lit, key)), (c("_pos") + 1).cast("int"))).repartition(3)
    how = {"block": 4, "keys": ["k"] if keyed else []}

    def by_hand(f):
        out = {}
        for k in set(key):
            at = [i for i in range(25) if key[i] == k]
            for j, i in enumerate(at):
                made = f([data[x] for x in at], j)
                if made is not None:
                    out[i] = made
        return [out[i] for i in sorted(out)]

    trailing = lambda fold: by_hand(lambda x, j: fold(x[max(0, j - n + 1) : j + 1]))
    full = lambda fold: by_hand(lambda x, j: fold(x[j : j + n]) if j + n <= len(x) else None)
    assert values(window.mavg(v, "v", n, "o", **how), "o") == pytest.approx(trailing(lambda x: sum(x) / n))
    assert values(window.mmax(v, "v", n, "o", **how), "o") == trailing(max)
    assert values(window.mmin(v, "v", n, "o", **how), "o") == trailing(min)
    assert values(window.stencil(v, "v", n, "sum", "o", **how), "o") == full(sum)
    assert values(window.windows(v, "v", n, "o", **how), "o") == full(list)
    assert values(window.shift(v, "v", n, "o", fill=99, **how), "o") == by_hand(lambda x, j: x[j - n] if j >= n else 99)
    assert values(window.shift(v, "v", -n, "o", fill=99, **how), "o") == by_hand(lambda x, j: x[j + n] if j + n < len(x) else 99)
    running = by_hand(lambda x, j: sum(x[: j + 1]))
    assert values(window.running(v, "v", "sum", "o", **how), "o") == running


def test_as_of_over_ranges_of_a_hot_key(spark):
    r = random.Random(5)
    left = [(i, r.choice("aaab"), r.randrange(100)) for i in range(80)]
    right = [(r.choice("aaac"), t, t * 10) for t in r.sample(range(100), 40)]
    a = spark.createDataFrame(left, "id int, k string, t int").repartition(3)
    b = spark.createDataFrame(right, "k string, t int, p int")
    want = {i: max(((t2, p) for k2, t2, p in right if k2 == k and t2 <= t), default=(None, None))[1] for i, k, t in left}
    assert {x["id"]: x["p"] for x in join.as_of(a, b, "t", ["k"], ["p"]).collect()} == want


def test_geometric_product(spark):
    """The axioms of projective space: squares of the directions, anticommutation, associativity."""
    from posframe.functions import numeric

    r = random.Random(3)
    made = lambda: [float(r.randint(-3, 3)) for _ in range(16)]
    lit = lambda x: F.array(*map(F.lit, x))
    blade = lambda m: [float(i == m) for i in range(16)]
    a, b, d = made(), made(), made()
    product = lambda *of: spark.range(1).select(*[numeric.geometric(lit(x), lit(y)).alias(f"p{i}") for i, (x, y) in enumerate(of)]).first()
    ab, bd = product((a, b), (b, d))
    assert product((ab, d))[0] == product((a, bd))[0]
    pairs = [(1 << i, 1 << j) for i in range(4) for j in range(4)]
    row = {"p": product(*[(blade(x), blade(y)) for x, y in pairs])}
    got = {xy: p for xy, p in zip(pairs, row["p"])}
    for i in range(4):
        assert got[1 << i, 1 << i] == [0.0 if i == 0 else 1.0] + [0.0] * 15
        for j in range(i):
            assert got[1 << i, 1 << j] == [-x for x in got[1 << j, 1 << i]] and any(got[1 << i, 1 << j])


def test_window_golden_values(spark):
    v = vec(spark, [1, 3, 5, 7, 9], "int")
    assert [round(x, 3) for x in values(window.mavg(v, "v", 3, "o"), "o")] == [0.333, 1.333, 3.0, 5.0, 7.0]
    assert values(window.mmax(vec(spark, [1, 3, 2, 4, 5], "int"), "v", 3, "o"), "o") == [1, 3, 3, 4, 5]
    assert values(window.mmin(vec(spark, [5, 3, 4, 1, 2], "int"), "v", 3, "o"), "o") == [5, 3, 3, 1, 1]
    assert values(window.windows(vec(spark, [1, 2, 3, 4, 5], "int"), "v", 3, "o"), "o") == [[1, 2, 3], [2, 3, 4], [3, 4, 5]]
    assert values(window.windows(vec(spark, [1, 2], "int"), "v", 3, "o"), "o") == []
    assert values(window.running(vec(spark, [1, 2, 3], "int"), "v", "sum", "o", seed=10), "o") == [11, 13, 16]
    assert cell(spark, window.scan(lit(1, 2, 3), lambda a, x: a * 10 + x)) == [1, 12, 123]
    assert cell(spark, window.scan(lit(1, 2, 3), lambda a, x: a + x, F.lit(10))) == [11, 13, 16]
    assert cell(spark, window.overlapping(lit(1.0, 2.0, 3.0, 4.0, 5.0), 2, 2)) == [[1.0, 2.0], [3.0, 4.0]]


# ------------------------------------------------------------------------------------------------ order


def test_grade(spark):
    v = vec(spark, [3, 1, 2, 1, 3], "int")
    by = lambda df: [r["_pos"] for r in df.orderBy("r").collect()]
    assert by(sort.grade(v, "v")) == [1, 3, 2, 0, 4] and by(sort.grade(v, "v", desc=True)) == [0, 4, 2, 1, 3]
    assert by(sort.grade(v.repartition(3), "v", ranges=3)) == [1, 3, 2, 0, 4]
    f = vec(spark, [2.0, float("nan"), None, 1.0], "double")
    assert by(sort.grade(f, "v"))[2:] == [3, 0] and by(sort.grade(f, "v", desc=True))[:2] == [0, 3]
    t = generate.literal(spark, {"a": [1, 1, 2], "b": ["z", "y", "x"]})
    assert by(sort.grade(t, "a", "b")) == [1, 0, 2] and by(sort.grade(t, "a", "b", desc=True)) == [2, 0, 1]
    assert values(sort.sort(v, "v")) == [1, 1, 2, 3, 3]
    assert sorted(values(sort.shuffle(v, 5))) == [1, 1, 2, 3, 3] and values(sort.shuffle(v, 5)) == values(sort.shuffle(v.repartition(4), 5))


def test_numbering_of_many_ranges(spark):
    data = list(range(200))
    random.Random(2).shuffle(data)
    df = spark.createDataFrame([(x,) for x in data], "x int").repartition(7)
    got = position.numbered(df, "x", ranges=9).collect()
    assert all(r["x"] == r["_pos"] for r in got) and len(got) == 200


def test_cut_reshape(spark):
    letters = vec(spark, list("abcde"), "string")
    assert cell(spark, cells.cut(lit(*"abcde"), [2, 4, 4])) == [["c", "d"], [], ["e"]]
    got = sort.cut_fold(letters, [2, 4, 4], F.count("v").alias("n")).orderBy("seg").collect()
    assert [r["n"] for r in got] == [2, 0, 1]
    assert [r["r"] for r in sort.reshape(letters, "v", 2).orderBy("row").collect()] == [["a", "b"], ["c", "d"], ["e"]]
    assert cell(spark, sort.reshape_cell(lit(1, 2, 3), 2, 2)) == [[1, 2], [3, 1]]
    assert [r["v"] for r in sort.top(vec(spark, [3, 9, 9, 1], "int"), 2, "v").collect()] == [9, 9]


def test_cut_fold_moves_partial_folds(spark):
    rows = spark.range(0, 4000, 1, 4).select(c("id").alias("_pos"), F.when(c("id") % 7 > 0, c("id") * 0.5).alias("v"))
    starts = [10, 30, 30, 50, 9000]
    got = sort.cut_fold(rows, starts, F.count("v").alias("n"), F.sum("v"), F.count("*").alias("n"), F.collect_list(F.when(c("seg") < 2, c("_pos"))).alias("p"))
    assert got.columns == ["seg", "n", "sum(v)", "n", "p"]
    want = []
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], 10**9])):
        inside = [p for p in range(4000) if a <= p < b]
        kept = [p * 0.5 for p in inside if p % 7]
        want.append((i, len(kept), sum(kept) if kept else None, len(inside), inside if i < 2 else []))
    assert sorted((*r[:4], sorted(r[4])) for r in got.collect()) == want
    assert sum(n for _, n in moved(sort.cut_fold(rows, starts, F.sum("v").alias("s")))) < 60
    nothing = sort.cut_fold(rows.limit(0), starts, F.count("v").alias("n"), F.sum("v").alias("s")).orderBy("seg").collect()
    assert [tuple(r) for r in nothing] == [(i, 0, None) for i in range(5)]


def test_sets(spark):
    a, b = vec(spark, [1, 2, 2, 3], "int"), vec(spark, [2, 4], "int")
    v = lambda df: sorted(r["v"] for r in df.select("v").collect())
    assert v(sets.intersect(a, b, "v")) == [2, 2] and v(sets.without(a, b, "v")) == [1, 3]
    assert v(sets.symmetric(a, b, "v")) == [1, 3, 4] and not sets.subset(b, a, "v")
    assert cell(spark, sets.powerset(lit("a", "b"))) == [[], ["a"], ["b"], ["a", "b"]]
    assert sets.gray_code(2) == [0, 1, 3, 2]
    assert sorted(r["c"] for r in sets.combinations(vec(spark, [1, 2, 3], "int"), "v", 2).collect()) == [[1, 2], [1, 3], [2, 3]]


# ------------------------------------------------------------------------------------------------ scalars


def test_arithmetic(spark):
    pairs = [(a, b) for a in (-8, -7, 0, 7, 9) for b in (-3, -1, 1, 3)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = df.select("a", "b", arith.fdiv(c("a"), c("b")).alias("d"), arith.fmod(c("a"), c("b")).alias("m")).collect()
    assert all((r["d"], r["m"]) == (r["a"] // r["b"], r["a"] % r["b"]) for r in got)
    assert cell(spark, arith.fdiv(F.lit((1 << 62) + 1), 1)) == (1 << 62) + 1
    assert cell(spark, arith.add32(F.lit(2**31 - 1), F.lit(1))) == -(2**31)
    assert cell(spark, arith.mul32(F.lit(65536), F.lit(65537))) == 65536
    assert cell(spark, arith.divide(F.lit(1), F.lit(0))) is None and cell(spark, arith.divide(F.lit(-1), F.lit(0), True)) == float("-inf")
    assert [cell(spark, d) for d in arith.encode(F.lit(3723), [24, 60, 60])] == [1, 2, 3]
    assert cell(spark, arith.decode([F.lit(1), F.lit(2), F.lit(3)], [24, 60, 60])) == 3723
    assert cell(spark, arith.digits(F.lit(1000), 10)) == [1, 0, 0, 0] and cell(spark, arith.digits(F.lit(-6), 2)) == [1, 1, 0]
    assert [cell(spark, arith.fibonacci(F.lit(n))) for n in range(8)] == [0, 1, 1, 2, 3, 5, 8, 13]
    assert cell(spark, arith.choose(F.lit(10), F.lit(4))) == 210 and cell(spark, arith.catalan(F.lit(5))) == 42
    assert cell(spark, arith.morton(F.lit(3), F.lit(5))) == 0b100111
    assert cell(spark, arith.smoothstep(F.lit(0.0), F.lit(2.0), F.lit(1.0))) == 0.5
    assert cell(spark, arith.lesser(F.lit(float("nan")), F.lit(2.0))) == 2.0
    assert cell(spark, arith.cast(F.lit("x1"), "int")) is None and cell(spark, arith.cast(F.lit(-5), "natural")) == 0


def test_strings(spark):
    s = lambda f: cell(spark, f)
    assert s(text.pad(F.lit("abc"), 5)) == "abc  " and s(text.pad(F.lit("abc"), -5)) == "  abc"
    assert s(text.pad(F.lit("abcdef"), 3)) == "abc" and s(text.pad(F.lit("abcdef"), -3)) == "def"
    assert s(text.split(F.lit("a.b..c."), ".")) == ["a", "b", "", "c", ""] and s(text.join(text.split(F.lit("a.b..c."), "."), ".")) == "a.b..c."
    assert s(text.index_of(F.lit("hello"), "l")) == 2 and s(text.index_of(F.lit("hello"), "z")) == 5
    assert s(text.test(F.lit("ab\n"), "ab")) is False and s(text.test(F.lit("aab"), "a+b")) is True
    assert s(text.sub(F.lit("a1b2"), "[0-9]", "$")) == "a$b2" and s(text.sub_all(F.lit("a1b2"), "[0-9]", "\\")) == "a\\b\\"
    assert s(text.regex_find(F.lit("xxab"), "ab")) == 2 and s(text.regex_all(F.lit("a1b22"), "[0-9]+")) == ["1", "22"]
    assert s(text.tokens(F.lit("  a  bc "))) == ["a", "bc"] and s(text.upper(F.lit("aé"))) == "Aé"
    assert s(text.zeros(F.lit(7), 3)) == "007" and s(text.decimals(F.lit(1.005), 1)) == "1.0" and s(text.percent(F.lit(0.25))) == "25%"
    docs = spark.createDataFrame([(1, "red fish"), (2, "blue fish fish"), (3, "red")], "id int, t string")
    assert {r["id"] for r in text.bm25(docs, "id", "t", ["fish"]).collect()} == {1, 2}
    assert text.postings(docs, "id", "t").filter("term = 'fish'").count() == 3


def test_cells(spark):
    s = lambda f: cell(spark, f)
    assert s(cells.grade(lit(3, 1, 2, 1, 3))) == [1, 3, 2, 0, 4] and s(cells.grade(lit(3, 1, 2, 1, 3), True)) == [0, 4, 2, 1, 3]
    assert s(cells.take(lit(1, 2, 3), 5)) == [1, 2, 3, 1, 2] and s(cells.take(lit(1, 2, 3), -4)) == [3, 1, 2, 3] and s(cells.drop(lit(1, 2, 3), -2)) == [1]
    assert s(cells.find(lit(3, 1, 4), F.lit(9))) == 3 and s(cells.where(lit(True, False, True))) == [0, 2]
    assert s(cells.windows(lit(1, 2, 3), 2)) == [[1, 2], [2, 3]] and s(cells.windows(lit(1), 2)) == []
    assert s(cells.without(lit(1, 2, 2, 3), lit(2))) == [1, 3] and s(cells.iota(3)) == [0, 1, 2] and s(cells.iota(0)) == []
    with pytest.raises(Exception, match="!length"):
        s(cells.zip_(lit(1, 2), lit(1), lambda a, b: a + b))
    with pytest.raises(Exception, match="!index"):
        s(cells.pick(lit(1, 2), lit(5)))
    m, n = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(9), F.lit("c"), F.lit(3))
    assert list(s(cells.merge(m, n)).items()) == [("a", 1), ("b", 9), ("c", 3)]
    with pytest.raises(Exception, match="!length"):
        s(cells.dict_op(m, n, lambda a, b: a + b))
    assert s(cells.json_value(F.lit('{"a":{"b":7}}'), "$.a.b", "int")) == 7
    assert s(cells.flatten(F.array(F.array(lit(1), lit(2, 3))), 2)) == [1, 2, 3]
    assert s(cells.each_left(lit(1, 2), lit(10, 20), lambda a, y: F.aggregate(y, F.lit(0), lambda t, b: t + a * b))) == [30, 60]


def test_hashes(spark):
    import gzip
    import hashlib
    import hmac
    import zlib

    x = F.lit("hello")
    s = lambda f: cell(spark, f)
    assert s(hashes.digest(x, "blake2b")) == hashlib.blake2b(b"hello").hexdigest()
    assert s(hashes.hmac(x, b"k")) == hmac.new(b"k", b"hello", "sha256").hexdigest()
    assert s(hashes.pbkdf2(x, b"salt", 10)) == hashlib.pbkdf2_hmac("sha256", b"hello", b"salt", 10).hex()
    assert len(s(hashes.hkdf(x, b"salt", b"info", 42))) == 84
    assert s(hashes.crc32(x)) == zlib.crc32(b"hello") and s(hashes.adler32(x)) == zlib.adler32(b"hello")
    assert zlib.decompress(bytes(s(hashes.compress(x)))) == b"hello" and gzip.decompress(bytes(s(hashes.compress(x, "gzip")))) == b"hello"
    assert bytes(s(hashes.decompress(hashes.compress(x, "deflate"), "deflate"))) == b"hello"


def test_numeric(spark):
    import numpy as np

    s = lambda f: cell(spark, f)
    assert s(numeric.softmax(lit(1.0, 1.0))) == [0.5, 0.5] and s(numeric.relu(lit(-1.0, 2.0))) == [0.0, 2.0]
    assert abs(sum(s(numeric.layernorm(lit(1.0, 2.0, 3.0))))) < 1e-9 and s(numeric.cross(lit(1.0, 0.0, 0.0), lit(0.0, 1.0, 0.0))) == [0.0, 0.0, 1.0]
    x = [1.0, 2.0, 0.5, -1.0]
    assert np.allclose(s(numeric.fft(lit(*x))), np.fft.fft(x).view(float)) and np.allclose(s(numeric.ifft(numeric.fft(lit(*x))))[::2], x)
    assert np.allclose(s(numeric.solve(lit(2.0, 1.0, 1.0, 3.0), lit(3.0, 5.0))), [0.8, 1.4]) and s(numeric.solve(lit(0.0, 0.0, 0.0, 0.0), lit(1.0, 1.0))) is None
    flat = s(numeric.plu(lit(0.0, 2.0, 1.0, 3.0), 2))
    perm, low, up = flat[:2], np.reshape(flat[2:6], (2, 2)), np.reshape(flat[6:], (2, 2))
    assert np.allclose(low @ up, np.array([[0.0, 2.0], [1.0, 3.0]])[[int(p) for p in perm]])
    assert np.allclose(s(numeric.singular_values(lit(3.0, 0.0, 0.0, 4.0), 2)), [4, 3]) and s(numeric.condition(lit(3.0, 0.0, 0.0, 4.0), 2)) == pytest.approx(4 / 3)
    assert len(s(numeric.log_mel(F.transform(F.sequence(F.lit(1), F.lit(800)), lambda i: F.sin(i.cast("double"))), 8000, 10))) == 30
    assert np.allclose(s(numeric.fft2(lit(*x), 2)), np.fft.fft2(np.reshape(x, (2, 2))).ravel().view(float))
    assert s(numeric.diagonal(lit(1, 2))) == [[1.0, 0.0], [0.0, 2.0]] and s(numeric.frames(lit(1.0, 2.0, 3.0), 2, 1, 0.5)) == [[1.0, 1.5], [1.5, 2.0]]
    assert np.allclose(s(numeric.gelu(lit(1.0)))[0], 0.841192) and np.allclose(s(numeric.glu(lit(2.0, 0.0))), [1.0])


# ------------------------------------------------------------------------------------------------ iteration, entities


def test_iteration(spark):
    assert cell(spark, iterate.states_cell(F.lit(3), lambda x: F.when(x % 2 == 0, (x / 2).cast("int")).otherwise(3 * x + 1), lambda x: x != 1, 50)) == [3, 10, 5, 16, 8, 4, 2, 1]
    assert cell(spark, iterate.states_cell(F.lit(100), lambda x: (x / 2).cast("int"), lambda x: x != 0, 50)) == [100, 50, 25, 12, 6, 3, 1, 0]
    assert cell(spark, iterate.n_do_cell(F.lit(1), 5, lambda x: x * 2)) == 32
    v = vec(spark, [1, 2], "int")
    assert values(iterate.n_do(v, 3, lambda t: t.withColumn("v", c("v") * 2), every=2)) == [8, 16]
    assert values(iterate.while_do(v, lambda t: t.agg(F.max("v")).first()[0] < 10, lambda t: t.withColumn("v", c("v") * 2))) == [8, 16]
    assert values(iterate.converge(v, lambda t: t.withColumn("v", F.least(c("v") + 1, F.lit(4))))) == [4, 4]
    parents = vec(spark, [0, 0, 1, 2, -1, 4, 99, 3], "bigint")
    assert values(iterate.depth(parents), "depth") == [0, 1, 2, 3, 0, 1, 0, 4]
    with pytest.raises(EngineError, match="cycle"):
        iterate.depth(vec(spark, [1, 2, 0], "bigint"))
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "a int, b int")
    assert sorted(r["n"] for r in iterate.closure(edges, spark.createDataFrame([(1,)], "n int")).collect()) == [1, 2, 3]


def test_world(spark):
    w = World(spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, px double"), "id")
    w = w.spawn(spark.createDataFrame([(3, 3.0)], "id int, px double")).put(spark.createDataFrame([(2, 9.0), (4, 4.0)], "id int, px double"))
    assert {tuple(r) for r in w.get("id", "px").collect()} == {(1, 1.0), (2, 9.0), (3, 3.0), (4, 4.0)}
    w = w.remove(1).despawn(c("px") > 8).tick(lambda t: t.withColumn("px", c("px") + 1))
    assert {tuple(r) for r in w.get("id", "px").collect()} == {(3, 4.0), (4, 5.0)} and w.count(c("px") > 4.5) == 1 and w.one(9) is None
    with pytest.raises(EngineError):
        w.spawn(spark.createDataFrame([(3,)], "id int"))


def test_user_functions(spark):
    from posframe.functions import udf

    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 5.0)], "k string, _pos bigint, v double")
    twice = udf.vectorised(lambda x, y: x * 2 + y, "double")
    assert sorted(r["o"] for r in df.select(twice(c("v"), c("_pos")).alias("o")).collect()) == [3.0, 6.0, 11.0]
    spread = udf.folding(lambda x: x.max() - x.min())
    assert {r["k"]: r["o"] for r in df.groupBy("k").agg(spread(c("v")).alias("o")).collect()} == {"a": 1.0, "b": 0.0}
    udf.registered(spark, "plus_one", lambda x: x + 1, "double")
    assert spark.sql("select plus_one(2.0D) x").first()["x"] == 3.0
    assert udf.rows_to_rows(df, lambda p: p[p.v > 1][["k"]], "k string").count() == 2
    assert udf.train(lambda x: x + 1, lambda x: x * 2)(5) == 11 and udf.projection(lambda a, b: a - b, b=2)(5) == 3
    assert udf.pipeline(df, [lambda t: t.filter("v > 1"), lambda t: t.select("k")]).count() == 2
    with pytest.raises(EngineError):
        twice(*[c("v")] * 17)
    got = window.scan_groups(df, "v", lambda a, b: a * 10 + b, "o", keys=["k"]).orderBy("k", "_pos").collect()
    assert [r["o"] for r in got] == [1.0, 12.0, 5.0]


def test_zero(spark):
    from pyspark.sql import types as T

    assert cell(spark, zero_of(T.StringType())) == "" and cell(spark, zero_of(T.DoubleType())) == 0.0
