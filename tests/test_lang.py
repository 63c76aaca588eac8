"""The language on driver values, and on tables against the same words over the same values on the driver."""

import math

import pytest

from posframe import EngineError
from posframe.lang import Dict, Session, Sym

INF = math.inf
GOLDEN = [
    ("2*3+4", 14), ("1 2 3+10", [11, 12, 13]), ("+/1 2 3", 6), ("+\\1 2 3", [1, 3, 6]), ("10+\\1 2 3", [11, 13, 16]), ("-':12 13 11 17 14", [12, 1, -2, 6, -3]),
    ("10-':12 13 11 17 14", [2, 1, -2, 6, -3]), ("=1 2 1", Dict([1, 2], [[0, 2], [1]])), ("=\"mississippi\"", Dict(["i", "m", "p", "s"], [[1, 4, 7, 10], [0], [8, 9], [2, 3, 5, 6]])),
    ("#'=1 1 2 3 3 3", Dict([1, 2, 3], [2, 1, 3])), ("<3 1 2 1 3", [1, 3, 2, 0, 4]), (">3 1 2 1 3", [0, 4, 2, 1, 3]), ("?3 1 3 2 1", [3, 1, 2]), ("3 1 4?4 9 3", [2, 3, 0]),
    ("2 4 4_\"abcde\"", ["cd", "", "e"]), ("24 60 60\\3723", [1, 2, 3]), ("24 60 60/1 2 3", 3723), ("3'1 2 3 4 5", [[1, 2, 3], [2, 3, 4], [3, 4, 5]]), ("2(+/)'1 2 3 4", [3, 5, 7]),
    ("{x*2}3", 6), ("{[a;b]a-b}[5;3]", 2), ("f:{x+y};f[1;2]", 3), ("f:{x+y};f[;2]1", 3), ("(1;`a;\"bc\")", [1, Sym("a"), "bc"]), ("`a`b!1 2", Dict([Sym("a"), Sym("b")], [1, 2])),
    ("(`a`b!1 2)`b", 2), ("(`a`b!1 2),`b`c!3 4", Dict([Sym("a"), Sym("b"), Sym("c")], [1, 3, 4])), ("&1 0 1", [0, 2]), ("&2 0 1", [0, 0, 2]), ("3#1 2", [1, 2, 1]), ("-2#1 2 3", [2, 3]),
    ("1_1 2 3", [2, 3]), ("|1 2 3", [3, 2, 1]), ("!4", [0, 1, 2, 3]), ("!2 3", [[0, 0, 0, 1, 1, 1], [0, 1, 2, 0, 1, 2]]), ("\",\"\\\"a,b,c\"", ["a", "b", "c"]), ("\",\"/(\"a\";\"b\")", "a,b"),
    ("$[1>2;`a;`b]", Sym("b")), ("(+/x)%#x:1 2 3 4", 2.5), ("{x>1}{$[1=x mod 2;1+3*x;x div 2]}\\3", [3, 10, 5, 16, 8, 4, 2, 1]), ("{x div 2}\\100", [100, 50, 25, 12, 6, 3, 1, 0]),
    ("3{x*2}/1", 8), ("1 2 3 in 2 5", [False, True, False]), ("x:1 2 3;x[1]:9;x", [1, 9, 3]), ("@[1 2 3;0 2;+;10]", [11, 2, 13]), ("?[1 2 3;1 2;7 8]", [1, 7, 8, 3]), ("7 mod -3", -2), ("-7 div 2", -4),
    ("1%0", INF), ("2 3#!6", [[0, 1, 2], [3, 4, 5]]), ("+(1 2;3 4)", [[1, 3], [2, 4]]), ("*|1 2 3", 3), ("5$\"abc\"", "abc  "), ("-5$\"abc\"", "  abc"), ("`I$\"12\"", 12), ("_2.7", 2),
    ("2 3^1 2 3 2", [1]), ("0^1 0N 3", [1, 0, 3]), ("+/'(1 2;3 4)", [3, 7]), ("1 2 3+/:10 20", [[11, 12, 13], [21, 22, 23]]), ("f:2+;f 3", 5), ("avg 1 2 3", 2.0), ("2147483647+1", -2147483648),
    ("\"abc\"=\"abd\"", [True, True, False]), ("1 2 3 /a comment", [1, 2, 3]), ("2-1", 1), ("2 -1", [2, -1]), ("a:5;a-1", 4), ("1 2~1 2", True), ("&/1 0 2", 0), ("%2 3#0", [2, 3]), ("+/101b", 2), (".\"1+2\"", 3), ("a:7;.`a", 7), ("@.\"1 2+1 2 3\"", Sym("!")),
]


@pytest.mark.parametrize("source, want", GOLDEN)
def test_driver_values(source, want):
    assert Session().collect(source) == want


@pytest.mark.parametrize("source, kind", [("1 2+1 2 3", "length"), ("(1 2 3)9", "index"), ("nope", "value"), ("!`oops", "oops"), ("{x}[1;2]", "rank"), ("x:1 2 3;x[0]:1.5;x", "type"), ("-4?3", "length")])
def test_errors_have_kinds(source, kind):
    with pytest.raises(EngineError) as e:
        Session()(source)
    assert e.value.kind == kind


@pytest.fixture(scope="module")
def s(spark):
    session = Session(spark)
    rows = [(i, "abcab"[i % 5], float((i * 7) % 11) - 3, i % 4) for i in range(40)]
    session.table("t", spark.createDataFrame(rows, "id bigint, k string, v double, n bigint").repartition(3), pos="id")
    for name, i in (("id", 0), ("k", 1), ("v", 2), ("n", 3)):
        session.globals[name] = [Sym(r[i]) if i == 1 else r[i] for r in rows]
    return session


SAME = ["+/{v}", "|/{n}", "#{n}", "*{v}", "*|{v}", "&{v}>3", "+\\{n}", "-':{n}", "<{v}", ">{n}", "?{n}", "={n}", "#'={n}", "(+/)'{v}@={n}", "(|/)'{n}@={n}", "5#>{v}", "{v}@&{v}>3", "{v}@<{n}", "3(+/)'{n}", "avg {v}",
        "({v}*2)+{n}", "(+/{v}*{n})%+/{n}", "{n} in 1 3", "{n} mod 3", "sqrt {n}", "{n}?3", "$[{n}>2;1;0]", "3#{n}", "-3_{n}", "(+/{v}>3)%#{v}", "+/{v}>3", "&/{v}>-9", "~{n}", "-{v}", "{n}&2", "(avg)'{v}@={n}", "{{(+/x*x)%#x}}'{v}@={n}"]


def flat(x):
    if isinstance(x, Dict):
        return [flat(x.keys), flat(x.values)]
    if isinstance(x, list):
        return [flat(i) for i in x]
    return pytest.approx(float(x)) if isinstance(x, (int, float)) else str(x)


@pytest.mark.parametrize("source", SAME)
def test_tables_agree_with_driver_values(s, source):
    names = ("v", "n", "k", "id")
    on_table = source.format(**{n: f"t.{n}" for n in names})
    on_driver = source.format(**{n: n for n in names})
    if source.startswith("$["):
        want = [1 if x > 2 else 0 for x in s.globals["n"]]
    else:
        want = s.collect(on_driver)
    assert flat(s.collect(on_table)) == flat(want)


def test_tables(s, spark):
    assert s.collect("(t@&t.v>6)`id") == [i for i, x in enumerate(s.globals["v"]) if x > 6]
    assert s.collect("#t") == 40 and s.collect("!t") == ["id", "k", "v", "n"] and s.collect("t 3").values[0] == 3
    best = s.collect("t@3#>t.v")
    assert best.values[2] == [7.0, 7.0, 7.0] and best.values[0] == sorted(best.values[0])
    s("u:([]a:1 2 3;b:`x`y`z)")
    assert s.collect("u@2 0").values == [[3, 1], ["z", "x"]]
    s("k:([b:`y`z`q]a:20 30 40;c:5 6 7)")
    assert s.collect("u,k").values == [[1, 20, 30], ["x", "y", "z"], [0, 5, 6]]
    s("e:([s:`a`b]p:1 2)")
    assert s.collect("e,([s:`b`c]p:9 8)").values == [["a", "b", "c"], [1, 9, 8]]
    assert s.collect("e,`s`p!(`b;7)").values == [["a", "b"], [1, 7]]
    assert s.collect("(,`a)_e").values == [["b"], [2]]
    assert s.collect("@[u;`a;{x*10}]").values[0] == [10, 20, 30]
    assert s.collect("(2#u)`a") == [1, 2] and s.collect("(|u)`a") == [3, 2, 1] and s.collect("(>u)") == [2, 1, 0] and s.collect("u~u") is True
    with pytest.raises(EngineError):
        s("t`nope")


def test_a_grouped_fold_is_one_aggregation(s):
    plan = s("(+/)'t.v@=t.k").df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "collect_list" not in plan
    assert "TakeOrdered" in s("t@3#>t.v").df._jdf.queryExecution().executedPlan().toString() or "GlobalLimit" in s("t@3#>t.v").df._jdf.queryExecution().optimizedPlan().toString()
