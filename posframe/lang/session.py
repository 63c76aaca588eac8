"""Evaluation: names, functions, and the dispatch of verbs and adverbs on driver values and on Spark values."""

from __future__ import annotations

import functools
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arith as columns
from ..functions import text as strings
from ..model import POS, EngineError, Keyed
from ..operators import aggregate, join, project, window
from ..operators import position as places
from ..sources.generate import literal
from . import values as v
from .lazy import Fold, Frame, Grouped, Groups, Mapping, Order, Places, Series, fold_groups
from .parser import parse
from .values import Dict, Err, Fn, Sym

LIMIT = 10_000
SPARK = (Frame, Series, Fold, Places, Order, Groups, Grouped, Mapping)


# ------------------------------------------------------------------------------------------------ driver values

MONADS = {
    "+": v.flip,
    "-": lambda x: v.pervade1(lambda a: -a if isinstance(a, float) else v.wrap(-v.number(a)), x),
    "*": lambda x: (x.values[0] if x.values else None) if isinstance(x, Dict) else x[0] if v.is_list(x) and x else v.null_like(x) if v.is_list(x) else x,
    "%": v.shape,
    "&": v.where,
    "|": lambda x: Dict(x.keys[::-1], x.values[::-1]) if isinstance(x, Dict) else x[::-1] if v.is_list(x) else x,
    "<": lambda x: (lambda g: Dict([x.keys[i] for i in g], [x.values[i] for i in g]))(v.grade(x.values)) if isinstance(x, Dict) else v.grade(x),
    ">": lambda x: (lambda g: Dict([x.keys[i] for i in g], [x.values[i] for i in g]))(v.grade(x.values, True)) if isinstance(x, Dict) else v.grade(x, True),
    "=": lambda x: [[int(i == j) for j in range(x)] for i in range(x)] if isinstance(x, int) else v.group(x),
    "~": lambda x: v.pervade1(lambda a: a == 0 or (isinstance(a, float) and math.isnan(a)), x),
    "!": v.iota,
    ",": lambda x: x if isinstance(x, str) and len(x) == 1 and not isinstance(x, Sym) else [x],
    "^": lambda x: v.pervade1(v.is_null, list(x) if v.is_list(x) else x),
    "#": lambda x: len(x.keys) if isinstance(x, Dict) else len(x) if v.is_list(x) else 1,
    "_": lambda x: x.translate({i: i + 32 for i in range(65, 91)}) if isinstance(x, str) else v.pervade1(lambda a: math.floor(a) if isinstance(a, float) else a, x),
    "$": lambda x: [MONADS["$"](a) for a in x] if isinstance(x, list) else str(x) if isinstance(x, str) else v.text(x),
    "?": v.distinct,
    "@": v.type_of,
    ".": lambda x: x.values if isinstance(x, Dict) else x,
    ":": lambda x: x,
    "sqrt": lambda x: v.pervade1(lambda a: math.sqrt(a) if a >= 0 else math.nan, x),
    "exp": lambda x: v.pervade1(math.exp, x),
    "log": lambda x: v.pervade1(lambda a: math.log(a) if a > 0 else -math.inf if a == 0 else math.nan, x),
    "sin": lambda x: v.pervade1(math.sin, x),
    "cos": lambda x: v.pervade1(math.cos, x),
    "abs": lambda x: v.pervade1(abs, x),
    "sqr": lambda x: v.pervade1(lambda a: a * a if isinstance(a, float) else v.wrap(a * a), x),
    "avg": lambda x: sum(x) / len(x),
    "var": v.variance,
    "std": lambda x: math.sqrt(v.variance(x)),
    "med": v.median,
    "sort": lambda x: v.index(x, v.grade(x)),
}


def cast(kind, y):
    if isinstance(kind, int) and isinstance(y, str):
        return v.pad(kind, y)
    name = str(kind)
    if name == "I" and isinstance(y, str):
        try:
            return int(y)
        except ValueError:
            return v.NULL_INT
    if name == "F" and isinstance(y, str):
        try:
            return float(y)
        except ValueError:
            return math.nan
    makers = {"i": lambda a: int(v.number(a)), "f": lambda a: float(v.number(a)), "b": lambda a: bool(a), "c": lambda a: chr(a), "s": lambda a: Sym(a)}
    if name not in makers:
        raise EngineError("type", name)
    return Sym(y) if name == "s" and isinstance(y, str) else v.joined(v.pervade1(makers[name], list(y))) if v.is_list(y) else makers[name](y)


def query(x, y):
    """`x?y`: find; with an int on the left, y random picks."""
    if isinstance(x, int):
        r, pool = random.Random(0), list(range(y)) if isinstance(y, int) else v.items(y)
        if x < 0 and -x > len(pool):
            raise EngineError("length")
        return v.joined(r.sample(pool, -x) if x < 0 else [r.choice(pool) for _ in range(x)])
    return v.find(x, y)


def both(op):
    """min and max: a NaN loses."""

    def f(a, b):
        a, b = v.number(a), v.number(b)
        if isinstance(a, bool) and isinstance(b, bool):
            return bool(op(a, b))
        return b if isinstance(a, float) and math.isnan(a) else a if isinstance(b, float) and math.isnan(b) else op(a, b)

    return lambda x, y: v.pervade2(f, x, y)


DYADS = {
    "+": v.arith(lambda a, b: a + b),
    "-": v.arith(lambda a, b: a - b),
    "*": v.arith(lambda a, b: a * b),
    "%": lambda x, y: v.pervade2(v.divide, x, y),
    "mod": v.arith(lambda a, b: a % b),
    "div": v.arith(lambda a, b: a // b),
    "&": both(min),
    "|": both(max),
    "<": v.compare(lambda a, b: a < b),
    ">": v.compare(lambda a, b: a > b),
    "=": v.equal,
    "~": v.match,
    "!": v.pair,
    ",": v.concat,
    "^": v.fill,
    "#": v.take,
    "_": v.drop,
    "$": lambda x, y: Dict(y.keys, [cast(x, b) for b in y.values]) if isinstance(y, Dict) else [cast(x, b) for b in y] if isinstance(y, list) and (isinstance(x, int) or not y or isinstance(y[0], str)) else cast(x, y),
    "?": query,
    "@": v.index,
    ".": lambda x, y: functools.reduce(v.index, y, x),
    "in": v.member,
    "has": lambda x, y: v.member(y, x),
    ":": lambda x, y: y,
}


# ------------------------------------------------------------------------------------------------ Spark values

LAZY_MONADS = {
    "-": lambda c: -c,
    "~": columns.is_not,
    "^": columns.is_null,
    "_": lambda c: F.floor(c),
    "$": strings.fmt,
    "sqrt": F.sqrt,
    "exp": F.exp,
    "log": F.ln,
    "sin": F.sin,
    "cos": F.cos,
    "abs": F.abs,
    "sqr": lambda c: c * c,
    ":": lambda c: c,
}
LAZY_FOLDS = {"avg": F.avg, "var": F.var_samp, "std": F.stddev_samp, "med": F.median}
LAZY_DYADS = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "%": columns.divide,
    "mod": columns.fmod,
    "div": columns.fdiv,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "=": lambda a, b: a == b,
    "^": lambda a, b: F.coalesce(b, a),
    ":": lambda a, b: b,
}
FOLD_OF = {"+": "sum", "*": "product", "&": "min", "|": "max"}


def is_flag(s: Series | Fold) -> bool:
    return s.frame.plan(s.expr).select(s.expr.alias("v")).schema["v"].dataType.typeName() == "boolean"


def lazy_monad(verb: str, x):
    if isinstance(x, (Series, Fold)) and verb in LAZY_MONADS:
        return type(x)(x.frame, LAZY_MONADS[verb](x.expr))
    if isinstance(x, Series):
        pos = x.frame.pos
        if verb in LAZY_FOLDS:
            return Fold(x.frame, LAZY_FOLDS[verb](x.expr))
        if verb == "&":
            return Places(x.frame, x.expr)
        if verb in "<>":
            return Order(x.frame, [x.expr], verb == ">")
        if verb == "=":
            return Groups(x.frame, [x.expr])
        if verb == "#":
            return Fold(x.frame, F.count(F.lit(1)))
        if verb == "*":
            return Fold(x.frame, F.min_by(x.expr, pos))
        if verb == "|":
            return Series(Frame(places.reverse(x.frame.packed().df), POS, None, x.frame.names), x.expr)
        if verb == "?":
            first = x.frame.df.select(x.expr.alias("v"), F.col(pos).alias("_p")).groupBy("v").agg(F.min("_p").alias(POS))
            return Frame(first, POS, None, ["v"]).series("v")
        if verb == "sort":
            return lazy_index(x, Order(x.frame, [x.expr]))
    if isinstance(x, Frame):
        if verb == "#":
            return Fold(x, F.count(F.lit(1)))
        if verb == "!":
            return [Sym(n) for n in x.names]
        if verb == ".":
            return [x.series(n) for n in x.names]
        if verb == "+":
            return Dict([Sym(n) for n in x.names], [x.series(n) for n in x.names])
        if verb in "<>":
            return Order(x, [F.col(n) for n in x.names], verb == ">")
        if verb == "|":
            return Frame(places.reverse(x.packed().df), POS, x.key, x.names)
        if verb == "?":
            first = x.df.groupBy(*x.names).agg(F.min(x.pos).alias(POS))
            return Frame(first, POS, x.key, x.names)
        if verb == "@":
            return Sym("M")
    if isinstance(x, Order) and verb == "*":
        return Fold(x.frame, (F.max_by if x.desc else F.min_by)(F.col(x.frame.pos), F.struct(*x.by, -F.col(x.frame.pos) if x.desc else F.col(x.frame.pos))))
    if isinstance(x, Mapping) and verb in "<>":
        return Mapping(x.df.orderBy(F.col("v").desc() if verb == ">" else F.col("v"), *x.keys))
    if isinstance(x, Mapping) and verb == "#":
        return x.df.count()
    raise EngineError("nyi", f"{verb} of {type(x).__name__}")


def as_column(x) -> Column:
    if isinstance(x, (Series, Fold)):
        return x.expr
    if isinstance(x, (Sym, str)):
        return F.lit(str(x))
    return F.lit(x)


def same_frame(x, y) -> Frame:
    frames = {id(s.frame): s.frame for s in (x, y) if isinstance(s, (Series, Fold))}
    if len(frames) != 1:
        raise EngineError("length", "columns of different tables")
    return next(iter(frames.values()))


def lazy_index(x, i):
    if isinstance(x, Frame):
        if isinstance(i, Sym):
            return x.series(i)
        if isinstance(i, list) and i and all(isinstance(n, Sym) for n in i):
            return [x.series(n) for n in i]
        if isinstance(i, Places):
            return x.filtered(i.mask)
        if isinstance(i, Order):
            return i.frame_()
        if isinstance(i, Series) and is_flag(i):
            return x.filtered(i.expr)
        if isinstance(i, int):
            row = x.df.filter(F.col(x.pos) == i).select(*x.names).head(1)
            if not row:
                raise EngineError("index", str(i))
            return Dict([Sym(n) for n in x.names], list(row[0]))
        if isinstance(i, list):
            at = x.df.sparkSession.createDataFrame([(k, n) for k, n in enumerate(i)], f"{POS} bigint, v bigint")
            return Frame(places.at(x.df.withColumnRenamed(x.pos, POS) if x.pos != POS and x.pos not in x.names else x.df.withColumn(POS, F.col(x.pos)), at), POS, x.key, x.names)
    if isinstance(x, Series):
        if isinstance(i, Places):
            return Series(i.frame.filtered(i.mask), x.expr)
        if isinstance(i, Series) and is_flag(i):
            return Series(x.frame.filtered(i.expr), x.expr)
        if isinstance(i, Groups):
            return Grouped(x, i)
        if isinstance(i, Order):
            return Series(i.frame_(), x.expr)
        if isinstance(i, int):
            return Fold(x.frame, F.max(F.when(F.col(x.frame.pos) == i, x.expr)))
    if isinstance(x, Mapping):
        row = x.df.filter(F.col("k") == as_column(i)).head(1)
        return row[0]["v"] if row else v.NULL_INT
    raise EngineError("nyi", f"{type(x).__name__} at {type(i).__name__}")


def lazy_dyad(verb: str, x, y):
    if verb == "@":
        return lazy_index(x, y)
    columns_only = (Series, Fold)
    if isinstance(x, columns_only) or isinstance(y, columns_only):
        if verb in LAZY_DYADS and not (isinstance(x, (list, Dict, Frame)) or isinstance(y, (list, Dict, Frame))):
            frame = same_frame(x, y)
            return (Series if isinstance(x, Series) or isinstance(y, Series) else Fold)(frame, LAZY_DYADS[verb](as_column(x), as_column(y)))
        if verb in "&|":
            frame = same_frame(x, y)
            kind = Series if isinstance(x, Series) or isinstance(y, Series) else Fold
            a, b = as_column(x), as_column(y)
            flags = all(is_flag(s) if isinstance(s, columns_only) else isinstance(s, bool) for s in (x, y))
            made = (a & b if verb == "&" else a | b) if flags else (F.least(a, b) if verb == "&" else F.greatest(a, b))
            return kind(frame, made)
        if verb == "in" and isinstance(x, Series) and isinstance(y, (list, str)):
            return x.over(lambda c: project.member(c, [str(i) if isinstance(i, str) else i for i in v.items(y)]))
        if verb == "in" and isinstance(x, Series) and isinstance(y, Series):
            name = x.frame.with_column(x)
            return x.frame.derive(lambda df, out: project.member_of(df, name, y.frame.df.select(y.expr.alias("v")), out), F.col(name))
        if verb == "?" and isinstance(x, Series) and isinstance(y, Series):
            name, hay = y.frame.with_column(y), x.frame.df.select(F.col(x.frame.pos).alias(POS), x.expr.alias("v"))
            return y.frame.derive(lambda df, out: project.find(df, name, hay, out=out), F.col(name))
        if verb == "?" and isinstance(x, Series):
            at = F.min(F.when(x.expr == as_column(y), F.col(x.frame.pos)))
            return Fold(x.frame, F.coalesce(at, F.count(F.lit(1))))
        if verb == "$" and isinstance(y, Series):
            kinds = {"i": "int", "f": "double", "s": "string", "b": "boolean", "I": "int", "F": "double"}
            return y.over(lambda c: strings.pad(c, x) if isinstance(x, int) else columns.cast(c, kinds[str(x)]))
        if isinstance(x, int) and isinstance(y, Series) and verb in "#_":
            packed = Frame(y.frame.df, y.frame.pos, None, y.frame.names).packed()
            df = (places.take if verb == "#" else places.drop)(packed.df, x)
            return Series(Frame(df, POS, None, y.frame.names), y.expr)
    if isinstance(x, int) and isinstance(y, Order) and verb == "#":
        return y.first(x)
    if isinstance(y, Frame):
        if verb in "#_" and isinstance(x, int):
            df = (places.take if verb == "#" else places.drop)(y.packed().df, x)
            return Frame(df, POS, y.key, y.names)
        if verb == "#" and isinstance(x, list):
            return Frame(y.df, y.pos, y.key, [str(n) for n in x])
        if verb == "_" and isinstance(x, list) and y.key is None:
            return Frame(y.df, y.pos, y.key, [n for n in y.names if n not in x])
        if verb == "_" and y.key is not None:
            return y.filtered(~F.col(y.key).isin(*[k for k in v.items(x)]))
        if verb == "_" and isinstance(x, Series):
            return y.filtered(~x.expr)
    if isinstance(x, Frame):
        if verb == "," and isinstance(y, Frame):
            left, right = x.packed(), y.packed()
            if x.key and y.key:
                out = join.upsert(Keyed(left.df.select(*x.names, POS), x.key), Keyed(right.df.select(*y.names, POS), y.key)).df
                return Frame(out, POS, x.key, x.names)
            if y.key:
                out = join.left_lookup(left.df.select(*x.names, POS), Keyed(right.df.select(*y.names, POS), y.key))
                return Frame(out, POS, None, [*x.names, *[n for n in y.names if n not in x.names]])
            return Frame(places.concat(left.df.select(*x.names, POS), right.df.select(*x.names, POS)), POS, None, x.names)
        if verb == "," and isinstance(y, Dict):
            row = {str(k): (str(b) if isinstance(b, str) else b) for k, b in zip(y.keys, y.values)}
            packed = x.packed()
            if x.key:
                schema = ", ".join(f"`{n}` {packed.df.schema[n].dataType.simpleString()}" for n in row)
                new = packed.df.sparkSession.createDataFrame([(*row.values(), 0)], f"{schema}, {POS} bigint")
                return Frame(join.upsert(Keyed(packed.df.select(*x.names, POS), x.key), Keyed(new, x.key)).df, POS, x.key, x.names)
            return Frame(project.insert(packed.df.select(*x.names, POS), row), POS, None, x.names)
        if verb == "~" and isinstance(y, Frame):
            return project.match(x.packed().df.select(*x.names, POS), y.packed().df.select(*y.names, POS))
    raise EngineError("nyi", f"{type(x).__name__} {verb} {type(y).__name__}")


def lazy_fold(verb: str, x: Series) -> Fold:
    flag = is_flag(x)
    name = {"sum": "trues" if flag else "sum", "min": "all" if flag else "min", "max": "any" if flag else "max"}.get(FOLD_OF[verb], FOLD_OF[verb])
    return Fold(x.frame, aggregate.FOLDS[name](x.expr, x.frame.pos))


# ------------------------------------------------------------------------------------------------ evaluation


def verb_fn(name: str) -> Fn:
    def call(*args):
        if len(args) == 1:
            x = args[0]
            if isinstance(x, SPARK):
                return lazy_monad(name, x)
            if name not in MONADS:
                raise EngineError("rank", name)
            return MONADS[name](x)
        if len(args) == 2:
            x, y = args
            if name == "@" and isinstance(x, Fn):
                return x.call(y)
            if name == "." and isinstance(x, Fn):
                return x.call(*y)
            if isinstance(x, SPARK) or isinstance(y, SPARK):
                return lazy_dyad(name, x, y)
            if name not in DYADS:
                raise EngineError("rank", name)
            return DYADS[name](x, y)
        if name in "@?." and len(args) in (3, 4):
            return amend(name, *args)
        raise EngineError("rank", f"{name} takes one or two arguments")

    return Fn(call, 2, name, {"verb": name})


def amend(name: str, x, at, f, y=None, given: bool = True):
    """@[x;i;f], @[x;i;f;y], .[x;path;f;y], ?[x;range;y]."""
    if name == "?":
        items, (start, end) = v.items(x), at
        return v.joined([*items[:start], *v.items(f), *items[end:]])
    if isinstance(x, Frame):
        names = at if isinstance(at, list) else [at]
        df = x.df
        for n in names:
            old = x.series(n)
            new = f.call(old) if y is None else y if f.mark.get("verb") == ":" else f.call(old, y)
            df = df.withColumn(str(n), as_column(new))
        return Frame(df, x.pos, x.key, x.names)
    if name == "." and isinstance(at, list) and at:
        head, rest = at[0], at[1:]
        changed = amend(".", v.index(x, head), rest, f, y) if rest else (f.call(v.index(x, head)) if y is None else f.call(v.index(x, head), y))
        return put(x, head, changed)
    for k, i in enumerate(at if isinstance(at, list) else [at]):
        new = y[k] if isinstance(at, list) and v.is_list(y) else y
        old = v.index(x, i)
        x = put(x, i, f.call(old) if y is None else f.call(old, new))
    return x


def put(x, i, new):
    if isinstance(x, Dict):
        return v.concat(x, Dict([i], [new]))
    items = v.items(x)
    if items and isinstance(new, float) and isinstance(items[0], int) and not isinstance(items[0], bool):
        raise EngineError("type")
    if items and isinstance(items[0], float) and isinstance(new, int):
        new = float(new)
    items[i] = new
    return v.joined(items)


def lambda_fn(session: Session, params: list[str], body: list) -> Fn:
    def call(*args):
        if len(args) > len(params):
            raise EngineError("rank")
        if len(args) < len(params):
            return Fn(lambda *more: call(*args, *more), len(params) - len(args), "projection")
        outer, session.local = session.local, dict(zip(params, args))
        try:
            out = None
            for e in body:
                if e[0] == "apply" and e[1] == ("verb", ":") and len(e[2]) == 1:
                    return session.eval(e[2][0])
                out = session.eval(e)
            return out
        finally:
            session.local = outer

    return Fn(call, len(params), "lambda")


def over(f: Fn, adverb: str, session: Session) -> Fn:
    """The function that an adverb makes of a function; what it does depends on the operands, as in the table below.

    f/ x       fold (f of two), converge (f of one)       f\\ x      all results of the same
    s f/ x     fold from s                                n f/ x     n times (f of one); c f/ x  while c
    n / x      decode, and encode for \\                   s / x      join strings by s, and split for \\
    """
    verb = f.mark.get("verb") if isinstance(f, Fn) else None

    def each(*args):
        if len(args) == 1:
            x = args[0]
            if isinstance(x, Groups) and verb == "#":
                return fold_groups(Grouped(Series(x.frame, F.lit(1)), x), lambda s: Fold(s.frame, F.count(F.lit(1))))
            if isinstance(x, Grouped):
                return fold_groups(x, f.call)
            if isinstance(x, Series):
                return f.call(x)
            if isinstance(x, Dict):
                return Dict(x.keys, [f.call(a) for a in x.values])
            return v.joined([f.call(a) for a in v.items(x)]) if v.is_list(x) else f.call(x)
        x, y = args[0], args[1]
        if len(args) == 2 and isinstance(x, int) and f.arity == 1 and (v.is_list(y) or isinstance(y, Series)):  # stencil
            if isinstance(y, Series):
                if not f.mark.get("fold"):
                    raise EngineError("nyi", "windows of a column take a fold")
                name = y.frame.with_column(y)
                made = window.stencil(y.frame.df, name, x, FOLD_OF[f.mark["fold"]], "_w", pos=y.frame.pos)
                return Series(Frame(made, y.frame.pos, None, y.frame.names), F.col("_w"))
            w = v.items(y)
            return [f.call(v.joined(w[i : i + x])) for i in range(len(w) - x + 1)]
        lists = [a for a in args if v.is_list(a)]
        if len({len(a) for a in lists}) > 1:
            raise EngineError("length")
        n = len(lists[0]) if lists else 1
        out = [f.call(*[a[i] if v.is_list(a) else a for a in args]) for i in range(n)]
        return v.joined(out) if lists else out[0]

    def fold(*args):
        x = args[-1]
        if isinstance(x, Series):
            if verb not in FOLD_OF:
                raise EngineError("nyi", f"{f.name}/ of a column")
            made = lazy_fold(verb, x)
            return made if len(args) == 1 else lazy_dyad(verb, args[0], made)
        if len(args) == 2 and f.arity == 1:
            n = args[0]
            if isinstance(n, Fn):
                for _ in range(LIMIT):
                    if not n.call(x):
                        return x
                    x = f.call(x)
                raise EngineError("limit")
            for _ in range(n):
                x = f.call(x)
            return x
        if f.arity == 1:
            for _ in range(LIMIT):
                new = f.call(x)
                if v.match(new, x):
                    return new
                x = new
            raise EngineError("limit")
        items = v.items(x)
        if len(args) == 1 and not items:
            return 0 if verb == "+" else None
        start, rest = (args[0], items) if len(args) == 2 else (items[0], items[1:])
        if verb == "+" and len(args) == 1 and items and all(isinstance(i, bool) for i in items):
            return sum(items)
        return functools.reduce(f.call, rest, start)

    def scan(*args):
        x = args[-1]
        if isinstance(x, Series):
            if verb not in FOLD_OF:
                raise EngineError("nyi", f"{f.name}\\ of a column")
            return x.frame.derive(lambda df, out: window.running(df, x.expr, FOLD_OF[verb], out, pos=x.frame.pos, seed=args[0] if len(args) == 2 else None), x.expr)
        states = [x]
        if f.arity == 1:
            for _ in range(args[0] if len(args) == 2 and isinstance(args[0], int) else LIMIT):
                if len(args) == 2 and isinstance(args[0], Fn) and not args[0].call(states[-1]):
                    return states
                new = f.call(states[-1])
                if len(args) == 1 and v.match(new, states[-1]):
                    return states
                states.append(new)
            return states
        items = v.items(x)
        out = [args[0]] if len(args) == 2 else items[:1]
        for i in items if len(args) == 2 else items[1:]:
            out.append(f.call(out[-1], i))
        return out[1:] if len(args) == 2 else out

    def prior(*args):
        x = args[-1]
        if isinstance(x, Series):
            name = x.frame.with_column(x)
            g = lambda a, b: f.call(Series(x.frame, a), Series(x.frame, b) if isinstance(b, Column) else b).expr
            return x.frame.derive(lambda df, out: window.each_prior(df, name, g, out, seed=args[0] if len(args) == 2 else None, pos=x.frame.pos), F.col(name))
        items = v.items(x)
        if len(args) == 2 and isinstance(args[0], int) and f.arity == 1:
            return each(*args)
        if not items:
            return []
        first = f.call(items[0], args[0]) if len(args) == 2 else items[0]
        return [first, *[f.call(b, a) for a, b in zip(items, items[1:])]]

    def right(x, y):
        return v.joined([f.call(x, b) for b in v.items(y)])

    def left(x, y):
        return v.joined([f.call(a, y) for a in v.items(x)])

    if not isinstance(f, Fn):  # a noun before the adverb
        if adverb == "/":
            return Fn(lambda x: f.join(x) if isinstance(f, str) else v.decode(f, x), 1, "join")
        if adverb == "\\":
            return Fn(lambda x: x.split(f) if isinstance(f, str) else v.encode(f, x), 1, "split")
        return Fn(lambda x: [v.joined(v.items(x)[i : i + f]) for i in range(len(v.items(x)) - f + 1)], 1, "windows")
    made = {"'": each, "/": fold, "\\": scan, "':": prior, "/:": right, "\\:": left}[adverb]
    mark = {"fold": verb} if adverb == "/" and verb in FOLD_OF else {}
    return Fn(made, 1 if mark else 2, f.name + adverb, mark)


class Session:
    """Names and their values; calling it evaluates a program and gives its last value."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark, self.globals, self.local = spark, {}, None

    def table(self, name: str, df: DataFrame, pos: str | None = None, key: str | None = None) -> Frame:
        """A DataFrame under a name. pos: a column that numbers its rows from 0; without one rows are numbered as they come."""
        if pos is None:
            df, pos = places.numbered(df.withColumn("_come", F.monotonically_increasing_id()), "_come").drop("_come"), POS
        self.globals[name] = Frame(df, pos, key)
        return self.globals[name]

    def __call__(self, source: str):
        out = None
        for node in parse(source):
            out = self.eval(node)
        return out

    def collect(self, source: str):
        """A program's last value as driver values: lists for columns, Dict for dictionaries and tables."""
        return self.driver(self(source))

    def driver(self, x):
        if isinstance(x, Fold):
            return x.value()
        if isinstance(x, Series):
            return [r["v"] for r in x.frame.plan(x.expr).orderBy(x.frame.pos).select(x.expr.alias("v")).collect()]
        if isinstance(x, Places):
            return [r["v"] for r in x.frame.plan(x.mask).filter(x.mask).select(F.col(x.frame.pos).alias("v")).orderBy("v").collect()]
        if isinstance(x, Order):
            return [r["_was"] for r in x.sorted().orderBy(POS).select("_was").collect()]
        if isinstance(x, Frame):
            rows = x.df.orderBy(x.pos).select(*x.names).collect()
            return Dict([Sym(n) for n in x.names], [[r[n] for r in rows] for n in x.names])
        if isinstance(x, Groups):
            return self.driver(fold_groups(Grouped(Series(x.frame, F.col(x.frame.pos)), x), lambda s: Fold(s.frame, F.sort_array(F.collect_list(s.expr)))))
        if isinstance(x, Mapping):
            rows = x.df.orderBy(*x.keys).collect()
            return Dict([r["k"] if x.keys == ["k"] else tuple(r[k] for k in x.keys) for r in rows], [r["v"] for r in rows])
        if isinstance(x, list):
            return [self.driver(i) for i in x]
        if isinstance(x, Dict):
            return Dict(self.driver(x.keys), self.driver(x.values))
        return x

    # -------------------------------------------------------------------------------------------- nodes

    def eval(self, node):
        return getattr(self, f"_{node[0]}")(node)

    def _lit(self, node):
        return node[1]

    def _name(self, node):
        name = node[1]
        if self.local is not None and name in self.local:
            return self.local[name]
        if name in self.globals:
            return self.globals[name]
        raise EngineError("value", name)

    def _verb(self, node):
        made = verb_fn(node[1])
        if node[1] != ".":
            return made

        def call(*args):
            """`.s` a global by name, `.C` a program's value, or its error as a value."""
            if len(args) == 1 and isinstance(args[0], Sym):
                return self.globals[args[0]] if args[0] in self.globals else self._name(("name", str(args[0])))
            if len(args) == 1 and isinstance(args[0], str):
                try:
                    return self(args[0])
                except EngineError as e:
                    return Err(e.kind)
            return made.call(*args)

        return Fn(call, 2, ".", made.mark)

    def _list(self, node):
        out = []
        for n in reversed(node[1]):  # right to left, as everything is
            out.append(None if n is None else self.eval(n))
        return v.joined(out[::-1])

    def _dict(self, node):
        return Dict([Sym(n) for n, _ in node[1]], [self.eval(e) for _, e in node[1]])

    def _table(self, node):
        _, keys, cols = node
        made = {n: v.items(self.eval(e)) for n, e in [*keys, *cols]}
        n = max(map(len, made.values()))
        plain = {c: [str(i) if isinstance(i, str) else i for i in (x * n if len(x) == 1 else x)] for c, x in made.items()}
        return Frame(literal(self.spark, plain), POS, keys[0][0] if keys else None)

    def _lambda(self, node):
        return lambda_fn(self, node[1], node[2])

    def _adverb(self, node):
        return over(self.eval(node[1]), node[2], self)

    def _train(self, node):
        f, g = self.eval(node[1]), self.eval(node[2])
        last = f.mark.get("verb") == "*" and g.mark.get("verb") == "|"

        def call(*x):
            if last and len(x) == 1 and isinstance(x[0], Series):  # the last item: no reversal
                return Fold(x[0].frame, F.max_by(x[0].expr, x[0].frame.pos))
            return f.call(g.call(*x))

        return Fn(call, 1, "train")

    def _partial(self, node):
        f, x = self.eval(node[1]), self.eval(node[2][0])
        return Fn(lambda y: f.call(x, y), 1, "partial")

    def _cond(self, node):
        parts = node[1]
        first = self.eval(parts[0])
        if isinstance(first, Series):
            out = F.when(first.expr, as_column(self.eval(parts[1])))
            for c, e in zip(parts[2:-1:2], parts[3:-1:2]):
                out = out.when(self.eval(c).expr, as_column(self.eval(e)))
            return Series(first.frame, out.otherwise(as_column(self.eval(parts[-1]))))
        i = 0
        while i + 1 < len(parts):
            if self.driver(first if i == 0 else self.eval(parts[i])):
                return self.eval(parts[i + 1])
            i += 2
        return self.eval(parts[i]) if i < len(parts) else None

    def _assign(self, node):
        _, target, op, e = node
        new = self.eval(e)
        if target[0] == "name":
            if op is not None:
                new = self.eval(op).call(self._name(target), new)
            (self.globals if self.local is None else self.local)[target[1]] = new
            return new
        base, at = target[1], [self.eval(a) for a in target[2]]
        f = self.eval(op) if op is not None else verb_fn(":")
        old = self.eval(base)
        if isinstance(old, Frame) and old.key and not isinstance(at[0], Sym):
            changed = lazy_dyad(",", old, v.concat(Dict([Sym(old.key)], [at[0]]), new))
        else:
            changed = amend("." if len(at) > 1 else "@", old, at if len(at) > 1 else at[0], f, new)
        (self.globals if self.local is None or base[1] not in self.local else self.local)[base[1]] = changed
        return new

    def _apply(self, node):
        _, f, args = node
        if f == ("verb", "*") and len(args) == 1 and args[0] is not None and args[0][:2] == ("apply", ("verb", "|")):
            inner = self.eval(args[0][2][0])
            if isinstance(inner, Series):  # the last item: no reversal
                return Fold(inner.frame, F.max_by(inner.expr, inner.frame.pos))
            return verb_fn("*").call(verb_fn("|").call(inner))
        values = [None if a is None else self.eval(a) for a in reversed(args)][::-1]
        head = self.eval(f)
        if isinstance(head, Fn):
            holes = [i for i, a in enumerate(args) if a is None]
            if holes and len(args) > 1:

                def fill(*more):
                    full = list(values)
                    for i, m in zip(holes, more):
                        full[i] = m
                    return head.call(*full)

                return Fn(fill, len(holes), "projection")
            return head.call(*values)
        for x in values:
            if x is not None:
                head = verb_fn("@").call(head, x)
        return head
