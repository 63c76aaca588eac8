"""The query catalogue: each operator family over the star-schema and event tables, beside the SQL that says the same.

`events.event_id` and `orders.o_orderkey` are positions: unique and, for events, contiguous from 0.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ecs import World
from .functions import arith, cells, hashes, numeric, text
from .lang import Session
from .model import Keyed, vec
from .operators import aggregate as agg
from .operators import iterate, join, position, project, sets, sort, window
from .sources import generate
from .streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str, *tables: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a function of the named tables as a query, with its SQL."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[table(spark, sf_dir, t) for t in tables])
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


c = F.col

# ---------------------------------------------------------------- rows and columns


@query("select event_id,value from events where value>100", "events")
def filter_mask(events):
    return project.filter_mask(events, c("value") > 100).select("event_id", "value")


@query("select event_id from events where not (event_type='error')", "events")
def weed_out(events):
    return project.weed_out(events, c("event_type") == "error").select("event_id")


@query("select event_id as pos from events where value>150", "events")
def where_positions(events):
    return project.where(events, c("value") > 150, "event_id", "pos")


@query("select o_orderkey, g.i::bigint as rep from orders, range(0,(o_orderkey%3)::bigint) g(i)", "orders")
def replicate_where(orders):
    return project.replicate(orders, c("o_orderkey") % 3, ["o_orderkey"])


@query("select l_orderkey,l_linenumber,l_partkey,l_suppkey,round(l_extendedprice*(1-l_discount),4) as rev from lineitem", "lineitem")
def project_amend(lineitem):
    return project.amend(lineitem, {"rev": F.round(c("l_extendedprice") * (1 - c("l_discount")), 4)}).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rev")


@query("select event_id, case when event_id%7=0 then 0.0::double else value end as v from events", "events")
def indexed_amend(events):
    changes = events.filter("event_id % 7 = 0").select(c("event_id").alias("v"), F.lit(0.0).alias("y"), "event_id")
    return project.amend_at(events.select("event_id", "value"), "value", changes, pos="event_id").select("event_id", c("value").alias("v"))


@query("select c_custkey, c_mktsegment in ('BUILDING','FURNITURE') as m from customer", "customer")
def member_in(customer):
    return customer.select("c_custkey", project.member(c("c_mktsegment"), ["BUILDING", "FURNITURE"]).alias("m"))


@query("select c_custkey, coalesce((select min(n_nationkey) from nation where n_regionkey=c_nationkey),25)::bigint as pos from customer", "customer", "nation")
def find_pos(customer, nation):
    values = nation.select(c("n_nationkey").cast("bigint").alias("_pos"), c("n_regionkey").alias("v"))
    return project.find(customer, "c_nationkey", values, size=25).select("c_custkey", "pos")


@query("select o_orderkey, coalesce(c_mktsegment,'none') as seg from orders left join customer on o_custkey=c_custkey and c_acctbal>0", "orders", "customer")
def lookup_default(orders, customer):
    return join.lookup_default(orders, "o_custkey", Keyed(customer.filter("c_acctbal > 0"), "c_custkey"), "c_mktsegment", "none", "seg").select("o_orderkey", "seg")


@query("select o_orderkey, case when o_totalprice>100000 then 'hi' when o_totalprice>50000 then 'mid' else 'lo' end as b from orders", "orders")
def case_cond(orders):
    price = c("o_totalprice")
    return orders.select("o_orderkey", cells.conditional(price > 100000, F.lit("hi"), price > 50000, F.lit("mid"), F.lit("lo")).alias("b"))


# ---------------------------------------------------------------- joins


@query("with k as (select l_suppkey as key, max(l_quantity) as q from lineitem where l_suppkey%2=0 group by 1) select s_suppkey, coalesce(q,0.0) as q from supplier left join k on s_suppkey=key", "lineitem", "supplier")
def left_join_lookup(lineitem, supplier):
    k = lineitem.filter("l_suppkey % 2 = 0").groupBy(c("l_suppkey").alias("s_suppkey")).agg(F.max("l_quantity").alias("q"))
    return join.left_lookup(supplier.select("s_suppkey"), Keyed(k, "s_suppkey"))


@query("with k as (select o_custkey as key, max(o_totalprice) as bal from orders where o_orderstatus='F' group by 1) select c_custkey, coalesce(bal,c_acctbal) as c_acctbal from customer left join k on c_custkey=key", "orders", "customer")
def left_join_override(orders, customer):
    k = orders.filter("o_orderstatus = 'F'").groupBy(c("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return join.left_lookup(customer.select("c_custkey", "c_acctbal"), Keyed(k, "c_custkey"))


@query("with k1 as (select c_custkey k,c_acctbal v from customer where c_custkey%3<>0), k2 as (select c_custkey k,-1.0::double v from customer where c_custkey%2=0) select coalesce(k2.k,k1.k) as k, coalesce(k2.v,k1.v) as v from k1 full join k2 on k1.k=k2.k", "customer")
def outer_upsert(customer):
    k1 = customer.filter("c_custkey % 3 <> 0").select(c("c_custkey").alias("k"), c("c_acctbal").alias("v"))
    k2 = customer.filter("c_custkey % 2 = 0").select(c("c_custkey").alias("k"), F.lit(-1.0).alias("v"))
    return join.upsert(Keyed(k1, "k"), Keyed(k2, "k")).df


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment='BUILDING')", "orders", "customer")
def semi_join(orders, customer):
    return join.semi(orders, "o_custkey", customer.filter("c_mktsegment = 'BUILDING'"), "c_custkey").select("o_orderkey")


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment='BUILDING')", "orders", "customer")
def anti_join(orders, customer):
    return join.anti(orders, "o_custkey", customer.filter("c_mktsegment = 'BUILDING'"), "c_custkey").select("o_orderkey")


@query("select a.n_nationkey as a,b.n_nationkey as b from nation a join nation b on a.n_nationkey<b.n_nationkey and a.n_regionkey=b.n_regionkey", "nation", "nation")
def theta_join(left, right):
    a, b = left.alias("a"), right.alias("b")
    return join.theta(a, b, [c("a.n_regionkey") == c("b.n_regionkey")], c("a.n_nationkey") < c("b.n_nationkey")).select(c("a.n_nationkey").alias("a"), c("b.n_nationkey").alias("b"))


@query("select n_name, count(*) as n from customer join nation on c_nationkey=n_nationkey group by 1", "customer", "nation")
def equi_join(customer, nation):
    return agg.freq(join.equi(customer, nation, c("c_nationkey") == c("n_nationkey")), "n_name")


@query("select a.c_custkey as a, b.c_custkey as b from customer a join customer b on a.c_custkey<b.c_custkey and a.c_nationkey=b.c_nationkey and abs(a.c_acctbal-b.c_acctbal)<=5", "customer")
def radius_join(customer):
    points = customer.select("c_custkey", c("c_acctbal").alias("x"), (c("c_nationkey") * 1000.0).alias("y"))
    return join.within(points, points, "x", "y", 5.0).filter("c_custkey < r_c_custkey").select(c("c_custkey").alias("a"), c("r_c_custkey").alias("b"))


@query("select e.event_id, arg_max(f.value, f.event_id) as v from events e left join events f on f.user_id=e.user_id and f.event_type='purchase' and f.event_id<=e.event_id group by 1", "events")
def as_of_join(events):
    bought = events.filter("event_type = 'purchase'").select("user_id", "event_id", c("value").alias("v"))
    return join.as_of(events.select("user_id", "event_id"), bought, "event_id", ["user_id"], ["v"]).select("event_id", "v")


# ---------------------------------------------------------------- groups and folds


@query("select event_type, string_agg(event_id::varchar, ',' order by event_id) as pos from events group by 1", "events")
def group_positions(events):
    return agg.group(events, "event_type", pos="event_id", out="p").select("event_type", F.array_join(c("p").cast("array<string>"), ",").alias("pos"))


@query("select event_type, count(*) as n from events group by 1", "events")
def freq(events):
    return agg.freq(events, "event_type")


@query("select l_returnflag, count(*) as n, sum(l_quantity)::double as s, min(l_quantity) as lo, max(l_quantity) as hi from lineitem group by 1", "lineitem")
def grouped_folds(lineitem):
    return agg.fold(lineitem, ["l_returnflag"], ("count", "l_quantity", "n"), ("sum", "l_quantity", "s"), ("min", "l_quantity", "lo"), ("max", "l_quantity", "hi"))


@query("select l_returnflag,l_linestatus,round(avg(l_quantity),6) as a from lineitem group by 1,2", "lineitem")
def group_multi(lineitem):
    return agg.fold(lineitem, ["l_returnflag", "l_linestatus"], ("avg", "l_quantity", "a")).withColumn("a", F.round("a", 6))


@query("select user_id, arg_min(event_type,event_id) as f, arg_max(event_type,event_id) as l from events group by 1", "events")
def first_last(events):
    return agg.fold(events, ["user_id"], ("first", "event_type", "f"), ("last", "event_type", "l"), pos="event_id")


@query("select event_type, min(event_id) as pos from events group by 1", "events")
def distinct_first(events):
    return agg.distinct_first(events, "event_type", "event_id")


@query("select count(distinct user_id) as n from events", "events")
def count_distinct(events):
    return agg.fold(events, [], ("distinct", "user_id", "n"))


@query("select user_id, bool_and(value>1) as a, bool_or(value>200) as o from events group by 1", "events")
def bool_folds(events):
    return agg.fold(events, ["user_id"], ("all", c("value") > 1, "a"), ("any", c("value") > 200, "o"))


@query("select event_type, round(avg(value),6) as m, round(var_samp(value),4) as v, round(stddev_samp(value),6) as s, round(median(value),6) as md from events group by 1", "events")
def stats_moments(events):
    made = agg.fold(events, ["event_type"], ("avg", "value", "m"), ("var", "value", "v"), ("std", "value", "s"), ("median", "value", "md"))
    return made.select("event_type", *[F.round(n, d).alias(n) for n, d in (("m", 6), ("v", 4), ("s", 6), ("md", 6))])


@query("select b.i::bigint as b, round(coalesce(sum(l_extendedprice),0),2) as w from range(0,60) b(i) left join lineitem on l_quantity::bigint=b.i group by 1", "lineitem")
def histogram_weighted(lineitem):
    return agg.histogram(lineitem, F.round("l_quantity"), c("l_extendedprice"), 60).withColumn("w", F.round("w", 2))


@query("select round(sum(l_extendedprice*l_discount),2) as d from lineitem", "lineitem")
def dot_product(lineitem):
    return agg.dot(lineitem, "l_extendedprice", "l_discount").withColumn("d", F.round("d", 2))


@query("select o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) as k from orders group by 1", "orders")
def argmax(orders):
    return agg.argmax(orders, ["o_custkey"], "o_totalprice", "o_orderkey")


@query("select n_regionkey, product(n_nationkey+1)::double as p from nation group by 1", "nation")
def product_fold(nation):
    return agg.fold(nation, ["n_regionkey"], ("product", c("n_nationkey") + 1, "p"))


@query("select user_id, round(list_reduce(list(value order by event_id), lambda a, x: a*0.5 + x), 4) as s from events group by 1", "events")
def general_fold(events):
    lists = agg.fold(events, ["user_id"], ("list", "value", "l"), pos="event_id")
    decayed = agg.general_fold(F.slice("l", F.lit(2), F.size("l")), lambda a, x: a * 0.5 + x, F.get("l", F.lit(0)))
    return lists.select("user_id", F.round(decayed, 4).alias("s"))


@query("select l_returnflag, round(covar_samp(l_quantity,l_extendedprice),2) as covar, round(corr(l_quantity,l_extendedprice),6) as corr from lineitem group by 1", "lineitem")
def related(lineitem):
    return agg.related(lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", F.round("covar", 2).alias("covar"), F.round("corr", 6).alias("corr"))


# ---------------------------------------------------------------- windows


@query("select event_id, round(sum(value) over (order by event_id),2) as s from events", "events")
def running_sum(events):
    return window.running(events.select("event_id", "value"), "value", "sum", "s", pos="event_id").select("event_id", F.round("s", 2).alias("s"))


@query("select event_id, max(value) over (partition by user_id order by event_id) as m from events", "events")
def running_max_by_key(events):
    return window.running(events, "value", "max", "m", pos="event_id", keys=["user_id"]).select("event_id", "m")


@query("select event_id, round(value-coalesce(lag(value) over (order by event_id),0),4) as d from events", "events")
def deltas(events):
    return window.each_prior(events.select("event_id", "value"), "value", lambda x, y: x - y, "d", pos="event_id").select("event_id", F.round("d", 4).alias("d"))


@query("select event_id, round(value-lag(value,1,10.0) over (order by event_id),4) as d from events", "events")
def deltas_seeded(events):
    return window.each_prior(events.select("event_id", "value"), "value", lambda x, y: x - y, "d", seed=10.0, pos="event_id").select("event_id", F.round("d", 4).alias("d"))


@query("select event_id,s from (select event_id, round(sum(value) over w,4) as s, count(*) over w as n from events window w as (order by event_id rows between current row and 2 following)) where n=3", "events")
def window_stencil(events):
    return window.stencil(events.select("event_id", "value"), "value", 3, "sum", "s", pos="event_id").select("event_id", F.round("s", 4).alias("s"))


@query("select event_id, l::varchar as l from (select event_id, list(event_type) over w as l from events window w as (order by event_id rows between current row and 1 following)) where len(l)=2", "events")
def window_lists(events):
    made = window.windows(events.select("event_id", "event_type"), "event_type", 2, "l", pos="event_id")
    return made.select("event_id", F.concat(F.lit("["), F.array_join("l", ", "), F.lit("]")).alias("l"))


@query("select event_id, round(sum(value) over (order by event_id rows between 4 preceding and current row)/5,6) as m from events", "events")
def mavg(events):
    return window.mavg(events.select("event_id", "value"), "value", 5, "m", pos="event_id").select("event_id", F.round("m", 6).alias("m"))


@query("select event_id, max(value) over w as hi, min(value) over w as lo from events window w as (order by event_id rows between 2 preceding and current row)", "events")
def mmax_mmin(events):
    both = window.framed(events.select("event_id", "value"), {"hi": lambda w: F.max("value").over(w.rowsBetween(-2, 0)), "lo": lambda w: F.min("value").over(w.rowsBetween(-2, 0))}, 2, 0, pos="event_id")
    return both.select("event_id", "hi", "lo")


@query("select event_id, (row_number() over (order by value,event_id)-1)::bigint as r from events", "events")
def rank_dense_ordinal(events):
    return sort.grade(events.select("event_id", "value"), "value", pos="event_id").select("event_id", "r")


@query("select event_id, lag(value, 2, 0.0) over (order by event_id) as a, lead(value, 1, -1.0) over (order by event_id) as b from events", "events")
def shifts(events):
    back = window.shift(events.select("event_id", "value"), "value", 2, "a", fill=0.0, pos="event_id")
    return window.shift(back, "value", -1, "b", fill=-1.0, pos="event_id").select("event_id", "a", "b")


@query("select min(event_id) as start, count(*) as len from (select event_id, event_id-row_number() over (order by event_id) as g from events where value>50) group by g", "events")
def run_lengths(events):
    return window.runs(events, c("value") > 50, "event_id")


# ---------------------------------------------------------------- order and shape


@query("select event_id, (row_number() over (order by value desc,event_id)-1)::bigint as r from events", "events")
def grade_desc(events):
    return sort.grade(events.select("event_id", "value"), "value", desc=True, pos="event_id").select("event_id", "r")


@query("select event_id, (row_number() over (order by event_type, value, event_id)-1)::bigint as r from events", "events")
def grade_table(events):
    return sort.grade(events.select("event_id", "event_type", "value"), "event_type", "value", pos="event_id").select("event_id", "r")


@query("select o_orderkey,o_totalprice from orders order by o_totalprice desc,o_orderkey limit 10", "orders")
def top_k(orders):
    return sort.top(orders, 10, "o_totalprice", pos="o_orderkey").select("o_orderkey", "o_totalprice")


@query("select o_custkey,o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc,o_orderkey) as r from orders) where r<=2", "orders")
def top_k_per_group(orders):
    return sort.top_of_groups(orders, 2, ["o_custkey"], "o_totalprice", pos="o_orderkey").select("o_custkey", "o_orderkey")


@query("select g.i::bigint as pos, r_name from range(0,12) g(i) join region on r_regionkey=g.i%5", "region")
def take_cycle(region):
    return position.take(region.select("r_name", c("r_regionkey").cast("bigint").alias("_pos")), 12, size=5).select(c("_pos").alias("pos"), "r_name")


@query("select event_id from events where event_id>=10 and event_id<25", "events")
def drop_take(events):
    rows = events.select("event_id", c("event_id").alias("_pos"))
    return position.drop(rows.filter("_pos < 25"), 10).select("event_id")


@query("select s.i::bigint as seg, count(event_id) as n, round(coalesce(sum(value),0),2) as v from range(0,4) s(i) left join events on event_id>=s.i*100+50 and event_id<case when s.i=3 then 9223372036854775807 else (s.i+1)*100+50 end group by 1", "events")
def cut_segments(events):
    return sort.cut_fold(events, [50, 150, 250, 350], F.count("event_id").alias("n"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("v"), pos="event_id")


@query("select event_id//10 as row, string_agg(event_type, '|' order by event_id) as r from events group by 1", "events")
def reshape(events):
    return sort.reshape(events, "event_type", 10, pos="event_id").select("row", F.array_join("r", "|").alias("r"))


@query("select (select max(event_id) from events) - event_id as pos, value from events", "events")
def reverse(events):
    return position.reverse(events.select("value", c("event_id").alias("_pos"))).select(c("_pos").alias("pos"), "value")


@query("select case when event_id<5 then event_id else event_id-1 end as pos, event_id from events where event_id<>5", "events")
def delete_at(events):
    return position.delete_at(events.select("event_id", c("event_id").alias("_pos")), 5).select(c("_pos").alias("pos"), "event_id")


# ---------------------------------------------------------------- sets


@query("select c_custkey as k from customer union all select s_suppkey from supplier", "customer", "supplier")
def concat_tables(customer, supplier):
    return sets.union_all(customer.select(c("c_custkey").alias("k")), supplier.select(c("s_suppkey").alias("k")))


@query("select c_nationkey as k from customer union select s_nationkey from supplier", "customer", "supplier")
def union_set(customer, supplier):
    return sets.union(customer.select(c("c_nationkey").alias("k")), supplier.select(c("s_nationkey").alias("k")))


@query("select o_custkey as k from orders where o_custkey in (select c_custkey from customer where c_acctbal<0)", "orders", "customer")
def intersect_bag(orders, customer):
    return sets.intersect(orders.select(c("o_custkey").alias("k")), customer.filter("c_acctbal < 0").select(c("c_custkey").alias("k")), "k")


@query("select c_custkey as k from customer where c_custkey not in (select s_suppkey from supplier) union all select s_suppkey from supplier where s_suppkey not in (select c_custkey from customer)", "customer", "supplier")
def symmetric_difference(customer, supplier):
    return sets.symmetric(customer.select(c("c_custkey").alias("k")), supplier.select(c("s_suppkey").alias("k")), "k")


# ---------------------------------------------------------------- scalars


@query("select event_id, (event_id-500) - 7*floor((event_id-500)/7.0)::bigint as m, floor((event_id-500)/7.0)::bigint as d from events", "events")
def modulo_floor(events):
    x = c("event_id") - 500
    return events.select("event_id", arith.fmod(x, 7).alias("m"), arith.fdiv(x, 7).alias("d"))


@query("select event_id, round(sqrt(value),6) as a, round(ln(value+1),6) as b, floor(value)::bigint as f, abs(event_id-500) as g from events", "events")
def math_funcs(events):
    v = c("value")
    return events.select("event_id", F.round(F.sqrt(v), 6).alias("a"), F.round(F.ln(v + 1), 6).alias("b"), F.floor(v).alias("f"), F.abs(c("event_id") - 500).alias("g"))


@query("select event_id, (event_id//3600)%24 as h, (event_id//60)%60 as m, event_id%60 as s from events", "events")
def encode_radix(events):
    h, m, s = arith.encode(c("event_id"), [24, 60, 60])
    return events.select("event_id", h.alias("h"), m.alias("m"), s.alias("s"))


@query("select event_id, ((event_id%24)*60 + event_id%60)*60 + (event_id*7)%60 as t from events", "events")
def decode_radix(events):
    e = c("event_id")
    return events.select("event_id", arith.decode([e, e % 60, (e * 7) % 60], [24, 60, 60]).alias("t"))


@query("select event_id, ((event_id*1000003 + 2147483648) & 4294967295) - 2147483648 as w from events", "events")
def wrap_int32(events):
    return events.select("event_id", arith.wrap32(c("event_id") * 1000003).cast("bigint").alias("w"))


@query("select event_id, case when event_id%4=0 then null else value/(event_id%4) end as q from events", "events")
def divide_by_zero(events):
    return events.select("event_id", arith.divide(c("value"), c("event_id") % 4).alias("q"))


@query("select p_partkey, left(rpad(p_name,8,' '),8) as a, right(lpad(p_name,greatest(8,length(p_name))::integer,' '),8) as b, upper(p_name) as u from part", "part")
def pad_case(part):
    name = c("p_name")
    return part.select("p_partkey", text.pad(name, 8).alias("a"), text.pad(name, -8).alias("b"), text.upper(name).alias("u"))


@query("select w, count(*) as n from (select unnest(string_split(p_name,' ')) as w from part) where w<>'' group by 1", "part")
def split_tokens(part):
    return agg.freq(part.select(F.explode(text.tokens(c("p_name"))).alias("w")), "w")


@query("select p_partkey, regexp_replace(p_brand,'[0-9]+','N','g') as r, regexp_matches(p_brand,'^(?:Brand#1[0-9]?)$') as t, regexp_replace(p_brand,'[a-z]','_') as f from part", "part")
def regex_sub(part):
    brand = c("p_brand")
    return part.select("p_partkey", text.sub_all(brand, "[0-9]+", "N").alias("r"), text.test(brand, "Brand#1[0-9]?").alias("t"), text.sub(brand, "[a-z]", "_").alias("f"))


@query("select c_custkey, md5(c_name) as m, sha256(c_name) as s, sha1(c_name) as s1, to_base64(c_name::blob) as b from customer", "customer")
def hash_funcs(customer):
    name = c("c_name")
    return customer.select("c_custkey", hashes.md5(name).alias("m"), hashes.sha2(name).alias("s"), hashes.sha1(name).alias("s1"), hashes.base64(name.cast("binary")).alias("b"))


@query("select event_id, (props->>'$.k')::bigint as k from events", "events")
def json_access(events):
    return events.select("event_id", cells.json_value(c("props"), "$.k", "bigint").alias("k"))


@query("""select event_id, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' as j from events""", "events")
def json_generate(events):
    return events.select("event_id", cells.json_text(F.struct("event_type", "user_id")).alias("j"))


@query("select event_id, v is null as n, coalesce(v,-1.0) as f from (select event_id, case when event_id%5=0 then null else value end as v from events)", "events")
def null_mask_fill(events):
    v = F.when(c("event_id") % 5 != 0, c("value"))
    return events.select("event_id", v.alias("v")).select("event_id", arith.is_null(c("v")).alias("n"), arith.fill(c("v"), F.lit(-1.0)).alias("f"))


@query("select event_id, coalesce(try_cast(case when event_id%2=0 then event_id::varchar else event_type end as bigint), -1) as n, (event_id::varchar)::bigint as good from events", "events")
def cast_parse(events):
    mixed = F.when(c("event_id") % 2 == 0, text.fmt(c("event_id"))).otherwise(c("event_type"))
    return events.select("event_id", arith.fill(arith.cast(mixed, "bigint"), F.lit(-1)).alias("n"), arith.cast(text.fmt(c("event_id")), "bigint").alias("good"))


@query("select o_orderkey, list_sum(list_transform(string_split(o_orderkey::varchar, ''), lambda x: x::bigint))::bigint as s from orders", "orders")
def digit_fold(orders):
    return orders.select("o_orderkey", F.aggregate(arith.digits(c("o_orderkey"), 10), F.lit(0).cast("bigint"), lambda s, d: s + d).alias("s"))


# ---------------------------------------------------------------- iteration, trees, matrices, entities


@query("with recursive p as (select event_id as n, case when event_id=0 then -1 else (event_id-1)//3 end as par from events), t as (select n, 0 as depth from p where par=-1 union all select p.n, t.depth+1 from p join t on p.par=t.n) select n, depth::bigint as depth from t", "events")
def tree_depth(events):
    parents = events.select(c("event_id").alias("_pos"), F.when(c("event_id") == 0, -1).otherwise(arith.fdiv(c("event_id") - 1, 3)).alias("v"))
    return iterate.depth(parents).select(c("_pos").alias("n"), "depth")


@query("with recursive s as (select n_nationkey::bigint + 1 as k, n_nationkey::bigint + 1 as x, 0 as i from nation union all select k, case when x%2=0 then x//2 else 3*x+1 end, i+1 from s where x<>1) select k, max(i)::bigint as steps, max(x) as peak from s group by 1", "nation")
def while_states(nation):
    start = (c("n_nationkey") + 1).cast("bigint")
    states = iterate.states_cell(start, lambda x: F.when(x % 2 == 0, arith.fdiv(x, 2)).otherwise(3 * x + 1), lambda x: x != 1, 200)
    return nation.select(start.alias("k"), states.alias("s")).select("k", (F.size("s") - 1).cast("bigint").alias("steps"), F.array_max("s").alias("peak"))


@query("with e as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding,1)-1 as j from embeddings) select a.j as i, b.j as k, round(sum(a.x*b.x),4) as d from e a join e b using(vec_id) group by 1,2", "embeddings")
def matmul(embeddings):
    a = numeric.long_form(embeddings, "vec_id", "embedding")
    return numeric.matmul(project.transpose(a), a).select("i", "k", F.round("v", 4).alias("d"))


@query("with e as (select vec_id, unnest(embedding)::double as x from embeddings), m as (select vec_id, max(x) as h from e group by 1) select vec_id, round(max(exp(x-h))/sum(exp(x-h)),6) as p from e join m using (vec_id) group by 1", "embeddings")
def softmax_peak(embeddings):
    return embeddings.select("vec_id", F.round(F.array_max(numeric.softmax(c("embedding"))), 6).alias("p"))


@query("select event_id, round(value*0.99 + 0.016*user_id,4) as px from events where event_type<>'error'", "events")
def ecs_tick(events):
    world = World(events.select("event_id", c("value").alias("px"), c("user_id").alias("vx"), "event_type"), "event_id")
    world = world.despawn(c("event_type") == "error").tick(
        lambda t: project.amend(t, {"px": lambda x: x * 0.99}),
        lambda t: project.amend(t, {"px": F.round(c("px") + 0.016 * c("vx"), 4)}),
    )
    return world.get("event_id", "px")


# ---------------------------------------------------------------- sources, dictionaries, cells


@query("select i::bigint as a, j::bigint as b, (i*5+j)::bigint as pos from range(0,4) r(i), range(0,5) s(j)", "region")
def odometer(region):
    grid = generate.odometer(region.sparkSession, 4, 5)
    return grid.select(c("d0").cast("bigint").alias("a"), c("d1").cast("bigint").alias("b"), c("_pos").alias("pos"))


@query("select i::bigint as i, j::bigint as j, (i=j)::integer as v from range(0,6) r(i), range(0,6) s(j)", "region")
def unit_matrix(region):
    rows = generate.unit(region.sparkSession, 6)
    return rows.select(c("_pos").alias("i"), F.posexplode("v").alias("j", "v")).select("i", c("j").cast("bigint").alias("j"), "v")


@query("select k, n_name as v from (values (3),(99),(0)) t(k) left join nation on n_nationkey=k", "nation")
def take_keys(nation):
    d = nation.select(c("n_nationkey").alias("k"), c("n_name").alias("v"), c("n_nationkey").cast("bigint").alias("_pos"))
    return project.take_keys(d, vec(nation.sparkSession, [3, 99, 0], "int")).select("k", "v")


@query("select n_nationkey as k from nation where n_regionkey<>2", "nation")
def drop_keys(nation):
    d = nation.select(c("n_nationkey").alias("k"), c("n_name").alias("v"), c("n_nationkey").cast("bigint").alias("_pos"))
    return project.drop_keys(d, nation.filter("n_regionkey = 2").select(c("n_nationkey").alias("v"))).select("k")


@query("select coalesce(b.k, a.k) as k, coalesce(b.v, a.v) as v from (select n_nationkey as k, n_name as v from nation where n_nationkey<15) a full join (select n_nationkey as k, upper(n_name)||'!' as v from nation where n_nationkey>=10) b on a.k=b.k", "nation")
def merge_dictionaries(nation):
    rows = nation.select(c("n_nationkey").alias("k"), c("n_name").alias("v"), c("n_nationkey").cast("bigint").alias("_pos"))
    right = rows.filter("k >= 10").withColumns({"v": F.concat(text.upper(c("v")), F.lit("!")), "_pos": c("_pos") - 10})
    return join.merge(rows.filter("k < 15"), right).select("k", "v")


@query("select n_regionkey as v, string_agg(n_name, ',' order by n_nationkey) as k from nation group by 1", "nation")
def group_dictionary(nation):
    d = nation.select(c("n_name").alias("k"), c("n_regionkey").alias("v"), c("n_nationkey").cast("bigint").alias("_pos"))
    return agg.group_dict(d).select("v", F.array_join("k", ",").alias("k"))


@query("select r_name as k, string_agg(n_name, ',' order by n_nationkey) as v from nation join region on n_regionkey=r_regionkey group by 1", "nation", "region")
def map_through(nation, region):
    d = nation.join(region, c("n_regionkey") == c("r_regionkey")).select(c("r_name").alias("k"), c("n_nationkey").cast("bigint").alias("v"), c("n_nationkey").cast("bigint").alias("_pos"))
    names = nation.select(c("n_nationkey").cast("bigint").alias("_pos"), c("n_name").alias("v"))
    return project.map_through(d, names).select("k", F.array_join("v", ",").alias("v"))


@query("select 'n_regionkey' as k, string_agg(n_regionkey::varchar, ',' order by n_nationkey) as v from nation union all select 'n_nationkey', string_agg(n_nationkey::varchar, ',' order by n_nationkey) from nation", "nation")
def flip_table(nation):
    t = nation.select("n_nationkey", "n_regionkey", c("n_nationkey").cast("bigint").alias("_pos"))
    return project.flip(t).select("k", F.array_join(c("v").cast("array<string>"), ",").alias("v"))


@query("select case when event_id<3 then event_id when event_id<8 then null else event_id-3 end as pos, event_id from events where event_id<3 or event_id>=8 union all select 3, -1 union all select 4, -2", "events")
def splice(events):
    rows = events.select("event_id", c("event_id").alias("_pos"))
    other = vec(events.sparkSession, [-1, -2], "bigint").withColumnRenamed("v", "event_id")
    return position.splice(rows, 3, 8, other).select(c("_pos").alias("pos"), "event_id")


@query("select vec_id, round(embedding[1]::double,6) as a, round(-2*embedding[2]::double,6) as b from embeddings", "embeddings")
def drill_update(embeddings):
    cells_ = embeddings.select("vec_id", project.drill(c("embedding").cast("array<double>"), [1], lambda x: x * -2).alias("e"))
    return cells_.select("vec_id", F.round(F.get("e", F.lit(0)), 6).alias("a"), F.round(F.get("e", F.lit(1)), 6).alias("b"))


@query("select event_id, event_type, value from events where event_id in (7, 3) union all select event_id, event_type, value from events where event_id=7", "events")
def index_rows(events):
    rows = events.select("event_id", "event_type", "value", c("event_id").alias("_pos"))
    return position.at(rows, vec(events.sparkSession, [7, 3, 7], "bigint")).select("event_id", "event_type", "value")


@query("select user_id, string_agg(w, ' ' order by event_id, i) as r from (select user_id, event_id, i, string_split(event_type, '_')[i] as w from events, range(1,9) t(i) where i<=len(string_split(event_type, '_'))) group by 1", "events")
def raze(events):
    made = agg.fold(events, ["user_id"], ("raze", text.split(c("event_type"), "_"), "r"), pos="event_id")
    return made.select("user_id", F.array_join("r", " ").alias("r"))


@query("select p_partkey, instr(p_name,'e')-1 + (case when instr(p_name,'e')=0 then 1+length(p_name) else 0 end) as at, lpad(p_partkey::varchar,8,'0') as z, reverse(p_name) as r from part", "part")
def text_places(part):
    return part.select("p_partkey", text.index_of(c("p_name"), "e").cast("bigint").alias("at"), text.zeros(c("p_partkey"), 8).alias("z"), F.reverse("p_name").alias("r"))


@query("select n_nationkey, factorial(n_nationkey % 10)::bigint as f, (n_nationkey*(n_nationkey-1)//2)::bigint as ch from nation", "nation")
def combinatorics(nation):
    n = c("n_nationkey")
    return nation.select("n_nationkey", F.factorial(n % 10).alias("f"), arith.choose(n, F.lit(2)).alias("ch"))


@query("with recursive f as (select 0 as n, 0::bigint as a, 1::bigint as b union all select n+1, b, a+b from f where n<24) select n_nationkey, a as fib from nation join f on n_nationkey=n", "nation")
def fibonacci(nation):
    return nation.select("n_nationkey", arith.fibonacci(c("n_nationkey")).alias("fib"))


@query("select a.n_nationkey as a, b.n_nationkey as b, c.n_nationkey as c from nation a, nation b, nation c where a.n_nationkey<b.n_nationkey and b.n_nationkey<c.n_nationkey", "nation")
def combinations(nation):
    made = sets.combinations(nation.select("n_nationkey", c("n_nationkey").cast("bigint").alias("_pos")), "n_nationkey", 3)
    return made.select(*[F.get("c", F.lit(i)).alias(n) for i, n in enumerate("abc")])


@query("select event_id, least(greatest(value, 10), 50) as cl, round(value - floor(value), 4) as fr, sign(value-50)::double as sg, round(tanh(value/100),6) as th from events", "events")
def clamp_mix(events):
    x = c("value")
    return events.select("event_id", arith.clamp(x, F.lit(10.0), F.lit(50.0)).alias("cl"), F.round(arith.fract(x), 4).alias("fr"), F.signum(x - 50).alias("sg"), F.round(F.tanh(x / 100), 6).alias("th"))


@query("select vec_id % 7 as g, j as j, round(sum(x),4) as v from (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding,1)-1 as j from embeddings) group by 1,2", "embeddings")
def gather_reduce(embeddings):
    rows = numeric.long_form(embeddings, "vec_id", "embedding")
    wanted = embeddings.select((c("vec_id") % 7).alias("g"), c("vec_id").alias("i"))
    return numeric.gather_reduce(wanted, rows).select("g", "j", F.round("v", 4).alias("v"))


@query("with e as (select vec_id, unnest(embedding)::double as x from embeddings), m as (select vec_id, avg(x) as mu, sqrt(var_pop(x)+1e-5) as sd from e group by 1) select vec_id, round(max((x-mu)/sd),5) as hi, round(min((x-mu)/sd),5) as lo from e join m using (vec_id) group by 1", "embeddings")
def layernorm(embeddings):
    normed = embeddings.select("vec_id", numeric.layernorm(c("embedding")).alias("y"))
    return normed.select("vec_id", F.round(F.array_max("y"), 5).alias("hi"), F.round(F.array_min("y"), 5).alias("lo"))


@query("with e as (select vec_id, unnest(embedding)::double as x from embeddings) select vec_id, round(sum(x),5) as re0, round(sqrt(sum(x*x))*8,4) as energy from e group by 1", "embeddings")
def fourier(embeddings):
    """By Parseval, the transform of 64 numbers has 64 times their energy."""
    spectrum = embeddings.select("vec_id", numeric.fft(c("embedding").cast("array<double>")).alias("f"))
    return spectrum.select("vec_id", F.round(F.get("f", F.lit(0)), 5).alias("re0"), F.round(numeric.length(c("f")), 4).alias("energy"))


@query("select word, count(*)::bigint as n from (select unnest(string_split(regexp_replace(lower(p_name), '[ ]+', ' ', 'g'), ' ')) as word from part) where word<>'' group by 1", "part")
def inverted_index(part):
    return agg.freq(text.postings(part, "p_partkey", "p_name"), "term").withColumnRenamed("term", "word")


@query("select c_custkey, crc as crc from (select c_custkey, c_name as crc from customer)", "customer")
def compress_round_trip(customer):
    packed = customer.select("c_custkey", hashes.compress(c("c_name"), "gzip").alias("z"))
    return packed.select("c_custkey", hashes.decompress(c("z"), "gzip").cast("string").alias("crc"))


# ---------------------------------------------------------------- the language


def session(spark: SparkSession, sf_dir: str, *tables: tuple[str, str, str | None]) -> Session:
    s = Session(spark)
    for name, of, pos in tables:
        s.table(name, table(spark, sf_dir, of), pos=pos)
    return s


def program(sql: str, source: str, *tables: tuple[str, str, str | None], rename: dict[str, str] | None = None):
    """Register a program of the language; its value is a table or a dictionary (k, v)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = session(spark, sf_dir, *tables)(source)
        df = value.df if hasattr(value, "keys") else value.df.select(*value.names)
        return df.withColumnsRenamed(rename or {})

    return run


EVENTS, ORDERS = ("t", "events", "event_id"), ("o", "orders", "o_orderkey")
for _name, _sql, _source, _tables, _rename in (
    ("lang_filter", "select * from events where value>100", "t@&t.value>100", (EVENTS,), {}),
    ("lang_grouped_fold", "select event_type as k, sum(value) as v from events group by 1", "(+/)'t.value@=t.event_type", (EVENTS,), {}),
    ("lang_freq", "select event_type as k, count(*) as v from events group by 1", "#'=t.event_type", (EVENTS,), {}),
    ("lang_top_k", "select * from orders order by o_totalprice desc, o_orderkey limit 10", "o@10#>o.o_totalprice", (ORDERS,), {}),
    ("lang_weighted_mean", "select event_type as k, sum(value*user_id)/sum(user_id) as v from events group by 1", "{(+/x)%+/t.user_id}'(t.value*t.user_id)@=t.event_type", (EVENTS,), {}),
):
    QUERIES[_name] = program(_sql, _source, *_tables, rename=_rename)
    SQL[_name] = _sql


# ---------------------------------------------------------------- streams


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern: the table may be one file, and a stream's plain path must be a folder
    return streams.listen(spark, f"{sf_dir}/event[s].parquet", table(spark, sf_dir, "events").schema)


def _folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one; only a local master may do without spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="posframe-stream-")
        atexit.register(shutil.rmtree, base, True)
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as messages, each batch put into a keyed table: the last event of each user."""
    folder = _folder(spark)
    store = streams.KeyedStore(spark, f"{folder}/store", "user_id", "user_id bigint, event_id bigint, event_type string")
    stream = _streamed(spark, sf_dir).select("user_id", "event_id", "event_type")
    streams.on_message(stream, lambda batch, n: store.upsert(batch, n, "event_id"), f"{folder}/checkpoint").awaitTermination()
    return store.table()


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: hourly counts and sums in event time, written by a streaming query as each batch's complete result."""
    folder = _folder(spark)
    made = streams.tumbling(_streamed(spark, sf_dir).withColumn("ts", c("ts").cast("timestamp")), "ts", "1 hour", ["event_type"], F.count("*").alias("n"), F.sum("value").alias("s"))
    rows = made.select(c("window.start").alias("hour"), "event_type", "n", F.round("s", 2).alias("s"))
    query_ = rows.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    query_.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out")).start().awaitTermination()
    return spark.read.schema("hour timestamp, event_type string, n bigint, s double").parquet(f"{folder}/out").withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


QUERIES["stream_upsert"] = stream_upsert
SQL["stream_upsert"] = "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by 1"
QUERIES["stream_windows"] = stream_windows
SQL["stream_windows"] = "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, event_type, count(*) as n, round(sum(value),2) as s from events group by 1,2"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of the ten best market segments and statuses: a projection, a filter, two lookups, a grouped fold and top-k."""
    # decimal money: the sum does not depend on the order of its rows
    lineitem = project.amend(table(spark, sf_dir, "lineitem"), {"rev": (c("l_extendedprice") * (1 - c("l_discount"))).cast("decimal(18,4)")})
    orders = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    customer = table(spark, sf_dir, "customer").select(c("c_custkey").alias("o_custkey"), "c_mktsegment")
    items = project.filter_mask(lineitem, c("l_quantity") > 5).select("l_orderkey", "rev")
    joined = join.equi(join.equi(items, orders, "l_orderkey"), customer, "o_custkey")
    revenue = agg.fold(joined, ["c_mktsegment", "o_orderstatus"], ("sum", "rev", "revenue"), ("count", "rev", "items"))
    return revenue.orderBy(c("revenue").desc(), "c_mktsegment", "o_orderstatus").limit(10).select("c_mktsegment", "o_orderstatus", c("revenue").cast("double").alias("revenue"), "items")


QUERIES["flagship"] = flagship
SQL["flagship"] = """select c_mktsegment, o_orderstatus, sum((l_extendedprice*(1-l_discount))::decimal(18,4))::double as revenue, count(*) as items
from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey where l_quantity>5
group by 1,2 order by revenue desc, 1, 2 limit 10"""
