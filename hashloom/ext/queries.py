"""Extension queries (``ext_``), each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hashloom.ext import relational
from hashloom.sources import tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query("select l.event_id, l.user_id, cast(r.event_id as varchar) as last_purchase from (select * from events where event_type = 'view') l asof left join (select * from events where event_type = 'purchase') r on l.user_id = r.user_id and l.ts >= r.ts")
def ext_asof_join(spark, d):
    e = tables.read(spark, d, "events").withColumn("day", F.to_date("ts"))
    views = e.where("event_type = 'view'").select("event_id", "user_id", "ts", "day")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", "day", F.col("event_id").cast("string").alias("last_purchase"))
    return relational.asof_join(views, bought, ["user_id"], "ts", ["last_purchase"], "day").select("event_id", "user_id", "last_purchase")


@query("select e.event_id, s.s_suppkey from events e join supplier s on e.value >= s.s_suppkey and e.value < s.s_suppkey + 2.5")
def ext_range_join(spark, d):
    low = F.col("s_suppkey").cast("double")
    spans = tables.read(spark, d, "supplier").select("s_suppkey", low.alias("low"), (low + 2.5).alias("high"))
    return relational.range_join(tables.read(spark, d, "events").select("event_id", "value"), "value", spans, "low", "high", 5.0).select("event_id", "s_suppkey")


@query("select coalesce(c_mktsegment, 'all') as segment, coalesce(cast(c_nationkey as varchar), 'all') as nation, count(*) as n from customer group by cube (c_mktsegment, c_nationkey)")
def ext_cube(spark, d):
    c = tables.read(spark, d, "customer").select("c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nationkey"))
    return c.cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n")).select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), F.coalesce("c_nationkey", F.lit("all")).alias("nation"), "n")


@query(
    """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hour then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
    select user_id, count(*) as n, min(event_id) as first_id, epoch_us(min(ts)) as started from s group by user_id, k"""
)
def ext_session_window(spark, d):
    e = tables.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return relational.sessions(e, ["user_id"], "ts", "12 hours", F.count("*").alias("n"), F.min("event_id").alias("first_id")).select("user_id", "n", "first_id", F.unix_micros("start").alias("started"))


@query("select event_type, epoch_us(time_bucket(interval 1 day, ts)) as started, count(*) as n from events group by 1, 2")
def ext_tumbling_window(spark, d):
    e = tables.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return relational.tumbling(e, ["event_type"], "ts", "1 day", F.count("*").alias("n")).select("event_type", F.unix_micros("start").alias("started"), "n")


@query("select c_nationkey, c_custkey, cast(rank() over w as integer) as r, cast(ntile(4) over w as integer) as quarter, cast(coalesce(lag(c_custkey) over w, -1) as bigint) as before from customer window w as (partition by c_nationkey order by c_acctbal desc, c_custkey)")
def ext_ranking(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return tables.read(spark, d, "customer").select("c_nationkey", "c_custkey", F.rank().over(w).alias("r"), F.ntile(4).over(w).alias("quarter"), F.coalesce(F.lag("c_custkey").over(w), F.lit(-1)).cast("long").alias("before"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 5")
def ext_top_k(spark, d):
    return tables.read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(25)


@query("(select c_nationkey as k from customer intersect select s_nationkey from supplier) union all (select n_nationkey from nation except select s_nationkey from supplier)")
def ext_set_operations(spark, d):
    of = lambda t, c: tables.read(spark, d, t).select(F.col(c).alias("k"))
    return of("customer", "c_nationkey").intersect(of("supplier", "s_nationkey")).unionAll(of("nation", "n_nationkey").subtract(of("supplier", "s_nationkey")))
