"""Joins, set operations, grouping and ranking over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import views
from .queries_play import _r, r

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


@query("rel_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def rel_semi(spark, sf):
    big = views.table(spark, sf, "orders").where("o_totalprice > 200000")
    return views.table(spark, sf, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("rel_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def rel_anti(spark, sf):
    return views.table(spark, sf, "customer").join(views.table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("joi01_full_outer", "WITH a AS (SELECT c_nationkey AS nation, count(*) AS customers FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1), b AS (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY 1) SELECT coalesce(a.nation, b.nation) AS nation, customers, suppliers FROM a FULL JOIN b ON a.nation = b.nation")
def rel_full(spark, sf):
    a = views.table(spark, sf, "customer").where("c_nationkey % 3 <> 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = views.table(spark, sf, "supplier").where("s_nationkey % 2 = 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full_outer")


@query("rel_asof", """WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), b AS (SELECT user_id, ts AS ts2, max(event_id) AS last_view FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT a.event_id, b.last_view FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts2""")
def rel_asof(spark, sf):
    e = views.table(spark, sf, "events").where("event_type in ('click', 'view')")
    # one sort of both sides: the last view at or before each click; at one time views come first
    w = Window.partitionBy("user_id").orderBy("ts", F.desc("event_type"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("last_view", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), True).over(w)).where("event_type = 'click'").select("event_id", "last_view")


@query("rel_range", "WITH b AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS s, l_quantity + 2 AS e FROM lineitem) SELECT a.k, count(*) AS overlaps FROM b a JOIN b ON a.k = b.k AND a.n < b.n AND a.s < b.e AND b.s < a.e GROUP BY a.k")
def rel_range(spark, sf):
    li = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("s"), (F.col("l_quantity") + 2).alias("e"))
    a, b = li.alias("a"), li.alias("b")
    on = (F.col("a.k") == F.col("b.k")) & (F.col("a.n") < F.col("b.n")) & (F.col("a.s") < F.col("b.e")) & (F.col("b.s") < F.col("a.e"))
    return a.join(b, on).groupBy(F.col("a.k").alias("k")).agg(F.count("*").alias("overlaps"))


@query("rel_union", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def rel_union(spark, sf):
    return views.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).union(views.table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("rel_except", "SELECT o_custkey AS k FROM orders WHERE o_totalprice < 100000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def rel_except(spark, sf):
    o = views.table(spark, sf, "orders")
    return o.where("o_totalprice < 100000").select(F.col("o_custkey").alias("k")).subtract(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("rel_intersect", "SELECT o_custkey AS k FROM orders WHERE o_totalprice < 100000 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def rel_intersect(spark, sf):
    o = views.table(spark, sf, "orders")
    return o.where("o_totalprice < 100000").select(F.col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("rel_topk", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def rel_topk(spark, sf):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return views.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", n.alias("n")).where("n <= 3").drop("n")


@query("rel_cube", f"SELECT l_returnflag, l_linestatus, count(*) AS rows, {r('sum(l_quantity)', 'quantity', 2)} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rel_cube(spark, sf):
    return views.table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("rows"), F.sum("l_quantity").alias("quantity")).select("l_returnflag", "l_linestatus", "rows", _r("quantity", 2))


@query("rel_rollup", f"SELECT r_name, n_name, count(*) AS rows, {r('sum(c_acctbal)', 'balance', 2)} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rel_rollup(spark, sf):
    d = views.table(spark, sf, "customer").join(views.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(views.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return d.rollup("r_name", "n_name").agg(F.count("*").alias("rows"), F.sum("c_acctbal").alias("balance")).select("r_name", "n_name", "rows", _r("balance", 2))


@query("rel_rank_frames", f"SELECT o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, {r('avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 'moving', 4)} FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def rel_rank(spark, sf):
    w, m = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-2, 0)
    d = views.table(spark, sf, "orders").select("o_orderkey", F.rank().over(w).cast("bigint").alias("rank"), F.dense_rank().over(w).cast("bigint").alias("dense"), F.avg("o_totalprice").over(m).alias("moving"))
    return d.select("o_orderkey", "rank", "dense", _r("moving", 4))


@query("rel_pricing_summary", f"""SELECT l_returnflag, l_linestatus, {r('sum(l_quantity)', 'sum_qty', 2)}, {r('sum(l_extendedprice * (1 - l_discount))', 'sum_disc_price', 2)}, {r('avg(l_discount)', 'avg_disc')}, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def rel_pricing(spark, sf):
    d = views.table(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ'1998-09-02'")
    d = d.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sum_disc_price"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("count_order"))
    return d.select("l_returnflag", "l_linestatus", _r("sum_qty", 2), _r("sum_disc_price", 2), _r("avg_disc"), "count_order")


@query("rel_distinct_keep_last", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def rel_keep_last(spark, sf):
    return views.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
