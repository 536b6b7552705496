"""Queries of the keyed writers and of standard relational extras, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom import views as V
from chronoloom.registry import query
from chronoloom.sources import sinks as K


def customers(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


def changes(spark, d):
    c = customers(spark, d).where("c_custkey % 2 = 0")
    return c.select("c_custkey", F.concat("c_name", F.lit("!")).alias("c_name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("seen"), (F.col("c_acctbal") * 2).alias("c_acctbal"))


@query("snk01_upsert", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, c_name || '*', c_nationkey, c_acctbal FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey + 1000000, c_name || '*', c_nationkey, c_acctbal FROM customer WHERE c_custkey % 8 = 0""")
def snk01(spark, d):
    c = customers(spark, d)
    new = c.where("c_custkey % 4 = 0").withColumn("c_name", F.concat("c_name", F.lit("*")))
    return K.upsert(c, new.unionByName(new.where("c_custkey % 8 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)), "c_custkey")


@query("snk02_update_if", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN c_name || '!' ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer""")
def snk02(spark, d):
    return K.update_if(customers(spark, d), changes(spark, d), "c_custkey", {"c_nationkey": "seen"}, ["c_name", "c_acctbal"])


@query("snk03_replace_if_same", """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 10 <> 0 THEN 'new' ELSE c_name END AS c_name, c_nationkey, c_acctbal FROM customer""")
def snk03(spark, d):
    c = customers(spark, d).withColumn("doc", F.to_json(F.struct("c_name", "c_acctbal")))
    ch = c.where("c_custkey % 5 = 0").select("c_custkey", F.lit("new").alias("c_name"), F.when(F.col("c_custkey") % 10 == 0, F.lit("{}")).otherwise(F.col("doc")).alias("seen"))
    return K.update_if(c, ch, "c_custkey", {"doc": "seen"}, ["c_name"]).drop("doc")


@query("udf1_update_by_expression", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_acctbal > 0 THEN upper(c_name) ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_acctbal > 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer""")
def udf1(spark, d):
    values = {"c_name": F.upper("c_name"), "c_acctbal": F.col("c_acctbal") * 2}
    return K.update_with(customers(spark, d), changes(spark, d), "c_custkey", {"c_nationkey": "seen"}, values, F.col("c_acctbal") > 0)


@query("snk04_delete", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 6 <> 1")
def snk04(spark, d):
    c = customers(spark, d)
    return K.delete(c, c.where("c_custkey % 6 = 1"), "c_custkey")


@query("snk05_fill_column", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 2 = 0 THEN c_name || '!' END AS cover FROM customer""")
def snk05(spark, d):
    c = customers(spark, d).select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("cover"))
    return K.fill_if(c, changes(spark, d).withColumnRenamed("c_name", "cover"), "c_custkey", {"c_nationkey": "seen"}, "cover").select("c_custkey", "cover")


@query("snk06_export", """SELECT c_custkey, '{"version":1,"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}' AS value FROM customer""")
def snk06(spark, d):
    c = customers(spark, d)
    return c.select("c_custkey", F.to_json(F.struct(F.lit(1).alias("version"), "c_name", "c_nationkey")).alias("value"))


@query("snk09_serialise", V.sql(V.NOTES) + """
SELECT note_id, round_even(start_us / 1000.0, 0)::BIGINT AS start_ms, round_even(dur_us / 1000.0, 0)::BIGINT AS dur_ms FROM notes""")
def snk09(spark, d):
    return V.notes(spark, d).select("note_id", F.bround(F.col("start_us") / 1000).cast("long").alias("start_ms"), F.bround(F.col("dur_us") / 1000).cast("long").alias("dur_ms"))


@query("snk11_id_list", """SELECT c_nationkey, '["' || array_to_string(list_sort(list_distinct(list(c_mktsegment))), '","') || '"]' AS ids FROM customer GROUP BY 1""")
def snk11(spark, d):
    from chronoloom.functions.arrays import id_list

    return V.table(spark, d, "customer").groupBy("c_nationkey").agg(id_list(F.collect_set("c_mktsegment")).alias("ids"))


@query("ext_rollup", """
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::BIGINT AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup(spark, d):
    return V.table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("qty"))


@query("ext_cube", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def cube(spark, d):
    return V.table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("ext_ranks", """
SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) AS q FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)""")
def ranks(spark, d):
    w = W.partitionBy("c_nationkey").orderBy("c_mktsegment")
    return V.table(spark, d, "customer").select("c_custkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"), F.ntile(4).over(W.partitionBy("c_nationkey").orderBy("c_mktsegment", "c_custkey")).cast("long").alias("q"))


@query("ext_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12")
def having(spark, d):
    return V.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 12")


@query("ext_tumbling", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def tumbling(spark, d):
    return V.table(spark, d, "events").groupBy(F.window(F.col("ts"), "1 hour").getField("start").alias("hour"), "event_type").agg(F.count("*").alias("n"))
