"""F: set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from .registry import query


@query("F1_union_distinct", "SELECT n_name AS word FROM nation UNION SELECT r_name FROM region UNION SELECT p_name FROM part UNION SELECT p_brand FROM part")
def f1(spark, d):
    p = table(spark, d, "part")
    words = table(spark, d, "nation").select(F.col("n_name").alias("word"))
    for other in (table(spark, d, "region").select("r_name"), p.select("p_name"), p.select("p_brand")):
        words = words.union(other)
    return words.distinct()


@query("F2_union_all", "SELECT c_nationkey AS nation, 'customer' AS kind, c_custkey AS id FROM customer UNION ALL SELECT s_nationkey, 'supplier', s_suppkey FROM supplier")
def f2(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"))
    return c.unionByName(s)


@query("F3_difference", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25")
def f3(spark, d):
    li = table(spark, d, "lineitem")
    known = li.where("l_returnflag = 'R' AND l_quantity > 25").select("l_partkey")
    return li.where("l_returnflag = 'N'").select("l_partkey").distinct().join(known, "l_partkey", "left_anti")


@query("F4_intersection", "SELECT l_partkey FROM lineitem WHERE l_suppkey % 2 = 0 INTERSECT SELECT l_partkey FROM lineitem WHERE l_suppkey % 2 = 1")
def f4(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    return li.where("l_suppkey % 2 = 0").select("l_partkey").intersect(li.where("l_suppkey % 2 = 1").select("l_partkey"))


@query("F5_resolution_marking", """SELECT doc_id, quality, doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500) AS resolved FROM labels""")
def f5(spark, d):
    rescan = table(spark, d, "documents").where("n_chars > 500").select("doc_id", F.lit(True).alias("still"))
    return table(spark, d, "labels").select("doc_id", "quality").join(rescan, "doc_id", "left").select(
        "doc_id", "quality", F.col("still").isNull().alias("resolved"))
