"""C: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import stratum
from ..operators import geo, linking
from ..operators.pairs import pairs_between, pairs_within
from ..operators.scan import top_per_group
from ..sources.tables import table
from .base import BUCKET_SQL, COORDS_SQL, LINES_SQL, TYPED_SQL, coords, doc_lines, documents, labelled, part_members, r6, typed_edges
from .registry import query


@query("C1_composite_key_join", """SELECT a.conv_id, a.turn, a.role, b.n_chars FROM conversations a
JOIN (SELECT conv_id, turn, length(text) AS n_chars FROM conversations) b ON a.conv_id = b.conv_id AND a.turn = b.turn""")
def c1(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", "role").join(
        c.select("conv_id", "turn", F.length("text").cast("long").alias("n_chars")), ["conv_id", "turn"])


@query("C2_left_lookup", "SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)")
def c2(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(
        table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("C3_star_lookup", """SELECT DISTINCT l_partkey, s_nationkey, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0""")
def c3(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    s = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return li.join(s, "l_suppkey").join(n, "s_nationkey").select("l_partkey", "s_nationkey", "n_name").distinct()


@query("C4_semi_joins", """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_custkey = c_custkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)""")
def c4(spark, d):
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(returned, "o_orderkey", "left_semi")
    seen = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left_semi").join(seen, "c_custkey", "left_semi")


@query("C5_anti_join_queue", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def c5(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("C6_double_anti_join", """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 40)""")
def c6(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    done = li.where("l_returnflag = 'R'").select("o_orderkey")
    flying = li.where("l_linestatus = 'O' AND l_quantity > 40").select("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti").join(flying, "o_orderkey", "left_anti")


@query("C7_endpoint_attributes", f"""WITH {TYPED_SQL}
SELECT relation, year, c_mktsegment AS src_kind, s_nationkey AS dst_kind, count(*) AS n FROM typed
LEFT JOIN customer ON src = 'c' || c_custkey LEFT JOIN supplier ON dst = 's' || s_suppkey GROUP BY ALL""")
def c7(spark, d):
    s = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.col("c_mktsegment").alias("src_kind"))
    t = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("dst"), F.col("s_nationkey").alias("dst_kind"))
    e = typed_edges(spark, d).join(s, "src", "left").join(t, "dst", "left")
    return e.groupBy("relation", "year", "src_kind", "dst_kind").agg(F.count("*").alias("n"))


@query("C8_dashboard_row", """SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels WHERE quality = 1) AS good,
(SELECT count(DISTINCT conv_id) FROM conversations) AS conversations, (SELECT round(sum(value), 4) FROM events) AS event_value""")
def c8(spark, d):
    docs = table(spark, d, "documents").agg(F.count("*").alias("n"))
    good = table(spark, d, "labels").agg(F.count_if(F.col("quality") == 1).alias("n"))
    conv = table(spark, d, "conversations").agg(F.countDistinct("conv_id").alias("n"))
    value = table(spark, d, "events").agg(F.round(F.sum("value"), 4).alias("v"))
    return spark.range(1).select(
        docs.scalar().alias("documents"), good.scalar().alias("good"),
        conv.scalar().alias("conversations"), value.scalar().alias("event_value"))


@query("C9_pairs_in_context", """WITH m AS (SELECT DISTINCT l_orderkey AS ctx, l_partkey AS node FROM lineitem)
SELECT a.ctx, a.node AS node_a, b.node AS node_b FROM m a JOIN m b ON a.ctx = b.ctx AND a.node < b.node""")
def c9(spark, d):
    return pairs_within(part_members(spark, d), ["ctx"], "node")


@query("C10_typed_bipartite_pairs", """WITH s AS (SELECT DISTINCT l_orderkey AS ctx, l_suppkey AS place FROM lineitem),
p AS (SELECT DISTINCT l_orderkey AS ctx, l_partkey AS actor FROM lineitem WHERE l_returnflag <> 'N')
SELECT place, actor, count(*) AS contexts FROM s JOIN p USING (ctx) GROUP BY ALL""")
def c10(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "ctx")
    places = li.select("ctx", F.col("l_suppkey").alias("place")).distinct()
    actors = li.where("l_returnflag <> 'N'").select("ctx", F.col("l_partkey").alias("actor")).distinct()
    return pairs_between(places, actors, ["ctx"]).groupBy("place", "actor").agg(F.count("*").alias("contexts"))


@query("C11_mention_in_line", f"""WITH {LINES_SQL},
forms AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\p{{Lu}}\\p{{Ll}}+')) AS form FROM documents)
SELECT doc_id, form, line_no FROM lines JOIN forms USING (doc_id) WHERE contains(line, form)""")
def c11(spark, d):
    forms = table(spark, d, "documents").select(
        "doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{Ll}+"), F.lit(0)))).alias("form"))
    return linking.mentions_in_lines(forms, doc_lines(spark, d), ["doc_id"]).select("doc_id", "form", "line_no")


_KM = "2 * 6371.0088 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))"


@query("C12_within_distance", f"""WITH {COORDS_SQL}
SELECT a.place_id AS place_a, b.place_id AS place_b, round({_KM}, 6) AS km FROM coords a JOIN coords b ON a.place_id < b.place_id WHERE {_KM} <= 50""")
def c12(spark, d):
    pts = coords(spark, d).select("place_id", "lat", "lon")
    near = geo.within_radius(pts, pts, "place_id", 50.0)
    return near.where("id_a < id_b").select(F.col("id_a").alias("place_a"), F.col("id_b").alias("place_b"), r6("km").alias("km"))


@query("C12_nearest_neighbour", f"""WITH {COORDS_SQL}
SELECT a.place_id, round(min({_KM}), 6) AS km FROM coords a JOIN coords b ON a.place_id <> b.place_id GROUP BY ALL""")
def c12b(spark, d):
    pts = coords(spark, d).select("place_id", "lat", "lon")
    return geo.nearest(pts, pts, "place_id", start_km=10.0).select("place_id", r6("km").alias("km"))


@query("C13_year_strata", f"""WITH {TYPED_SQL}
SELECT stratum, count(*) AS n FROM (SELECT CASE WHEN year <= 1994 THEN 'early' WHEN year BETWEEN 1995 AND 1997 THEN 'middle'
WHEN year BETWEEN 1998 AND 1999 THEN 'late' END AS stratum FROM typed) GROUP BY ALL""")
def c13(spark, d):
    strata = (("early", None, 1994), ("middle", 1995, 1997), ("late", 1998, 1999))
    return typed_edges(spark, d).groupBy(stratum(F.col("year"), strata).alias("stratum")).agg(F.count("*").alias("n"))


@query("C16_ordered_fallback_join", """WITH l AS (SELECT 'id:' || p_partkey AS key, 'by_id' AS label FROM part WHERE p_size < 10
  UNION ALL SELECT 'name:' || p_name, 'by_name' FROM part WHERE p_size = 30 GROUP BY ALL
  UNION ALL SELECT 'name:' || p_brand, 'by_brand' FROM part WHERE p_size = 31 GROUP BY ALL)
SELECT p_partkey, coalesce(a.label, b.label, c.label) AS label FROM part
LEFT JOIN l a ON a.key = 'id:' || p_partkey LEFT JOIN l b ON b.key = 'name:' || p_name LEFT JOIN l c ON c.key = 'name:' || p_brand
WHERE coalesce(a.label, b.label, c.label) IS NOT NULL""")
def c16(spark, d):
    p = table(spark, d, "part")
    key = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c))
    labels = p.where("p_size < 10").select(key("id", "p_partkey").alias("key"), F.lit("by_id").alias("label")).union(
        p.where("p_size = 30").select(key("name", "p_name"), F.lit("by_name")).distinct()).union(
        p.where("p_size = 31").select(key("name", "p_brand"), F.lit("by_brand")).distinct())
    rows = p.select("p_partkey", F.array(key("id", "p_partkey"), key("name", "p_name"), key("name", "p_brand")).alias("keys"))
    return linking.fallback_join(rows, ["p_partkey"], "keys", labels, "key", "label")


@query("C17_feature_family_merge", """SELECT a.s_suppkey, a.n_lines, b.n_parts, coalesce(c.n_late, 0) AS n_late FROM
(SELECT l_suppkey AS s_suppkey, count(*) AS n_lines FROM lineitem GROUP BY ALL) a JOIN
(SELECT l_suppkey AS s_suppkey, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY ALL) b USING (s_suppkey) LEFT JOIN
(SELECT l_suppkey AS s_suppkey, count(*) AS n_late FROM lineitem WHERE l_quantity > 49 GROUP BY ALL) c USING (s_suppkey)""")
def c17(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    a = li.groupBy("s_suppkey").agg(F.count("*").alias("n_lines"))
    b = li.groupBy("s_suppkey").agg(F.countDistinct("l_partkey").alias("n_parts"))
    c = li.where("l_quantity > 49").groupBy("s_suppkey").agg(F.count("*").alias("n_late"))
    return a.join(b, "s_suppkey").join(c, "s_suppkey", "left").fillna(0)


@query("C18_token_to_head", """SELECT t.l_orderkey, t.l_linenumber, h.l_returnflag AS head_upos FROM lineitem t
LEFT JOIN (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) h
ON h.l_orderkey = t.l_orderkey AND h.l_linenumber = t.l_partkey % 8""")
def c18(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 8).cast("int").alias("head"), "l_returnflag")
    h = t.groupBy("l_orderkey", F.col("l_linenumber").alias("head")).agg(F.min("l_returnflag").alias("head_upos"))
    return t.join(h, ["l_orderkey", "head"], "left").select("l_orderkey", "l_linenumber", "head_upos")


@query("C19_coefficient_tables", """WITH a AS (SELECT p_name AS phrase, arg_max(x, (abs(x), x)) AS x FROM (SELECT p_name, p_retailprice - 1000 AS x FROM part) GROUP BY ALL),
b AS (SELECT p_name AS phrase, arg_max(y, (abs(y), y)) AS y FROM (SELECT p_name, p_size - 24.5::DOUBLE AS y FROM part WHERE p_size > 3) GROUP BY ALL)
SELECT phrase, round(x, 6) AS x, y, CASE WHEN y >= 0 THEN 'mythic' ELSE 'historical' END AS direction FROM a JOIN b USING (phrase)""")
def c19(spark, d):
    p = table(spark, d, "part")
    strongest = lambda c: F.max_by(c, F.struct(F.abs(c), c))
    a = p.select(F.col("p_name").alias("phrase"), (F.col("p_retailprice") - 1000).alias("v")).groupBy("phrase").agg(strongest(F.col("v")).alias("x"))
    b = p.where("p_size > 3").select(F.col("p_name").alias("phrase"), (F.col("p_size") - F.lit(24.5)).alias("v")).groupBy("phrase").agg(strongest(F.col("v")).alias("y"))
    return a.join(b, "phrase").select("phrase", r6("x").alias("x"), "y", F.when(F.col("y") >= 0, "mythic").otherwise("historical").alias("direction"))
