"""B: projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from ..sources.tables import table
from ..sources.text import id_between, id_key
from .base import BUCKET_SQL, LINES_SQL, doc_lines, documents, labelled
from .registry import query


@query("B1_labelled_only", "SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def b1(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    both = docs.join(table(spark, d, "labels"), "doc_id", "left")
    return both.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", "lang", "quality")


@query("B2_prefix_and_substring", """SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'blue%' OR substr(p_type, 1, 1) = 'S' OR contains(p_brand, '#1')""")
def b2(spark, d):
    p = table(spark, d, "part")
    keep = F.col("p_name").like("blue%") | (F.substring("p_type", 1, 1) == "S") | F.contains("p_brand", F.lit("#1"))
    return p.where(keep).select("p_partkey", "p_name")


@query("B3_array_membership", """SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')
AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def b3(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "user_id").where(F.col("event_type").isin("click", "view"))
    banned = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("user_id"))
    return e.join(banned, "user_id", "left_anti").select("event_id", "event_type")


@query("B4_id_span_flag", f"""WITH {LINES_SQL}
SELECT doc_id, line_no, book || '.' || (doc_id % 10) || '.' || line_no AS passage_id,
  (book, doc_id % 10, line_no) >= (4, 4, 1) AND (book, doc_id % 10, line_no) <= (14, 2, 7) AS in_span FROM lines""")
def b4(spark, d):
    pid = F.concat_ws(".", F.col("book"), F.col("doc_id") % 10, F.col("line_no"))
    return doc_lines(spark, d).select(
        "doc_id", "line_no", pid.alias("passage_id"), id_between(pid, (4, 4, 1), (14, 2, 7)).alias("in_span")
    )


@query("B5_bounding_box_null_passes", """SELECT s_suppkey, s_acctbal FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier)
WHERE s_acctbal IS NULL OR s_acctbal BETWEEN 1000 AND 6000""")
def b5(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 9 != 0, F.col("s_acctbal")).alias("s_acctbal"))
    return s.where(F.col("s_acctbal").isNull() | F.col("s_acctbal").between(1000, 6000))


@query("B6_id_parts_and_sort_key", f"""WITH {LINES_SQL}
SELECT doc_id, line_no, book AS book, CAST(doc_id % 10 AS INTEGER) AS chapter,
  book * 1000000::BIGINT + (doc_id % 10) * 10000 + line_no AS sort_key FROM lines""")
def b6(spark, d):
    pid = F.concat_ws(".", F.col("book"), F.col("doc_id") % 10, F.col("line_no"))
    key = id_key(pid)
    return doc_lines(spark, d).select(
        "doc_id", "line_no",
        F.split_part(pid, F.lit("."), F.lit(1)).cast("int").alias("book"),
        F.split_part(pid, F.lit("."), F.lit(2)).cast("int").alias("chapter"),
        (key[0].cast("long") * 1000000 + key[1] * 10000 + key[2]).alias("sort_key"),
    )


@query("B7_entity_type_normalised", """SELECT event_id, CASE WHEN event_type LIKE 'c%' THEN 'place' WHEN event_type LIKE 'v%' THEN 'deity'
 WHEN event_type LIKE 'person%' OR event_type IN ('purchase', 'login') THEN 'person' ELSE 'other' END AS entity_type FROM events""")
def b7(spark, d):
    renamed = {"c": "Place name", "v": "deity "}
    raw = F.when(F.col("event_type").startswith("c"), renamed["c"]).when(
        F.col("event_type").startswith("v"), renamed["v"]
    ).when(F.col("event_type") == "purchase", "People").when(F.col("event_type") == "login", "people group").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", quality.entity_type(raw).alias("entity_type"))


@query("B8_two_flags_to_bucket", f"SELECT doc_id, {BUCKET_SQL} AS bucket FROM labels")
def b8(spark, d):
    return labelled(spark, d).select("doc_id", "bucket")


@query("B9_label_text_to_bucket", f"SELECT doc_id, {BUCKET_SQL} AS bucket FROM labels")
def b9(spark, d):
    spelled = F.when(F.col("bucket") == "both", "Mixed ").when(F.col("bucket") == "mythic", "MYTHIC").when(
        F.col("bucket") == "historical", " history").otherwise("none")
    return labelled(spark, d).select(
        "doc_id",
        quality.map_or_error(
            spelled,
            {"mixed": "both", "mythic": "mythic", "history": "historical", "none": "other"},
        ).alias("bucket"),
    )


@query("B10_status_scope_to_label", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus <> 'O' THEN 'exclude'
 WHEN l_returnflag = 'A' THEN 'survives' WHEN l_returnflag = 'R' THEN 'does_not_survive' ELSE 'exclude' END AS label FROM lineitem""")
def b10(spark, d):
    status = F.when(F.col("l_returnflag") == "A", "extant_uninhabited").when(
        F.col("l_returnflag") == "R", "ruined_or_remains").otherwise("unclear")
    scope = F.when(F.col("l_linestatus") == "O", "present").otherwise("past")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", quality.status_label(status, scope, "present").alias("label"))


@query("B11_scope_filter_toggle", """SELECT 'all' AS scope, doc_id FROM documents
UNION ALL SELECT 'without_4_8', doc_id FROM documents WHERE source NOT IN ('src4', 'src8')""")
def b11(spark, d):
    docs = documents(spark, d)
    wide = quality.scope(docs, "book", exclude=(4, 8), include_all=True)
    narrow = quality.scope(docs, "book", exclude=(4, 8), include_all=False)
    return wide.select(F.lit("all").alias("scope"), "doc_id").unionByName(
        narrow.select(F.lit("without_4_8").alias("scope"), "doc_id"))


@query("B12_priority_order", """SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN book IN (3, 1) THEN 0 ELSE 1 END, CASE WHEN book IN (4, 8) THEN 1 ELSE 0 END, book, doc_id) AS position
FROM (SELECT doc_id, CAST(substr(source, 4) AS INTEGER) AS book FROM documents) ORDER BY position LIMIT 100""")
def b12(spark, d):
    docs = documents(spark, d).select("doc_id", "book")
    return quality.prioritise(docs, "book", first=(3, 1), last=(4, 8), then=["book", "doc_id"], limit=100)
