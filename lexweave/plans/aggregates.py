"""D: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import labels as lab
from ..operators import summaries
from ..operators.scan import md5_key, quantiles
from ..sources.tables import table
from .base import BUCKET_SQL, LINES_SQL, TYPED_SQL, doc_lines, documents, labelled, r6, typed_edges
from .registry import query

LANGS = ("de", "en", "es", "fr")
BUCKETS = ("mythic", "historical", "both", "other")
_BL = f"bl AS (SELECT doc_id, lang, CAST(substr(source, 4) AS INTEGER) AS book, {BUCKET_SQL} AS bucket, quality, toxic FROM documents JOIN labels USING (doc_id))"


def bucket_docs(spark, d):
    docs = documents(spark, d).select("doc_id", "lang", "book")
    return docs.join(labelled(spark, d), "doc_id")


@query("D1_group_count_min_sum", """SELECT l_suppkey, l_returnflag, count(*) AS n, min(l_shipdate) AS first_ship, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY ALL""")
def d1(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.count("*").alias("n"), F.min("l_shipdate").alias("first_ship"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("D2_distinct_counts", """SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_partkey, l_suppkey)) AS part_suppliers FROM lineitem""")
def d2(spark, d):
    # Distinct first, count after: no count-distinct expansion of every row.
    li = table(spark, d, "lineitem")
    pairs = li.select("l_partkey", "l_suppkey").distinct().groupBy("l_partkey").agg(F.count("*").alias("n"))
    return pairs.agg(F.count("*").alias("parts"), F.sum("n").alias("part_suppliers"))


@query("D3_filtered_aggregates", """SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned,
 coalesce(round(sum(l_extendedprice) FILTER (WHERE l_discount > 0.05), 2), 0) AS discounted FROM lineitem GROUP BY ALL""")
def d3(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.coalesce(F.round(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice"))), 2), F.lit(0.0)).alias("discounted"))


@query("D4_conditional_sum", """SELECT o_orderstatus, sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END)::BIGINT AS urgent,
 round(sum(CASE WHEN o_totalprice > 200000 THEN o_totalprice ELSE 0 END), 2) AS large FROM orders GROUP BY ALL""")
def d4(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.sum(F.when(F.col("o_orderpriority").like("1%"), 1).otherwise(0)).alias("urgent"),
        F.round(F.sum(F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice")).otherwise(0.0)), 2).alias("large"))


@query("D5_numbered_lines", f"""WITH {LINES_SQL}
SELECT doc_id, string_agg(line_no || '. ' || line, chr(10) ORDER BY line_no) AS body FROM lines GROUP BY ALL""")
def d5(spark, d):
    # Lines of one document regrouped: the group is one source row, so it is bounded.
    return summaries.numbered_text(doc_lines(spark, d), ["doc_id"], "line_no", "line", "body")


@query("D6_table_fingerprint", """SELECT count(*) AS n_rows, bit_xor(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS xor_hash,
 CAST(sum(CAST('0x' || substr(h, 16, 8) AS BIGINT)) % 1000000007 AS BIGINT) AS sum_hash, sha256('k=20|min=2') AS params
FROM (SELECT md5(concat_ws(chr(31), o_orderkey, o_custkey, o_orderstatus, o_orderpriority)) AS h FROM orders)""")
def d6(spark, d):
    return summaries.fingerprint(
        table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], {"k": 20, "min": 2})


@query("D7_endpoint_counts", f"""WITH {TYPED_SQL}
SELECT node, count(*) AS n FROM (SELECT src AS node FROM typed UNION ALL SELECT dst FROM typed) GROUP BY ALL""")
def d7(spark, d):
    return summaries.endpoint_counts(typed_edges(spark, d), "src", "dst")


@query("D8_pivot_with_zero_fill", f"""WITH {_BL}, dom AS (SELECT b.bucket, l.lang FROM (VALUES ('mythic'), ('historical'), ('both'), ('other')) b(bucket), (VALUES ('de'), ('en'), ('es'), ('fr'), ('xx')) l(lang))
SELECT dom.bucket, dom.lang, count(bl.doc_id) AS n FROM dom LEFT JOIN bl ON bl.bucket = dom.bucket AND bl.lang = dom.lang GROUP BY ALL""")
def d8(spark, d):
    counts = bucket_docs(spark, d).groupBy("bucket", "lang").agg(F.count("*").alias("n"))
    return summaries.on_domain(counts, {"bucket": BUCKETS, "lang": (*LANGS, "xx")}, ["n"])


@query("D9_row_shares", f"""WITH {_BL}, c AS (SELECT bucket, lang, count(*) AS n FROM bl GROUP BY ALL)
SELECT bucket, lang, round(n / sum(n) OVER (PARTITION BY bucket), 6) AS share, round(100 * n / sum(n) OVER (PARTITION BY bucket), 6) AS percent FROM c""")
def d9(spark, d):
    counts = bucket_docs(spark, d).groupBy("bucket", "lang").agg(F.count("*").alias("n"))
    s = summaries.row_shares(counts, ["bucket"], "n")
    return s.select("bucket", "lang", r6("share").alias("share"), r6(100 * F.col("share")).alias("percent"))


@query("D10_rates_by_group", f"""WITH {_BL}, dom AS (SELECT book, bucket FROM (SELECT DISTINCT book FROM bl), (VALUES ('mythic'), ('historical'), ('both'), ('other')) b(bucket))
SELECT dom.book, dom.bucket, round(100.0::DOUBLE * count(bl.doc_id) / max(t.n), 1) AS rate FROM dom JOIN (SELECT book, count(*) AS n FROM bl GROUP BY ALL) t ON t.book = dom.book
LEFT JOIN bl ON bl.book = dom.book AND bl.bucket = dom.bucket GROUP BY dom.book, dom.bucket""")
def d10(spark, d):
    return summaries.rates(bucket_docs(spark, d), "book", "bucket", BUCKETS)


@query("D11_confusion_and_agreement", """SELECT q AS actual, t AS predicted, count(doc_id) AS n, (SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0 END), 6) FROM labels) AS agreement
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(q, t) LEFT JOIN labels ON quality = q AND toxic = t GROUP BY ALL""")
def d11(spark, d):
    pairs = table(spark, d, "labels").select(F.col("quality").alias("actual"), F.col("toxic").alias("predicted"))
    cells = summaries.confusion(pairs, "actual", "predicted", (0, 1))
    agree = pairs.agg(F.round(F.avg((F.col("actual") == F.col("predicted")).cast("double")), 6))
    return cells.withColumn("agreement", agree.scalar())


@query("D12_comparison_outcome", f"""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'mixed' WHEN doc_id % 3 = 0 THEN 'historical' ELSE 'mythic' END AS manual FROM documents),
o AS (SELECT CASE WHEN bucket IS NULL THEN 'missing' WHEN manual <> 'mixed' THEN CASE WHEN manual = bucket THEN 'exact' ELSE 'disagreement' END
 WHEN bucket IN ('mythic', 'historical') THEN 'partial_mixed' ELSE 'disagreement_mixed' END AS outcome
 FROM a LEFT JOIN (SELECT doc_id, {BUCKET_SQL} AS bucket FROM labels) USING (doc_id))
SELECT outcome, count(*) AS n FROM o GROUP BY ALL""")
def d12(spark, d):
    i = F.col("doc_id")
    manual = table(spark, d, "documents").select(
        "doc_id", F.when(i % 5 == 0, "mixed").when(i % 3 == 0, "historical").otherwise("mythic").alias("manual"))
    both = manual.join(labelled(spark, d).select("doc_id", "bucket"), "doc_id", "left")
    return both.groupBy(summaries.comparison(F.col("manual"), F.col("bucket")).alias("outcome")).agg(F.count("*").alias("n"))


@query("D13_distribution_summary", """WITH f AS (SELECT l_returnflag AS label, feature, value FROM (
  SELECT l_returnflag, l_quantity AS quantity, CASE WHEN l_discount = 0.1 THEN 9999.0 ELSE l_discount END AS discount FROM lineitem)
  UNPIVOT (value FOR feature IN (quantity, discount))), g AS (SELECT * FROM f UNION ALL SELECT 'overall', feature, value FROM f)
SELECT feature, label, count(*) FILTER (WHERE value <> 9999) AS n, count(*) FILTER (WHERE value = 9999) AS missing, min(value) FILTER (WHERE value <> 9999) AS minimum,
 round(quantile_cont(value, 0.25) FILTER (WHERE value <> 9999), 6) AS q1, round(quantile_cont(value, 0.5) FILTER (WHERE value <> 9999), 6) AS median, round(avg(value) FILTER (WHERE value <> 9999), 6) AS mean,
 round(quantile_cont(value, 0.75) FILTER (WHERE value <> 9999), 6) AS q3, max(value) FILTER (WHERE value <> 9999) AS maximum FROM g GROUP BY ALL""")
def d13(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_discount") == 0.1, 9999.0).otherwise(F.col("l_discount")).alias("discount"))
    out = summaries.distributions(li, "label", ["quantity", "discount"], {"quantity": 9999.0, "discount": 9999.0})
    return out.select("feature", "label", "n", "missing", "minimum", *[r6(c).alias(c) for c in ("q1", "median", "mean", "q3")], "maximum")


@query("D14_standard_deviations", """SELECT lang, round(stddev_samp(n_chars), 6) AS sample_std, round(stddev_pop(n_chars), 6) AS population_std FROM documents GROUP BY ALL""")
def d14(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(
        r6(F.stddev_samp("n_chars")).alias("sample_std"), r6(F.stddev_pop("n_chars")).alias("population_std"))


@query("D15_floor_index_quantile", """SELECT o_orderstatus, CAST(s[CAST(floor((len(s) - 1) * 0.95) AS BIGINT) + 1] AS DOUBLE) AS threshold FROM (SELECT o_orderstatus, list_sort(list(o_totalprice)) AS s FROM orders GROUP BY ALL)""")
def d15(spark, d):
    return quantiles(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", {"threshold": 0.95}, floor_index=True)


@query("D16_collapse_duplicates", """SELECT p_name, count(*) AS rows_collapsed, min(p_partkey) AS representative, any_value(label) AS label FROM
(SELECT *, CASE WHEN p_name LIKE 'blue%' OR p_size > 2 THEN 1 ELSE 0 END AS label FROM part) GROUP BY p_name HAVING count(DISTINCT label) = 1""")
def d16(spark, d):
    p = table(spark, d, "part").select("p_name", "p_partkey", F.when(F.col("p_name").startswith("blue") | (F.col("p_size") > 2), 1).otherwise(0).alias("label"))
    kept, _ = lab.collapse(p, "p_name", "label", "p_partkey", [])
    return kept.select("p_name", F.col("group_size").alias("rows_collapsed"), F.col("p_partkey").alias("representative"), "label")


_FOLD = """r AS (SELECT user_id AS key, event_id AS ord, event_type IN ('click', 'view') AS label, event_id % 3 = 0 AS preferred FROM events),
f AS (SELECT key, arg_min(label, ord) AS label, arg_min(preferred, ord) AS preferred FROM r GROUP BY ALL),
n AS (SELECT r.key, arg_min(r.label, ord) AS label, arg_min(r.preferred, ord) AS preferred FROM r JOIN f ON f.key = r.key AND r.label <> f.label GROUP BY ALL)"""


@query("D17_conflict_fold_prefer", f"""WITH {_FOLD}
SELECT f.key, CASE WHEN f.preferred OR n.key IS NULL THEN f.label WHEN n.preferred THEN n.label END AS label FROM f LEFT JOIN n ON n.key = f.key
WHERE f.preferred OR n.key IS NULL OR n.preferred""")
def d17(spark, d):
    e = table(spark, d, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("ord"),
        F.col("event_type").isin("click", "view").alias("label"), (F.col("event_id") % 3 == 0).alias("preferred"))
    return lab.merge_records(e, "prefer").select("key", "label")


@query("D17_conflict_fold_drop", """SELECT o_custkey AS key, any_value(o_orderstatus) AS label FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1""")
def d17b(spark, d):
    e = table(spark, d, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("label"), F.lit(False).alias("preferred"))
    return lab.merge_records(e, "drop").select("key", "label")


@query("D18_usage_rollup", """WITH u AS (SELECT 'events' AS source, CAST(round(sum(value)) AS BIGINT) AS tokens, count(*) AS requests FROM events
 UNION ALL SELECT 'orders', CAST(sum(o_custkey) AS BIGINT), count(*) FROM orders UNION ALL SELECT 'documents', CAST(sum(n_chars) AS BIGINT), count(*) FROM documents)
SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(requests) AS BIGINT) AS requests FROM u GROUP BY ROLLUP (source)""")
def d18(spark, d):
    one = lambda t, name, c: table(spark, d, t).agg(F.round(F.sum(c)).cast("long").alias("tokens"), F.count("*").alias("requests")).withColumn("source", F.lit(name))
    parts = one("events", "events", "value").unionByName(one("orders", "orders", "o_custkey")).unionByName(one("documents", "documents", "n_chars"))
    return parts.rollup("source").agg(F.sum("tokens").alias("tokens"), F.sum("requests").alias("requests"))


@query("D19_corpus_and_group_rollup", f"""WITH {_BL}
SELECT book, count(*) AS n, round(100.0::DOUBLE * avg(CASE WHEN quality = toxic THEN 1 ELSE 0 END), 4) AS agree_pct FROM bl GROUP BY ROLLUP (book)""")
def d19(spark, d):
    agree = F.avg((F.col("quality") == F.col("toxic")).cast("double"))
    return bucket_docs(spark, d).rollup("book").agg(F.count("*").alias("n"), r6(100 * agree, 4).alias("agree_pct"))


@query("D20_status_tally", """SELECT o_orderpriority, string_agg(o_orderstatus || '=' || n, ', ' ORDER BY o_orderstatus) AS tally, CAST(sum(n) AS BIGINT) AS total
FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY ALL""")
def d20(spark, d):
    return summaries.tally(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus")


@query("D21_progress_and_eta", """WITH p AS (SELECT source AS task, count(quality) AS done, count(*) AS total FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL)
SELECT task, done, total, round(100.0::DOUBLE * done / total, 1) AS percent, CASE WHEN done >= total THEN 'Complete' WHEN done > 0 THEN 'In progress' ELSE 'Not started' END AS status,
 CASE WHEN done >= total THEN NULL ELSE DATE '2024-06-01' + CAST(ceil((total - done) / 7) AS INTEGER) END AS eta FROM p""")
def d21(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    tasks = j.groupBy(F.col("source").alias("task")).agg(F.count("quality").alias("done"), F.count("*").alias("total"))
    return summaries.progress(tasks, batch_size=7, today=F.lit("2024-06-01").cast("date"))


@query("D22_labeler_audit", """WITH s AS (SELECT * FROM labels ORDER BY md5('audit|' || doc_id), doc_id LIMIT 150)
SELECT quality AS baseline, toxic AS comparison, CASE WHEN quality = toxic THEN 'agree' WHEN quality > toxic THEN 'baseline_only' ELSE 'comparison_only' END AS winner, count(*) AS n FROM s GROUP BY ALL""")
def d22(spark, d):
    return lab.audit(table(spark, d, "labels"), "doc_id", "quality", "toxic", sample=150, seed="audit")


@query("D23_copresence_by_class", """SELECT quality, count(*) AS n, count(*) FILTER (WHERE f) AS formula, count(*) FILTER (WHERE t) AS term, count(*) FILTER (WHERE f AND t) AS both
FROM (SELECT quality, regexp_matches(text, '(?i)\\b(the|les?|die|los?)\\b') AS f, regexp_matches(text, '\\d{2,}') AS t FROM documents JOIN labels USING (doc_id)) GROUP BY ALL""")
def d23(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id")
    return summaries.copresence(rows, "text", "quality", r"(?i)\b(the|le[sſ]?|die|lo[sſ]?)\b", r"\d{2,}")  # ſ: RE2 folds it with s
