"""E: ranking, running sums, chunks and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunks as ch
from ..operators import stats, summaries
from ..operators.scan import average_ranks, md5_key, ordered_scan, top_per_group
from ..sources.tables import table
from ..sources.text import id_between
from .base import LINES_SQL, TYPED_SQL, doc_lines, r6, typed_edges
from .registry import query

SIZE, STEP = 2000, 700


def sentences(spark, d):
    """Lines with at least one token, in reading order within a source."""
    pid = F.concat_ws(".", F.col("book"), F.col("doc_id"), F.col("line_no"))
    rows = doc_lines(spark, d).select(
        "source", "book", "doc_id", "line_no", pid.alias("passage_id"), tx.count_words("line").cast("long").alias("tokens"))
    return rows.where("tokens > 0")


_SENT = LINES_SQL + r""", sent AS (SELECT source, book, doc_id, line_no, book || '.' || doc_id || '.' || line_no AS passage_id,
  CAST(len(regexp_extract_all(line, '[\p{L}\p{N}_]+')) AS BIGINT) AS tokens FROM lines),
cums AS (SELECT *, CAST(sum(tokens) OVER w AS BIGINT) AS cum, row_number() OVER w AS idx FROM sent WHERE tokens > 0
  WINDOW w AS (PARTITION BY source ORDER BY doc_id, line_no ROWS UNBOUNDED PRECEDING))"""


@query("E1_latest_per_key", """SELECT user_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def e1(spark, d):
    e = table(spark, d, "events")
    best = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("r"))
    return best.select("user_id", "r.ts", "r.event_type", "r.value")


@query("E2_latest_release", """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus IN ('F', 'O') ORDER BY coalesce(o_orderdate, TIMESTAMP '1900-01-01') DESC, o_orderkey DESC LIMIT 1""")
def e2(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_orderdate")
    return o.orderBy(F.coalesce("o_orderdate", F.lit("1900-01-01").cast("timestamp")).desc(), F.desc("o_orderkey")).limit(1)


@query("E3_preferred_or_most_common", """SELECT p_brand, p_type, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand
 ORDER BY CASE WHEN p_type = 'ECONOMY' AND p_brand LIKE '%1' THEN 0 ELSE 1 END, n DESC, p_type) AS rn FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)) WHERE rn = 1""")
def e3(spark, d):
    c = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    preferred = F.when((F.col("p_type") == "ECONOMY") & F.col("p_brand").like("%1"), 0).otherwise(1)
    best = c.groupBy("p_brand").agg(F.min_by(F.struct("p_type", "n"), F.struct(preferred, -F.col("n"), F.col("p_type"))).alias("r"))
    return best.select("p_brand", "r.*")


@query("E4_top_k_per_group", """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rn FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 5""")
def e4(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    top = top_per_group(li, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], 5)
    return top.drop("l_partkey").withColumn("rn", F.col("rn").cast("long"))


@query("E5_top_n_over_measures", """WITH m AS (SELECT l_suppkey, measure, value FROM (SELECT l_suppkey, CAST(count(*) AS DOUBLE) AS n_lines, round(sum(l_quantity), 4) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY ALL)
 UNPIVOT (value FOR measure IN (n_lines, quantity, discount)))
SELECT measure, l_suppkey, value, rn FROM (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY value DESC, l_suppkey) AS rn FROM m) WHERE rn <= 10""")
def e5(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").cast("double").alias("n_lines"), F.round(F.sum("l_quantity"), 4).alias("quantity"), r6(F.avg("l_discount")).alias("discount"))
    long = m.unpivot(["l_suppkey"], ["n_lines", "quantity", "discount"], "measure", "value")
    return top_per_group(long, ["measure"], [F.desc("value"), F.asc("l_suppkey")], 10).withColumn("rn", F.col("rn").cast("long"))


@query("E6_head_and_tail", """WITH c AS (SELECT s_suppkey, s_acctbal FROM supplier)
SELECT * FROM (SELECT 'head' AS side, s_suppkey, s_acctbal FROM c ORDER BY s_acctbal DESC, s_suppkey LIMIT 8) UNION ALL
SELECT * FROM (SELECT 'tail' AS side, s_suppkey, s_acctbal FROM c ORDER BY s_acctbal, s_suppkey LIMIT 8)""")
def e6(spark, d):
    c = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    head = c.orderBy(F.desc("s_acctbal"), "s_suppkey").limit(8).withColumn("side", F.lit("head"))
    tail = c.orderBy("s_acctbal", "s_suppkey").limit(8).withColumn("side", F.lit("tail"))
    return head.unionByName(tail)


@query("E7_hash_sample", """SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS sample_rank FROM (SELECT doc_id, md5('seed-1|' || doc_id) AS h FROM documents) ORDER BY h, doc_id LIMIT 200""")
def e7(spark, d):
    from pyspark.sql import Window

    picked = table(spark, d, "documents").select("doc_id", md5_key("doc_id", seed="seed-1").alias("h")).orderBy("h", "doc_id").limit(200)
    return picked.select("doc_id", F.row_number().over(Window.orderBy("h", "doc_id")).cast("long").alias("sample_rank"))


@query("E8_running_tokens", f"WITH {_SENT} SELECT source, doc_id, line_no, cum FROM cums")
def e8(spark, d):
    return ordered_scan(sentences(spark, d), ["source"], ["doc_id", "line_no"], {"cum": ("sum", "tokens")}).select("source", "doc_id", "line_no", "cum")


_CHUNKS = f"""WITH RECURSIVE {_SENT}, cuts(source, c) AS (SELECT DISTINCT source, CAST(0 AS BIGINT) FROM cums UNION ALL
 SELECT * FROM (SELECT r.source, (SELECT min(x.cum) FROM cums x WHERE x.source = r.source AND x.cum >= r.c + {SIZE}) AS c FROM cuts r) WHERE c IS NOT NULL),
placed AS (SELECT cums.*, (SELECT max(c) FROM cuts WHERE cuts.source = cums.source AND cuts.c < cums.cum) AS s FROM cums),
sizes AS (SELECT source, s, sum(tokens) AS n, lag(s) OVER (PARTITION BY source ORDER BY s) AS prev, lead(s) OVER (PARTITION BY source ORDER BY s) AS nxt FROM placed GROUP BY source, s),
chunked AS (SELECT placed.*, CASE WHEN n < {SIZE // 2} AND nxt IS NULL AND prev IS NOT NULL THEN prev ELSE placed.s END AS chunk_start FROM placed JOIN sizes ON sizes.source = placed.source AND sizes.s = placed.s)"""


@query("E9_greedy_chunks", _CHUNKS + " SELECT source, doc_id, line_no, chunk_start FROM chunked")
def e9(spark, d):
    return ch.greedy_chunks(sentences(spark, d), "source", ["doc_id", "line_no"], SIZE).select("source", "doc_id", "line_no", "chunk_start")


@query("E10_rolling_windows", f"""WITH RECURSIVE {_SENT}, starts(source, idx, next_start, is_start) AS (
 SELECT source, idx, CAST({STEP} AS BIGINT), true FROM cums WHERE idx = 1 UNION ALL
 SELECT c.source, c.idx, CASE WHEN c.cum - c.tokens >= s.next_start THEN s.next_start + {STEP} ELSE s.next_start END, c.cum - c.tokens >= s.next_start
 FROM starts s JOIN cums c ON c.source = s.source AND c.idx = s.idx + 1),
w AS (SELECT c.source, c.idx AS start_idx, c.cum - c.tokens AS b, (SELECT min(x.cum) FROM cums x WHERE x.source = c.source AND x.cum >= c.cum - c.tokens + {SIZE}) AS e
 FROM starts s JOIN cums c ON c.source = s.source AND c.idx = s.idx WHERE s.is_start)
SELECT w.source, start_idx, x.idx AS end_idx, e - b AS token_count, x.idx - start_idx + 1 AS sentence_count FROM w JOIN cums x ON x.source = w.source AND x.cum = w.e""")
def e10(spark, d):
    return ch.rolling_windows(sentences(spark, d), "source", ["doc_id", "line_no"], SIZE, STEP)


@query("E11_chunk_inventory", _CHUNKS + """, f AS (SELECT *, (book, doc_id, line_no) >= (4, 100, 1) AND (book, doc_id, line_no) <= (12, 600, 9) AS in_span FROM chunked)
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY chunk_start) - 1 AS INTEGER) AS chunk_index, arg_min(passage_id, cum) AS first_unit, arg_max(passage_id, cum) AS last_unit, CAST(sum(tokens) AS BIGINT) AS token_count, count(*) AS sentence_count,
 round(sum(CASE WHEN in_span THEN tokens ELSE 0 END) / sum(tokens), 6) AS overlap, sum(CASE WHEN in_span THEN tokens ELSE 0 END) BETWEEN 1 AND sum(tokens) - 1 AS boundary, bool_or(book = 4) AS is_book4
FROM f GROUP BY source, chunk_start""")
def e11(spark, d):
    s = sentences(spark, d).withColumn("in_span", id_between(F.col("passage_id"), (4, 100, 1), (12, 600, 9)))
    placed = ch.greedy_chunks(s, "source", ["doc_id", "line_no"], SIZE)
    inv = ch.chunk_inventory(placed, "source", "passage_id", {"is_book4": F.col("book") == 4}, "in_span")
    return inv.drop("chunk_start").withColumn("overlap", r6("overlap"))


def _drift_sql(items: str) -> str:
    return f"""SELECT b.year, b.size, round(CASE WHEN p.year IS NOT NULL THEN coalesce(s.shared, 0) / (b.size + p.size - coalesce(s.shared, 0)) END, 6) AS jaccard_previous
FROM n b LEFT JOIN n p ON p.year = (SELECT max(year) FROM n z WHERE z.year < b.year) LEFT JOIN
(SELECT x.year, y.year AS py, count(*) AS shared FROM m x JOIN m y ON {items} AND y.year < x.year GROUP BY ALL) s ON s.year = b.year AND s.py = p.year"""


@query("E12_node_drift", f"""WITH {TYPED_SQL}, m AS (SELECT DISTINCT year, src AS node FROM typed UNION SELECT DISTINCT year, dst FROM typed), n AS (SELECT year, count(*) AS size FROM m GROUP BY ALL)
{_drift_sql('x.node = y.node')}""")
def e12(spark, d):
    e = typed_edges(spark, d)
    nodes = e.select("year", F.col("src").alias("node")).union(e.select("year", "dst"))
    return summaries.drift(nodes, "year", ["node"]).withColumn("jaccard_previous", r6("jaccard_previous"))


@query("E12_edge_drift", f"""WITH {TYPED_SQL}, m AS (SELECT DISTINCT year, src, dst FROM typed), n AS (SELECT year, count(*) AS size FROM m GROUP BY ALL)
{_drift_sql('x.src = y.src AND x.dst = y.dst')}""")
def e12b(spark, d):
    return summaries.drift(typed_edges(spark, d), "year", ["src", "dst"]).withColumn("jaccard_previous", r6("jaccard_previous"))


@query("E13_claim_numbers", """SELECT conv_id, turn, CAST(i AS INTEGER) AS claim_index, parts[i] AS claim FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM conversations)""")
def e13(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("p", "claim"))
    return c.select("conv_id", "turn", (F.col("p") + 1).alias("claim_index"), "claim")


@query("E14_average_ranks", """SELECT doc_id, lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS rank FROM documents""")
def e14(spark, d):
    return average_ranks(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), ["lang"], "n_chars").select("doc_id", "lang", "rank")


_P = "p AS (SELECT p_partkey AS id, ((p_partkey * 7919) % 1009) / 1009.0::DOUBLE AS p FROM part)"


def _p(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), (k * 7919 % 1009 / F.lit(1009.0)).alias("p"))


@query("E15_benjamini_hochberg", f"""WITH {_P}, r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS i, count(*) OVER () AS n FROM p)
SELECT id, round(least(1.0, min(p * n / i) OVER (ORDER BY p DESC, id DESC ROWS UNBOUNDED PRECEDING)), 9) AS q_value FROM r""")
def e15(spark, d):
    return stats.benjamini_hochberg(_p(spark, d), "p").select("id", r6("q_value", 9).alias("q_value"))


@query("E15_holm", f"""WITH {_P}, r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS i, count(*) OVER () AS n FROM p)
SELECT id, round(max(least(1.0, p * (n - i + 1))) OVER (ORDER BY p, id ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM r""")
def e15b(spark, d):
    return stats.holm(_p(spark, d), "p").select("id", r6("p_holm", 9).alias("p_holm"))
