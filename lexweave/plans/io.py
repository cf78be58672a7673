"""A: scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import records, sinks
from ..sources import text as marked
from ..sources.tables import scan, table
from .base import LINES_SQL, PART_PAIRS_SQL, book, part_members
from .registry import query
from ..operators import graph_iter
from ..operators.pairs import pairs_within


@query(
    "A1_marked_passages",
    f"""WITH {LINES_SQL}
SELECT doc_id, book || '.' || (doc_id % 10) || '.' || line_no AS passage_id,
       trim(regexp_replace(line, '\\s+', ' ', 'g')) AS passage FROM lines""",
)
def a1(spark, d):
    lines = F.split("text", "\n")
    mark = lambda line, i: F.concat(
        F.lit("#"), book(), F.lit("."), F.col("doc_id") % 10, F.lit("."), i + 1, F.lit("# "), line
    )
    docs = table(spark, d, "documents").select(
        "doc_id", F.array_join(F.transform(lines, mark), "\n").alias("marked")
    )
    return docs.select("doc_id", F.inline(marked.marked_passages(F.col("marked"))))


@query(
    "A2_projected_scan",
    """SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1997-01-01'""",
)
def a2(spark, d):
    where = (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp"))
    return scan(spark, d, "orders", ["o_orderkey", "o_totalprice"], where)


@query(
    "A3_archive_records",
    """SELECT 'csv' AS format, count(*) AS n_records, CAST(sum(n_nationkey) AS BIGINT) AS key_sum,
       max(n_name) AS max_name, count(*) AS max_number FROM nation
UNION ALL
SELECT 'json', count(*), CAST(sum(c_custkey) AS BIGINT), max(c_name), count(*) FROM customer""",
)
def a3(spark, d):
    root = scratch_path(spark, "archive")
    table(spark, d, "nation").coalesce(1).write.csv(f"{root}/csv", header=True)
    table(spark, d, "customer").select("c_custkey", "c_name").coalesce(1).write.json(f"{root}/json")
    csv_rows = records.read_csv_records(spark, f"{root}/csv", ["n_nationkey"], []).select(
        F.lit("csv").alias("format"), "record_number",
        F.col("record")["n_nationkey"].cast("long").alias("key"), F.col("record")["n_name"].alias("name"),
    )
    rows = records.read_jsonl(spark, f"{root}/json", "c_custkey long, c_name string")
    json_rows = rows.select(
        F.lit("json").alias("format"), F.lit(None).cast("long").alias("record_number"),
        F.col("record.c_custkey").alias("key"), F.col("record.c_name").alias("name"),
    )
    return csv_rows.unionByName(json_rows).groupBy("format").agg(
        F.count("*").alias("n_records"), F.sum("key").alias("key_sum"), F.max("name").alias("max_name"),
        F.coalesce(F.max("record_number"), F.count("*")).alias("max_number"),
    )


@query(
    "A4_csv_header_detection",
    """SELECT r.mode, c_custkey AS id, c_name AS name
FROM customer CROSS JOIN (VALUES ('header'), ('fallback')) r(mode)""",
)
def a4(spark, d):
    root = scratch_path(spark, "headers")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    c.write.csv(f"{root}/h", header=True)
    c.write.csv(f"{root}/n", header=False)
    parts = [
        records.read_csv_records(spark, f"{root}/{sub}", ["id", "object id"], ["id", "name"]).select(
            F.lit(mode).alias("mode"), F.col("record")["id"].cast("long").alias("id"),
            F.col("record")["name"].alias("name"),
        )
        for sub, mode in (("h", "header"), ("n", "fallback"))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "A5_json_records",
    """SELECT event_id, 0 AS pos, NULL AS json_key, props->>'k' AS k, NULL AS value FROM events WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 1, NULL, NULL, CAST(event_id AS VARCHAR) FROM events WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 0, 'a', props->>'k', NULL FROM events WHERE event_id % 4 = 1
UNION ALL SELECT event_id, 1, 'b', props->>'k', NULL FROM events WHERE event_id % 4 = 1
UNION ALL SELECT event_id, 0, NULL, props->>'k', NULL FROM events WHERE event_id % 4 = 2
UNION ALL SELECT event_id, 0, NULL, NULL, CAST(event_id AS VARCHAR) FROM events WHERE event_id % 4 = 3""",
)
def a5(spark, d):
    p, e = F.col("props"), F.col("event_id").cast("string")
    doc = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("["), p, F.lit(","), e, F.lit("]")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"a":'), p, F.lit(',"b":'), p, F.lit("}")))
        .when(F.col("event_id") % 4 == 2, p)
        .otherwise(e)
    )
    rows = table(spark, d, "events").select(
        "event_id", F.posexplode(records.json_records(doc)).alias("pos", "r")
    )
    return rows.select(
        "event_id", "pos", F.col("r")["_json_key"].alias("json_key"), F.col("r")["k"].alias("k"),
        F.col("r")["value"].alias("value"),
    )


@query(
    "A6_gzip_csv_required_columns",
    """SELECT s_suppkey AS place_id, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END AS lat FROM supplier""",
)
def a6(spark, d):
    path = scratch_path(spark, "gz")
    table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("place_id"),
        F.when(F.col("s_suppkey") % 7 == 0, "n/a").otherwise(F.col("s_acctbal").cast("string")).alias("lat"),
    ).write.option("compression", "gzip").csv(path, header=True)
    df = records.read_csv_required(spark, path, ["place_id", "lat"])
    return df.select(
        records.tolerant_number(F.col("place_id"), "long").alias("place_id"),
        records.tolerant_number(F.col("lat")).alias("lat"),
    )


@query(
    "A7_manual_label_import",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE quality = 1 END AS flag,
       CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id END AS number,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id / 4.0::DOUBLE END AS score FROM labels""",
)
def a7(spark, d):
    path = scratch_path(spark, "manual")
    i, q = F.col("doc_id"), F.col("quality") == 1
    table(spark, d, "labels").select(
        i,
        F.when(i % 4 == 3, "maybe").when(i % 4 == 0, F.when(q, " Yes").otherwise("NO ")).when(
            i % 4 == 1, F.when(q, "TRUE").otherwise("false")).otherwise(F.when(q, "1").otherwise("0")).alias("flag"),
        F.when(i % 5 == 0, "x").otherwise(F.concat(F.lit(" "), i)).alias("number"),
        F.when(i % 3 == 0, "").otherwise((i / 4.0).cast("string")).alias("score"),
    ).write.csv(path, header=True)
    df = records.read_csv_required(spark, path, ["doc_id", "flag", "number", "score"])
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        records.tolerant_bool(F.col("flag")).alias("flag"),
        records.tolerant_number(F.col("number"), "long").alias("number"),
        records.tolerant_number(F.col("score")).alias("score"),
    )


@query(
    "A8_review_tsv_counts",
    "SELECT p_name AS preferred, p_type AS variant, count(*) AS n FROM part GROUP BY ALL",
)
def a8(spark, d):
    path = scratch_path(spark, "review")
    counts = table(spark, d, "part").groupBy("p_name", "p_type").agg(F.count("*").alias("n"))
    cell = F.concat("p_type", F.lit(" ("), "n", F.lit(")"))
    counts.groupBy("p_name").agg(F.array_join(F.sort_array(F.collect_list(cell)), "; ").alias("variants")).select(
        F.col("p_name").alias("preferred"), "variants"
    ).write.option("sep", "\t").csv(path, header=True)
    df = spark.read.csv(path, header=True, sep="\t")
    return df.select("preferred", F.inline(records.variant_counts(F.col("variants"))))


@query(
    "A9_jsonl_results",
    """SELECT event_id, event_id % 50 = 0 AS bad, CASE WHEN event_id % 50 = 0 THEN NULL ELSE user_id END AS user_id
FROM events""",
)
def a9(spark, d):
    path = scratch_path(spark, "jsonl")
    good = F.to_json(F.struct("event_id", "user_id"))
    table(spark, d, "events").select(
        F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("oops "), "event_id")).otherwise(good).alias("value")
    ).write.text(path)
    rows = records.read_jsonl(spark, path, "event_id long, user_id long")
    bad = F.col("record.event_id").isNull()
    return rows.select(
        F.coalesce("record.event_id", F.regexp_extract("value", r"(\d+)$", 1).cast("long")).alias("event_id"),
        bad.alias("bad"),
        F.col("record.user_id").alias("user_id"),
    )


@query(
    "A10_copy_query_to_csv",
    "SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY ALL",
)
def a10(spark, d):
    path = scratch_path(spark, "copy")
    out = table(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("first_key")
    )
    sinks.write_csv(out, path)
    return spark.read.schema(out.schema).csv(path, header=True)


@query("A11_csv_sink", "SELECT doc_id, lang, source, n_chars FROM documents")
def a11(spark, d):
    path = scratch_path(spark, "inventory")
    out = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    sinks.write_csv(out, path)
    return spark.read.schema(out.schema).csv(path, header=True, escape='"')


#: smallest names, carried over edges until they stay (the graph's diameter is below eight)
_NAMED = ", ".join(
    ["n0 AS MATERIALIZED (SELECT DISTINCT node, node AS c FROM members)", "l AS MATERIALIZED (SELECT src AS node, dst AS nbr FROM pair_edges UNION ALL SELECT dst, src FROM pair_edges)"]
    + [f"n{i + 1} AS MATERIALIZED (SELECT node, min(c) AS c FROM (FROM n{i} UNION ALL SELECT l.node, c FROM l JOIN n{i} ON n{i}.node = l.nbr) GROUP BY node)" for i in range(8)])


@query(
    "A12_graph_json_sink",
    f"""WITH {PART_PAIRS_SQL}, {_NAMED}
SELECT 'link' AS kind, src AS id, dst AS target, weight FROM pair_edges
UNION ALL SELECT 'node', node, NULL, count(*) FROM members GROUP BY node
UNION ALL SELECT 'component', c, NULL, count(*) FROM n8 GROUP BY c""",
)
def a12(spark, d):
    path = scratch_path(spark, "graph")
    m = part_members(spark, d)
    links = pairs_within(m, ["ctx"], "node").groupBy(
        F.col("node_a").alias("source"), F.col("node_b").alias("target")).agg(F.count("*").alias("weight"))
    nodes = m.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("contexts"))
    # the third file: every component with its number of nodes
    found = graph_iter.components(links.select(F.col("source").alias("src"), F.col("target").alias("dst")), nodes.select(F.col("id").alias("node")))
    parts = found.groupBy("component").agg(F.count("*").alias("nodes"))
    sinks.write_graph_json(nodes, links, parts, path)
    c = spark.read.schema(parts.schema).json(f"{path}/components").select(
        F.lit("component").alias("kind"), F.col("component").alias("id"), F.lit(None).cast("long").alias("target"), F.col("nodes").alias("weight"))
    n = spark.read.schema(nodes.schema).json(f"{path}/nodes").select(
        F.lit("node").alias("kind"), "id", F.lit(None).cast("long").alias("target"), F.col("contexts").alias("weight"))
    e = spark.read.schema(links.schema).json(f"{path}/links").select(
        F.lit("link").alias("kind"), F.col("source").alias("id"), "target", "weight")
    return n.unionByName(e).unionByName(c)


@query(
    "A13_upsert_last_wins",
    """SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""",
)
def a13(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    old, new = e.where(F.col("event_id") % 2 == 0), e.where(F.col("event_id") % 2 == 1)
    return sinks.upsert(old, new, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(
    "A14_upsert_keep_old_values",
    """SELECT user_id, max(event_id) AS event_id,
  arg_max(event_type, event_id) FILTER (WHERE event_id % 3 <> 0) AS event_type,
  arg_max(value, event_id) FILTER (WHERE event_id % 2 = 0) AS value
FROM events GROUP BY user_id""",
)
def a14(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select(
        "user_id", i, F.when(i % 3 != 0, F.col("event_type")).alias("event_type"),
        F.when(i % 2 == 0, F.col("value")).alias("value"),
    )
    return sinks.upsert_keep(e.where(i % 2 == 0), e.where(i % 2 == 1), ["user_id"], "event_id")


@query(
    "A15_insert_if_absent",
    """SELECT p_name AS name, 'old' AS origin FROM part WHERE p_size < 25 GROUP BY ALL
UNION ALL SELECT p_name, 'new' FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size < 25) GROUP BY ALL
UNION ALL SELECT p_brand, 'new' FROM part WHERE p_brand NOT IN (SELECT p_name FROM part WHERE p_size < 25) GROUP BY ALL""",
)
def a15(spark, d):
    p = table(spark, d, "part")
    old = p.where("p_size < 25").select(F.col("p_name").alias("name"), F.lit("old").alias("origin")).distinct()
    new = p.select(F.col("p_name").alias("name")).union(p.select("p_brand")).withColumn("origin", F.lit("new"))
    return sinks.insert_absent(old, new, ["name"])


@query(
    "A16_replace_scope",
    """SELECT source, doc_id, CASE WHEN lang = 'en' THEN n_chars ELSE -n_chars END AS n FROM documents
WHERE lang = 'en' OR source IN (SELECT source FROM documents) """,
)
def a16(spark, d):
    path = scratch_path(spark, "scoped")
    docs = table(spark, d, "documents").select("lang", "source", "doc_id", F.col("n_chars").alias("n"))
    sinks.replace_scope(docs, path, ["lang"])
    sinks.replace_scope(docs.where("lang <> 'en'").withColumn("n", -F.col("n")), path, ["lang"])
    return spark.read.parquet(path).select("source", "doc_id", "n")


@query(
    "A16_replace_keeping_reviewed",
    """SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN 'kept' ELSE 'new' END AS state FROM supplier""",
)
def a16b(spark, d):
    s = table(spark, d, "supplier")
    old = s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") < 0, "kept").otherwise("old").alias("state"))
    new = s.select(F.col("s_suppkey").alias("id"), F.lit("new").alias("state"))
    return sinks.replace_unreviewed(old, new, ["id"], F.col("state") == "kept")


@query(
    "A17_update_from_values",
    """SELECT o_orderkey, CASE WHEN n IS NULL THEN o_orderstatus ELSE 'X' END AS o_orderstatus
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
ON l_orderkey = o_orderkey""",
)
def a17(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    values = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("o_orderstatus", F.lit("X"))
    return sinks.update_from(old, values, ["o_orderkey"])


@query(
    "A18_canonical_entities",
    """WITH a AS (SELECT c_nationkey AS key, max(c_name) AS name FROM customer GROUP BY ALL),
 b AS (SELECT s_nationkey AS key, max(s_name) AS name, max(s_acctbal) AS balance FROM supplier GROUP BY ALL)
SELECT coalesce(a.key, b.key) AS key, coalesce(a.name, b.name) AS name, b.balance FROM a FULL JOIN b ON a.key = b.key""",
)
def a18(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(
        F.max("c_name").alias("name")).withColumn("rank", F.lit(1))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(
        F.max("s_name").alias("name"), F.max("s_acctbal").alias("balance")).withColumn("rank", F.lit(2))
    return sinks.canonical_entities([a, b], ["key"], "rank")
