"""Table views shared by the registered queries, with their SQL forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.tables import table

WORD2 = tx.WORD2

# SQL forms of the views below, for use as CTEs.
LINES_SQL = """lines AS (
  SELECT doc_id, source, CAST(substr(source, 4) AS INTEGER) AS book,
         CAST(generate_subscripts(parts, 1) AS INTEGER) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents))"""
TOKENS_SQL = r"""tokens AS (
  SELECT doc_id, source, lang, CAST(generate_subscripts(toks, 1) AS INTEGER) AS pos, unnest(toks) AS term
  FROM (SELECT doc_id, source, lang,
               regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS toks FROM documents))"""
DOC_TERMS_SQL = TOKENS_SQL + """, doc_terms AS (
  SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL)"""
PART_PAIRS_SQL = """members AS (
  SELECT DISTINCT l_orderkey AS ctx, l_partkey AS node FROM lineitem),
pair_edges AS MATERIALIZED (
  SELECT a.node AS src, b.node AS dst, count(*) AS weight
  FROM members a JOIN members b ON a.ctx = b.ctx AND a.node < b.node GROUP BY ALL)"""
TYPED_SQL = """typed AS (
  SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst,
         lower(substr(o_orderpriority, 3)) AS relation,
         CAST(year(o_orderdate) AS INTEGER) AS year
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""
COORDS_SQL = """coords AS (
  SELECT s_suppkey AS place_id, s_nationkey AS parent_id,
         36.0::DOUBLE + ((s_suppkey * 7919) % 40009) / 10000.0::DOUBLE AS lat,
         20.0::DOUBLE + ((s_suppkey * 104729) % 60013) / 10000.0::DOUBLE AS lon
  FROM supplier)"""


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("book", book())


def book(col: str = "source") -> Column:
    return F.substr(F.col(col), F.lit(4)).cast("int")


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    """One row per line of a document; a narrow step."""
    return documents(spark, d).select(
        "doc_id", "source", "book", F.posexplode(F.split("text", "\n")).alias("p", "line")
    ).select("doc_id", "source", "book", (F.col("p") + 1).alias("line_no"), "line")


def doc_words(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """One row per document with its token array."""
    return documents(spark, d).select("doc_id", *extra, tx.words("text").alias("toks"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return doc_words(spark, d, "source", "lang").select(
        "doc_id", "source", "lang", F.posexplode("toks").alias("p", "term")
    ).select("doc_id", "source", "lang", (F.col("p") + 1).alias("pos"), "term")


def doc_terms(spark: SparkSession, d: str) -> DataFrame:
    """Term counts per document; combined map-side before the shuffle."""
    return tokens(spark, d).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def part_members(spark: SparkSession, d: str) -> DataFrame:
    """Order as context, part as entity (distinct)."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("ctx"), F.col("l_partkey").alias("node")
    ).distinct()


def typed_edges(spark: SparkSession, d: str) -> DataFrame:
    """Customer to supplier edges with a relation and a year."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return o.join(li, o.o_orderkey == li.l_orderkey).select(
        F.concat(F.lit("c"), "o_custkey").alias("src"),
        F.concat(F.lit("s"), "l_suppkey").alias("dst"),
        F.lower(F.substr("o_orderpriority", F.lit(3))).alias("relation"),
        F.year("o_orderdate").alias("year"),
    )


def coords(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as places with coordinates spread over a small region."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("place_id"),
        F.col("s_nationkey").alias("parent_id"),
        (F.lit(36.0) + (k * 7919 % 40009) / F.lit(10000.0)).alias("lat"),
        (F.lit(20.0) + (k * 104729 % 60013) / F.lit(10000.0)).alias("lon"),
    )


def bucket(a: Column, b: Column) -> Column:
    """Two flags to one of four buckets."""
    return (
        F.when(a & b, "both").when(a, "mythic").when(b, "historical").otherwise("other")
    )


BUCKET_SQL = """CASE WHEN quality = 1 AND toxic = 1 THEN 'both' WHEN quality = 1 THEN 'mythic'
     WHEN toxic = 1 THEN 'historical' ELSE 'other' END"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").withColumn(
        "bucket", bucket(F.col("quality") == 1, F.col("toxic") == 1)
    )


def longs(*cols: Column) -> list[Column]:
    return [c.cast("long") for c in cols]


def r6(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)
