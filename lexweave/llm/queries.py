"""The named queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automata, bpe, chat, contain, cotrain, crosspoly, feistel, forest, lattice, lexical, lineruns, mixing, repair

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


LITERAL = "\\### Assistant: </turn> ok"  # a text made of the template's own control strings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_lattice_likelihood")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), file, public_tokenizers.PATTERN, packed=True)
    return bpe.decode(encoded, file).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_chat_windows")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(LITERAL).alias("text"))
    return chat.read_back(chat.windows(turns.unionByName(tricky)))


@query("op10_line_runs")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineruns.decide(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("kept_sha256"))


@query("op4_feistel_pseudonyms")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="a key of the data's owner").select("doc_id", "text", F.size("kinds").cast("long").alias("n_replaced"))


@query("op3_cross_polytope")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspoly.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    "op5_containment_search",
    f"""
    WITH i AS (SELECT item_id, w, least(5, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
    b AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM i)),
    d AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s
          FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM (SELECT doc_id, {_WORDS} AS w FROM documents), (SELECT DISTINCT k FROM i))),
    n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id)
    SELECT doc_id, item_id, item_shingles, count(*) AS matched, count(*) / item_shingles AS containment
    FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, item_shingles HAVING count(*) >= 0.8 * item_shingles
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contain.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("dk")


@query("op9_jaccard_forest")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.join(table(spark, sf_dir, "documents")).drop("dk")


@query(
    "op8_suffix_automata",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
    f AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
    dead AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM win JOIN f USING (h) WHERE doc_id > m),
    word AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
    kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS k, count(*) AS n FROM word ANTI JOIN dead USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automata.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_cotraining")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = cotrain.fit(docs, table(spark, sf_dir, "labels"))
    return cotrain.score(docs, model).select("doc_id", "text_score", "page_score", "quality_score", "keep")


@query(
    "op13_source_schedule",
    r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
               'mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) AS key FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source),
    w AS (SELECT *, 2 * source_size AS cap, [3, 1, 2][(no - 1) % 3 + 1] AS weight FROM s),
    r AS (SELECT *, cap / weight AS ratio, sum(cap) OVER o - cap AS caps, sum(weight) OVER o - weight AS weights FROM w WINDOW o AS (ORDER BY cap / weight, no)),
    l AS (SELECT *, ((SELECT 1.5::DOUBLE * sum(source_size) FROM s) - CAST(caps AS DOUBLE)) / CAST((SELECT sum(weight) FROM w) - weights AS DOUBLE) AS level FROM r),
    t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * (SELECT arg_min(level, (ratio, no)) FROM l WHERE level <= ratio)) AS target FROM l),
    laid AS (SELECT doc_id, size, source_size, target, key, CAST(floor(target + 0.5) AS BIGINT) AS words, pass, pass * source_size
             + sum(size) OVER (PARTITION BY d.source, pass ORDER BY md5(pass || '|' || key) ROWS UNBOUNDED PRECEDING) - size AS start
             FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, unnest([0, 1]) AS p(pass))
    SELECT doc_id, size, source_size, target, CAST(sum(greatest(0, least(size, words - start))) AS BIGINT) AS taken
    FROM laid GROUP BY doc_id, key, size, source_size, target
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


_TERMS = """
    SELECT {key}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM {table}"""


@query(
    "op12_blocked_search",
    f"""
    WITH d AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM ({_TERMS.format(key='doc_id', table='documents')}) WHERE len(w) > 0),
    c AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM d),
    q AS (SELECT DISTINCT item_id, unnest(w) AS t FROM ({_TERMS.format(key='item_id', table='benchmark')})),
    p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM d) SEMI JOIN q USING (t) GROUP BY ALL),
    f AS (SELECT t, CAST(floor(1000 * ln((2 * (SELECT nd FROM c) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY t),
    s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l)))) AS BIGINT) AS score
          FROM p JOIN f USING (t) JOIN q USING (t), c GROUP BY item_id, doc_id),
    r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT * FROM r WHERE rank <= 50
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def damaged(rows: DataFrame) -> DataFrame:
    """Faults in conversations, by crc32 of conv_id:turn; nulls become one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hurt = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    text = F.when(F.col("_hurt") == 1, "").when(F.col("_hurt") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    given = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), hurt.alias("_hurt"), F.explode(F.array_repeat(F.lit(0), F.when(hurt == 3, 2).otherwise(1))).alias("_copy"))
    return given.where("_hurt <> 0").select("conv_id", "turn", F.when(F.col("_hurt") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


@query("op11_branch_bound_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    made = repair.repair(damaged(rows))
    digest = repair.digests(made.turns)
    same = lambda right: F.col("conv_id").eqNullSafe(right)
    every = rows.select("conv_id").distinct().join(made.summary.withColumnRenamed("conv_id", "_s"), same(F.col("_s")), "left").join(digest.withColumnRenamed("conv_id", "_d"), same(F.col("_d")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
