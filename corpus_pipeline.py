"""A corpus from raw documents to token ids, in five stages.

Each stage reads what its predecessor wrote: documents that the quality
classifier rejects go; later copies of repeated line runs are cut out, and
documents of which nothing is left go; one document of each near-duplicate group
stays; documents that hold a benchmark item go; the rest is encoded, and decoded
again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import bpe, contain, cotrain, forest, lineruns
from lexweave.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = cotrain.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotrain.score(docs, model).where("keep").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text; a document whose lines all go, goes."""
    cut = lineruns.decide(docs).where("n_deleted = 0 or text != ''")
    return cut.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return forest.one_per_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contain.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): text is what the ids decode to."""
    file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(docs, file, public_tokenizers.PATTERN)
    return bpe.decode(encoded, file).select("doc_id", "n_tokens", "ids", F.col("decoded").cast("string").alias("text"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("tokens", tokens),
]
#: no SQL for a fitted classifier and a tokenizer; tests hold run() against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        at = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
