"""Manifests, stopword candidates and cross-reference indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import row_numbers


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Relative path, size and sha256 of every file under a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").split("/")[-1]
    return f.select(
        F.substring_index("path", f"/{root}/", -1).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifest_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Status per path: missing, extra, stale_size, stale_hash or same."""
    l = local.select("path", F.col("size").alias("ls"), F.col("sha256").alias("lh"))
    r = remote.select("path", F.col("size").alias("rs"), F.col("sha256").alias("rh"))
    status = (
        F.when(F.col("rs").isNull(), "missing").when(F.col("ls").isNull(), "extra")
        .when(F.col("ls") != F.col("rs"), "stale_size").when(F.col("lh") != F.col("rh"), "stale_hash").otherwise("same"))
    return l.join(r, "path", "full").select("path", status.alias("status"))


def names_for_stopwords(predictors: DataFrame, names: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Predictor phrases that are names and not yet stopwords."""
    key = F.lower("phrase").alias("word")
    known = names.select(F.lower("word").alias("word")).distinct()
    return predictors.select(key).distinct().join(known, "word", "left_semi").join(stopwords.select(F.lower("word").alias("word")), "word", "left_anti")


def cross_reference(mentions: DataFrame, entity: Sequence[str], unit: str, key: Sequence[str]) -> DataFrame:
    """Numbered passages per entity in reading order, one row each: an entity
    named in very many passages never becomes one huge array."""
    distinct = mentions.select(*entity, unit, *key).distinct()
    return row_numbers(distinct, entity, [*key, unit], "position").select(*entity, "position", unit)
