"""Marker-delimited text: ``#1.2.3# words words #1.2.4# …``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKED = r"(?s)#(\d+\.\d+\.\d+)#\s*(.*?)(?=#\d+\.\d+\.\d+#|$)"


def marked_passages(text: Column) -> Column:
    """array<struct<passage_id, passage>> of one marked text."""
    ids = F.regexp_extract_all(text, F.lit(MARKED), F.lit(1))
    bodies = F.regexp_extract_all(text, F.lit(MARKED), F.lit(2))
    return F.zip_with(
        ids,
        bodies,
        lambda i, b: F.struct(
            i.alias("passage_id"), F.trim(F.regexp_replace(b, r"\s+", " ")).alias("passage")
        ),
    )


def read_marked_text(spark: SparkSession, path: str) -> DataFrame:
    """Passages of every file under ``path``; a file is the unit of work."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), marked_passages(F.col("value")).alias("ps")
    )
    return files.select("file", F.posexplode("ps").alias("pos", "p")).select("file", "pos", "p.*")


def id_key(passage_id: Column) -> Column:
    """Dotted id as array<int>, which compares numerically part by part."""
    return F.transform(F.split(passage_id, r"\."), lambda x: x.cast("int"))


def id_between(passage_id: Column, low: tuple[int, ...], high: tuple[int, ...]) -> Column:
    key = id_key(passage_id)
    return (key >= F.array(*[F.lit(v) for v in low])) & (key <= F.array(*[F.lit(v) for v in high]))
