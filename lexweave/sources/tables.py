"""Reading tables with projection and predicate, and loose-record columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan(
    spark: SparkSession, folder: str, name: str, columns: Sequence[str], where: Column | None = None
) -> DataFrame:
    """Projection and predicate; both reach the Parquet scan."""
    df = table(spark, folder, name)
    if where is not None:
        df = df.where(where)
    return df.select(*columns)


def normal_name(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch.isascii() and ch.isalnum())


def resolve(df: DataFrame, candidates: Sequence[str]) -> Column:
    """First non-blank value among the columns whose normalised name matches.

    Columns are matched while planning, so the job itself only sees a
    ``coalesce`` over the few matching columns.
    """
    wanted = {normal_name(c) for c in candidates}
    found = [c for c in df.columns if normal_name(c) in wanted]
    blanks = [
        F.nullif(
            F.trim(F.regexp_replace(F.col(f"`{c}`").cast("string"), r"\s+", " ")), F.lit("")
        )
        for c in found
    ]
    return F.coalesce(*blanks, F.lit("")) if blanks else F.lit("")
