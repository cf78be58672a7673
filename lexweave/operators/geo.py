"""Distance joins on a latitude/longitude grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import EARTH_KM, UNKNOWN_KM, haversine
from ..session import cut
from .pairs import pairs_between


def _cells(band: Column, step: float) -> Column:
    """Number of longitude cells in a latitude band, each at least ``step`` wide on the ground."""
    edge = F.greatest(F.abs(band * step), F.abs((band + 1) * step))
    width = F.cos(F.radians(F.least(edge, F.lit(90.0))))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) * width / step).cast("int"))


def within_radius(left: DataFrame, right: DataFrame, id_col: str, km: float) -> DataFrame:
    """Pairs (id_a, id_b, km) closer than ``km``; the point itself is left out.

    Both sides meet on (latitude band, longitude cell), so only neighbouring
    cells are compared, and a dense cell in blocks.  Identical coordinates are compared once: the distance
    is worked out between distinct points and ids are attached afterwards.
    """
    step = math.degrees(km / EARTH_KM) * 1.0000001
    reach = F.lit(math.sin(min(km / EARTH_KM, math.pi / 2)))

    def distinct_points(df: DataFrame) -> DataFrame:
        return df.select("lat", "lon").distinct()

    band = F.floor(F.col("lat") / step).cast("int")
    n = _cells(F.col("band"), step)
    pos = lambda lon: (lon + 180.0) / 360.0
    r = distinct_points(right).withColumn("band", band).withColumn("n", n).select(
        "band",
        F.pmod(F.floor(pos(F.col("lon")) * F.col("n")), F.col("n")).alias("cell"),
        F.col("lat").alias("lat_b"),
        F.col("lon").alias("lon_b"),
    )
    ratio = reach / F.cos(F.radians("lat"))
    spread = F.when(ratio < 1, F.degrees(F.asin(ratio))).otherwise(F.lit(180.0))
    q = (
        distinct_points(left)
        .withColumn("band", F.explode(F.sequence(band - 1, band + 1)))
        .withColumn("n", n)
        .withColumn("spread", spread)
        .withColumn("lo", F.floor(pos(F.col("lon") - F.col("spread")) * F.col("n")))
        .withColumn("hi", F.floor(pos(F.col("lon") + F.col("spread")) * F.col("n")))
        .withColumn("hi", F.least(F.col("hi"), F.col("lo") + F.col("n") - 1))
        .withColumn("cell", F.explode(F.sequence("lo", "hi")))
        .select("band", F.pmod("cell", "n").alias("cell"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    )
    d = haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    near = pairs_between(q, r, ["band", "cell"]).withColumn("km", d).where(F.col("km") <= km).drop("band", "cell")
    a = left.select(F.col(id_col).alias("id_a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    b = right.select(F.col(id_col).alias("id_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    return (
        near.join(a, ["lat_a", "lon_a"])
        .join(b, ["lat_b", "lon_b"])
        .where(F.col("id_a") != F.col("id_b"))
        .select("id_a", "id_b", "km")
    )


def nearest(
    points: DataFrame, candidates: DataFrame, id_col: str, start_km: float = 25.0
) -> DataFrame:
    """Exact distance to the nearest other candidate, or the unknown-distance sentinel.

    Rings widen fourfold; each round only looks at points still without a
    neighbour, so dense areas finish in the first round.
    """
    radius, pending, found = start_km, points, None
    half = math.pi * EARTH_KM
    while True:
        hits = cut(
            within_radius(pending, candidates, id_col, radius)
            .groupBy(F.col("id_a").alias(id_col))
            .agg(F.min("km").alias("km"))
        )
        found = hits if found is None else found.unionByName(hits)
        if radius >= half:
            break
        pending = cut(pending.join(hits, id_col, "left_anti"))
        if pending.isEmpty():
            break
        radius = min(radius * 4, half)
    return points.select(id_col).join(found, id_col, "left").fillna({"km": UNKNOWN_KM})
