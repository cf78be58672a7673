"""Linking names across sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from .scan import top_per_group

METHODS = ("authority_id", "exact_normalized_name", "transliteration")


def mentions_in_lines(forms: DataFrame, lines: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Lines of the same unit that contain a mention form."""
    return forms.join(lines, list(unit)).where(F.contains("line", F.col("form")))


def fallback_join(
    rows: DataFrame, row_key: Sequence[str], keys: str, lookup: DataFrame, lookup_key: str, value: str
) -> DataFrame:
    """First matching key of an ordered key list decides the value."""
    wanted = rows.select(*row_key, F.posexplode(keys).alias("_p", lookup_key))
    return wanted.join(lookup, lookup_key).groupBy(*row_key).agg(F.min_by(value, "_p").alias(value))


def place_keys(df: DataFrame, key: str, forms: Sequence[str]) -> DataFrame:
    """(key, kind, token) rows: every exact and transliteration key of a place."""
    variants = F.array_distinct(
        F.concat(*[names.name_variants(F.col(f), parenthetical_content=True) for f in forms])
    )
    return _explode_keys(df.select(key, variants.alias("v")), key)


def entity_keys(df: DataFrame, key: str, label: str) -> DataFrame:
    v = names.name_variants(F.col(label), location_container=False, generic_head=False)
    return _explode_keys(df.select(key, v.alias("v")), key)


def _explode_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(
        key,
        F.inline(
            F.concat(
                F.transform("v", lambda x: F.struct(F.lit(METHODS[1]).alias("kind"), x.alias("token"))),
                F.transform(
                    names.transliteration_keys(F.col("v")),
                    lambda x: F.struct(F.lit(METHODS[2]).alias("kind"), x.alias("token")),
                ),
            )
        ),
    )


def link_places(places: DataFrame, entities: DataFrame) -> DataFrame:
    """Links between places (place_id, form, authority_id) and entities
    (entity_id, label, authority_id): shared authority id, else any shared name
    variant, else any shared transliteration key.

    Three equi-joins on exploded keys replace the comparison of every place
    with every entity; the best method per pair is kept.
    """
    by_id = places.where("authority_id <> ''").select("place_id", "authority_id").join(
        entities.select("entity_id", "authority_id"), "authority_id"
    ).select("place_id", "entity_id", F.lit(0).alias("rank"))
    shared = place_keys(places, "place_id", ["form"]).join(
        entity_keys(entities, "entity_id", "label"), ["kind", "token"]
    ).select("place_id", "entity_id", F.when(F.col("kind") == METHODS[1], 1).otherwise(2).alias("rank"))
    best = by_id.unionByName(shared).groupBy("place_id", "entity_id").agg(F.min("rank").alias("rank"))
    labels = entities.select("entity_id", names.alnum_key("label").alias("norm"))
    own = place_keys(places, "place_id", ["form"]).where(F.col("kind") == METHODS[1]).select(
        "place_id", F.col("token").alias("norm"), F.lit(True).alias("label_hit"))
    method = F.element_at(F.array(*[F.lit(m) for m in METHODS]), F.col("rank") + 1)
    return (
        best.join(labels, "entity_id")
        .join(own, ["place_id", "norm"], "left")
        .select(
            "place_id",
            "entity_id",
            method.alias("match_method"),
            F.when((F.col("rank") == 0) | ((F.col("rank") == 1) & F.coalesce("label_hit", F.lit(False))), "high")
            .otherwise("medium")
            .alias("confidence"),
        )
    )


def with_curated(links: DataFrame, curated: DataFrame, entities: DataFrame) -> DataFrame:
    """Add curated links (place_id, entity_id, rejected) unless rejected,
    already linked, or naming an entity that no longer exists."""
    fresh = (
        curated.where(~F.col("rejected"))
        .join(entities.select("entity_id"), "entity_id", "left_semi")
        .join(links.select("place_id", "entity_id"), ["place_id", "entity_id"], "left_anti")
        .select("place_id", "entity_id", F.lit("curated").alias("match_method"), F.lit("high").alias("confidence"))
    )
    return links.unionByName(fresh)


def unlinked(names_df: DataFrame, name: str, linked_keys: DataFrame, decided: DataFrame) -> DataFrame:
    """Names none of whose keys is linked and that carry no earlier decision."""
    distinct = names_df.select(name).distinct()
    keyed = place_keys(distinct, name, [name]).select(name, "token")
    hit = keyed.join(linked_keys.select("token"), "token", "left_semi").select(name)
    return distinct.join(hit, name, "left_anti").join(decided.select(name), name, "left_anti")


# Fuzzy shortlist ---------------------------------------------------------

# Fixed value: letters from rare to common, then digits; the order in which a
# key's characters are tried as blocking tokens.
RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate0123456789"
MIN_SCORE, BONUS = 0.6, 0.15


def _prefix(df: DataFrame, key: str, share: float) -> DataFrame:
    """Blocking tokens of a key: its rarest characters, as many as could all be
    missing from the other key while a ``share`` of the key still matches."""
    chars = F.filter(F.split(key, ""), lambda c: c != "")
    counted = F.transform(
        chars,
        lambda c, i: F.struct(
            (-F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c))).alias("occ"),
            F.position(c, F.lit(RARE_FIRST)).alias("r"),
        ),
    )
    keep = F.length(key) - F.ceil(F.length(key) * F.lit(share) - 1e-9).cast("int") + 1
    return df.select("*", F.explode(F.slice(F.array_sort(counted), F.lit(1), keep)).alias("token"))


def shortlist(
    place_keys_df: DataFrame, entity_keys_df: DataFrame, k: int
) -> DataFrame:
    """Top-k entities per place by best key similarity (+ bonus for containment).

    Inputs are (place_id, key) and (entity_id, key).  Similarity is
    1 - levenshtein / longer length.  It needs a minimum share of equal
    characters, so the keys meet on their rarest
    characters (prefix filter: no qualifying pair is missed); containment pairs
    meet on the four-letter opening of the contained key.
    """
    share = MIN_SCORE
    a = place_keys_df.select(F.col("key").alias("a")).distinct()
    b = entity_keys_df.select(F.col("key").alias("b")).distinct()
    similar = _prefix(a, "a", share).join(_prefix(b, "b", share), "token").select("a", "b")

    def inside(short: DataFrame, s: str, long: DataFrame, l: str) -> DataFrame:
        grams = F.explode(
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(l) - 3), lambda i: F.substr(F.col(l), i, F.lit(4))))
        )
        return (
            short.where(F.length(s) >= 4).select(s, F.left(s, F.lit(4)).alias("g"))
            .join(long.where(F.length(l) >= 4).select(l, grams.alias("g")), "g")
            .where(F.contains(l, F.col(s)))
            .select("a", "b")
        )

    contained = inside(a, "a", b, "b").unionByName(inside(b, "b", a, "a")).distinct()
    longest = F.greatest(F.length("a"), F.length("b"))
    sim = 1 - F.levenshtein("a", "b") / longest
    pairs = similar.unionByName(contained).distinct().withColumn("sim", sim)
    flags = contained.withColumn("inside", F.lit(1))
    scored = pairs.join(flags, ["a", "b"], "left")
    ids = (
        scored.join(place_keys_df.select("place_id", F.col("key").alias("a")), "a")
        .join(entity_keys_df.select("entity_id", F.col("key").alias("b")), "b")
        .groupBy("place_id", "entity_id")
        .agg((F.max("sim") + F.lit(BONUS) * F.coalesce(F.max("inside"), F.lit(0))).alias("score"))
        .where(F.col("score") >= MIN_SCORE - 1e-12)
    )
    return top_per_group(ids, ["place_id"], [F.desc("score"), F.asc("entity_id")], k)
