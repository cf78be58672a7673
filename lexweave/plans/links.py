"""C14, C15, K11, K12: linking names across sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import linking
from ..sources.tables import table
from .registry import query
from .sqlforms import alnum, translit_keys, variants

# Places are the distinct part name and brand; entities are respelled copies.
_PE = """pl AS (SELECT p_name || ' ' || p_brand AS form, min(p_partkey) AS place_id, CASE WHEN min(p_partkey) % 7 = 0 THEN 'a' || min(p_partkey) ELSE '' END AS authority_id FROM part GROUP BY p_name, p_brand),
en AS (SELECT 'e' || place_id AS entity_id, CASE place_id % 5 WHEN 0 THEN '* ' || form WHEN 1 THEN upper(form) || ' (Region)' WHEN 2 THEN replace(replace(form, 'c', 'k'), 'ru', 'rhu') WHEN 3 THEN 'other' || form ELSE 'The ' || form END AS label, CASE WHEN place_id % 7 = 0 THEN 'a' || place_id ELSE '' END AS authority_id FROM pl)"""


def places(spark, d):
    g = table(spark, d, "part").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("place_id"))
    k = F.col("place_id")
    return g.select("place_id", F.concat("p_name", F.lit(" "), "p_brand").alias("form"), F.when(k % 7 == 0, F.concat(F.lit("a"), k)).otherwise("").alias("authority_id"))


def entities(spark, d):
    k, f = F.col("place_id"), F.col("form")
    label = (
        F.when(k % 5 == 0, F.concat(F.lit("* "), f)).when(k % 5 == 1, F.concat(F.upper(f), F.lit(" (Region)")))
        .when(k % 5 == 2, F.replace(F.replace(f, F.lit("c"), F.lit("k")), F.lit("ru"), F.lit("rhu"))).when(k % 5 == 3, F.concat(F.lit("other"), f)).otherwise(F.concat(F.lit("The "), f)))
    return places(spark, d).select(F.concat(F.lit("e"), k).alias("entity_id"), label.alias("label"), "authority_id")


_LINKS = f"""{_PE}, pv AS MATERIALIZED (SELECT place_id, authority_id, {variants('form', True, True, True)} AS v FROM pl), ev AS MATERIALIZED (SELECT entity_id, authority_id, {alnum('label')} AS norm, {variants('label', False, False, False)} AS v FROM en),
pk AS MATERIALIZED (SELECT *, {translit_keys('v')} AS t FROM pv), ek AS MATERIALIZED (SELECT *, {translit_keys('v')} AS t FROM ev),
ln AS MATERIALIZED (SELECT place_id, entity_id, CASE WHEN p.authority_id <> '' AND p.authority_id = e.authority_id THEN 'authority_id' WHEN list_has_any(p.v, e.v) THEN 'exact_normalized_name' WHEN list_has_any(p.t, e.t) THEN 'transliteration' END AS match_method, list_contains(p.v, e.norm) AS hit FROM pk p, ek e),
lk AS MATERIALIZED (SELECT place_id, entity_id, match_method, CASE WHEN match_method = 'authority_id' OR (match_method = 'exact_normalized_name' AND hit) THEN 'high' ELSE 'medium' END AS confidence FROM ln WHERE match_method IS NOT NULL)"""


@query("C14_name_variant_links", f"WITH {_LINKS} SELECT * FROM lk")
def c14(spark, d):
    return linking.link_places(places(spark, d), entities(spark, d))


_FZ = f"{_PE}, a AS (SELECT place_id, {alnum('form')} AS x FROM pl), b AS (SELECT entity_id, {alnum('label')} AS y FROM en), s AS (SELECT place_id, entity_id, 1 - levenshtein(x, y)::DOUBLE / greatest(len(x), len(y)) + CASE WHEN len(x) >= 4 AND len(y) >= 4 AND (contains(x, y) OR contains(y, x)) THEN 0.15::DOUBLE ELSE 0 END AS score FROM a, b)"


@query("C15_fuzzy_shortlist", f"WITH {_FZ} SELECT place_id, entity_id, round(score, 6) AS score, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY place_id ORDER BY round(score, 9) DESC, entity_id) AS INTEGER) AS rn FROM s WHERE score >= 0.6 - 1e-12) WHERE rn <= 5")
def c15(spark, d):
    p = places(spark, d).select("place_id", names.alnum_key("form").alias("key"))
    e = entities(spark, d).select("entity_id", names.alnum_key("label").alias("key"))
    return linking.shortlist(p, e, 5).select("place_id", "entity_id", F.round("score", 6).alias("score"), "rn")


@query("K11_links_with_curated", f"WITH {_LINKS} SELECT * FROM lk UNION ALL SELECT place_id, 'e' || (place_id + 1), 'curated', 'high' FROM pl WHERE place_id % 3 = 0 AND 'e' || (place_id + 1) IN (SELECT entity_id FROM en) AND NOT EXISTS (SELECT 1 FROM lk WHERE lk.place_id = pl.place_id AND lk.entity_id = 'e' || (pl.place_id + 1))")
def k11(spark, d):
    p, e = places(spark, d), entities(spark, d)
    curated = p.where("place_id % 3 <> 2").select("place_id", F.concat(F.lit("e"), F.col("place_id") + 1).alias("entity_id"), (F.col("place_id") % 3 == 1).alias("rejected"))
    return linking.with_curated(linking.link_places(p, e), curated, e)


@query("K12_curation_queue", f"""WITH {_PE}, pk AS (SELECT form, unnest({variants('form', True, True, True)}) AS tok FROM pl), lk AS (SELECT unnest({variants('label', False, False, False)}) AS tok FROM en WHERE authority_id = '')
SELECT form FROM pl WHERE place_id % 11 <> 0 AND form NOT IN (SELECT form FROM pk JOIN lk USING (tok)) AND form NOT IN (SELECT form FROM (SELECT form, unnest({translit_keys(variants('form', True, True, True))}) AS tok FROM pl) a JOIN (SELECT unnest({translit_keys(variants('label', False, False, False))}) AS tok FROM en WHERE authority_id = '') b USING (tok))""")
def k12(spark, d):
    p = places(spark, d)
    linked = linking.entity_keys(entities(spark, d).where("authority_id = ''"), "entity_id", "label")
    decided = p.where("place_id % 11 = 0").select("form")
    return linking.unlinked(p, "form", linked, decided)
