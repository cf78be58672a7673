"""K: validation, stylometry and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import audit, permute, quality, spelling, stats, style, terms
from ..operators.scan import top_per_group
from ..session import scratch_path
from ..sources.tables import resolve, table
from .base import LINES_SQL, TOKENS_SQL, doc_words, documents, r6, tokens
from .registry import query
from .scalars import _LEMMAS, lemma_table

UPOS_SQL = "CASE l_returnflag WHEN 'A' THEN 'NOUN' WHEN 'N' THEN 'VERB' ELSE 'PUNCT' END"


def syntax(spark, d):
    """Order lines as tokens of a sentence (the order), suppliers' nations as units."""
    upos = F.when(F.col("l_returnflag") == "A", "NOUN").when(F.col("l_returnflag") == "N", "VERB").otherwise("PUNCT")
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 50).alias("unit"), F.col("l_orderkey").alias("sentence"), F.col("l_linenumber").alias("index"), upos.alias("upos"),
        F.when(F.col("l_linestatus") == "O", "obj").otherwise("nsubj").alias("deprel"), (F.col("l_partkey") % 6).cast("int").alias("head"),
        F.when(F.col("l_tax") > 0.04, F.array(F.lit("Case=Nom"), F.concat(F.lit("Number="), "l_linestatus"))).otherwise(F.array().cast("array<string>")).alias("feats"))


@query("K1_token_rules", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter([CASE WHEN l_linenumber > 7 THEN 'index' END, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'upos' END, CASE WHEN l_partkey % 9 > 7 THEN 'head_range' END, CASE WHEN l_partkey % 9 = l_linenumber THEN 'self_head' END], lambda x: x IS NOT NULL), ',') AS failed
FROM lineitem WHERE l_linenumber > 7 OR (l_returnflag = 'R' AND l_linestatus = 'F') OR l_partkey % 9 > 7 OR l_partkey % 9 = l_linenumber""")
def k1(spark, d):
    upos = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "bogus").otherwise("noun")
    rules = quality.token_rules(F.col("l_linenumber"), upos, F.col("l_partkey") % 9, F.lit(7), F.lit("x"), F.lit("x"))
    _, bad = quality.split_good_bad(table(spark, d, "lineitem"), rules)
    return bad.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("failed", ",").alias("failed"))


@query("K1_sentence_split_rules", """WITH t AS (SELECT conv_id, turn, role, text FROM conversations), p AS (SELECT a.conv_id, a.turn, len(string_split(a.text, chr(10))) AS l, string_split(b.text, chr(10)) AS r FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'),
f AS (SELECT conv_id, turn, l, r, list_filter(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN trim(r[i]) = '' THEN 'empty sentence at ' || i WHEN regexp_matches(trim(r[i]), '[—–-]$') THEN 'dash ending at ' || i
 WHEN i > 1 AND regexp_matches(r[i], '^\\p{Ll}') AND regexp_matches(trim(r[i]), '(?i)^(and|but|or|nor|for|so|yet|while|that|which|who|whom|whose|from|to|of|by)\\b') THEN 'continuation at ' || i END), lambda x: x IS NOT NULL) AS bad FROM p)
SELECT conv_id, turn, CASE WHEN l <> len(r) THEN 'count mismatch: ' || l || ' vs ' || len(r) ELSE coalesce(bad[1], '') END AS verdict FROM f""")
def k1b(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", F.split("text", "\n").alias("s"))
    a = t.where("role = 'user'").select("conv_id", "turn", F.col("s").alias("l"))
    b = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("r"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", quality.split_verdict(F.col("l"), F.col("r")).alias("verdict"))


@query("K2_morphosyntax_counts", f"""WITH t AS (SELECT l_orderkey % 50 AS unit, l_orderkey AS s, l_linenumber AS i, {UPOS_SQL} AS u, CASE WHEN l_linestatus = 'O' THEN 'obj' ELSE 'nsubj' END AS r, l_partkey % 6 AS h, l_tax > 0.04 AS f, l_linestatus AS ls FROM lineitem),
hd AS (SELECT s, i, max(u) AS hu FROM t GROUP BY ALL), j AS (SELECT t.*, hu FROM t LEFT JOIN hd ON hd.s = t.s AND hd.i = t.h), b AS (SELECT unit, s, count(*) FILTER (WHERE u <> 'PUNCT') AS w FROM t GROUP BY ALL),
x AS (SELECT unit, 'upos:' || u AS feature FROM t WHERE u <> 'PUNCT' UNION ALL SELECT unit, 'deprel:' || r FROM t UNION ALL SELECT unit, 'deprel_upos:' || r || ':' || u FROM t WHERE u <> 'PUNCT' UNION ALL SELECT unit, 'feat:Case=Nom' FROM t WHERE f UNION ALL SELECT unit, 'feat:Number=' || ls FROM t WHERE f
 UNION ALL SELECT unit, 'root_upos:' || u FROM t WHERE h = 0 AND u <> 'PUNCT' UNION ALL SELECT unit, 'head_child_upos:' || hu || '>' || u FROM j WHERE h <> 0 AND hu IS NOT NULL AND u <> 'PUNCT' UNION ALL SELECT unit, 'head_direction:' || r || ':' || CASE WHEN h > i THEN 'left' ELSE 'right' END FROM j WHERE h <> 0 AND hu IS NOT NULL AND u <> 'PUNCT'
 UNION ALL SELECT unit, 'sentence_len_bin:' || lpad(CAST(least(40, w // 5 * 5) AS VARCHAR), 2, '0') || '-' || lpad(CAST(least(40, w // 5 * 5) + 4 AS VARCHAR), 2, '0') FROM b WHERE w > 0) SELECT unit, feature, count(*) AS n FROM x GROUP BY ALL""")
def k2(spark, d):
    return style.morphosyntax_counts(syntax(spark, d), ["unit"], ["sentence"])


@query("K2_dependency_paths", f"""WITH RECURSIVE t AS (SELECT l_orderkey AS s, l_linenumber AS i, min({{'h': CAST(l_partkey % 6 AS BIGINT), 'p': CASE WHEN l_linestatus = 'O' THEN 'obj' ELSE 'nsubj' END || '-' || {UPOS_SQL}}}) AS x FROM lineitem GROUP BY ALL),
w(s, i, up, path, depth) AS (SELECT s, i, x.h, x.p, 1 FROM t UNION ALL SELECT w.s, w.i, t.x.h, t.x.p || '>' || w.path, depth + 1 FROM w JOIN t ON t.s = w.s AND t.i = w.up WHERE w.up <> 0 AND depth < 9)
SELECT t.s % 50 AS unit, coalesce(path, 'malformed') AS feature, count(*) AS n FROM t LEFT JOIN (SELECT * FROM w WHERE up = 0) r ON r.s = t.s AND r.i = t.i GROUP BY ALL""")
def k2b(spark, d):
    return style.path_counts(syntax(spark, d), ["unit"], ["sentence"])


_COUNTS = f"{TOKENS_SQL}, counts AS (SELECT source AS unit, term AS feature, count(*) AS n FROM tokens GROUP BY ALL), sel AS (SELECT feature, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY ALL HAVING sum(n) >= 2 ORDER BY total DESC, feature LIMIT 150)"
_REL = _COUNTS + ", rel AS (SELECT unit, feature, n / t AS v FROM counts JOIN (SELECT unit, sum(n) AS t FROM counts GROUP BY ALL) USING (unit) WHERE feature IN (SELECT feature FROM sel)), un AS (SELECT unit, feature, v / sqrt(sum(v * v) OVER (PARTITION BY unit)) AS u FROM rel)"


def source_counts(spark, d):
    return tokens(spark, d).groupBy(F.col("source").alias("unit"), F.col("term").alias("feature")).agg(F.count("*").alias("n"))


def source_frequencies(spark, d):
    c = source_counts(spark, d)
    return style.relative_frequencies(c, style.select_features(c, 150, 2))


@query("K3_feature_selection", f"WITH {_COUNTS} SELECT * FROM sel")
def k3(spark, d):
    return style.select_features(source_counts(spark, d), 150, 2)


@query("K3_feature_selection_fallback", f"WITH {TOKENS_SQL} SELECT term AS feature, count(*) AS total FROM tokens GROUP BY term ORDER BY total DESC, term LIMIT 40")
def k3b(spark, d):
    return style.select_features(source_counts(spark, d), 40, 1_000_000_000)


@query("K4_distance_matrix", f"WITH {_REL} SELECT a.unit AS a, b.unit AS b, round(1 - sum(a.u * b.u), 6) AS distance FROM un a JOIN un b ON a.feature = b.feature AND a.unit < b.unit GROUP BY ALL")
def k4(spark, d):
    return style.cosine_distances(source_frequencies(spark, d)).select("a", "b", r6("distance").alias("distance"))


@query("K5_field_resolution", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'p' || page_id ELSE '' END AS label FROM pages")
def k5(spark, d):
    p = F.col("page_id")
    loose = table(spark, d, "pages").select(
        p, F.when(p % 3 == 0, F.col("url")).otherwise(" ").alias("Object-Name"), F.when(p % 3 == 1, F.concat(F.lit("  p"), p)).alias("TITLE"), F.lit("x").alias("other"))
    return loose.select("page_id", resolve(loose, ["object name", "title"]).alias("label"))


_VEC = "e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), s AS MATERIALIZED (SELECT a.vec_id AS id, b.vec_id AS nbr, 1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id), k AS (SELECT id, nbr, d, row_number() OVER (PARTITION BY id ORDER BY round(d, 12), nbr) AS rn FROM s)"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query("K6_nearest_neighbours", f"WITH {_VEC} SELECT id, nbr, round(d, 6) AS distance, CAST(rn AS INTEGER) AS rn FROM k WHERE rn <= 5")
def k6(spark, d):
    return style.knn(vectors(spark, d), 5).select("id", "nbr", r6("distance").alias("distance"), "rn")


@query("K6_outlier_scores", f"WITH {_VEC} SELECT id, round(avg(d), 6) AS score, round(min(d), 6) AS nearest FROM k WHERE rn <= 5 GROUP BY id")
def k6b(spark, d):
    return style.outliers(style.knn(vectors(spark, d), 5)).select("id", r6("score").alias("score"), r6("nearest").alias("nearest"))


_FLAG = "CAST(substr(unit, 4) AS INTEGER) < 7"


@query("K7_group_separation", f"WITH {_REL}, p AS (SELECT {_FLAG.replace('unit', 'a.unit')} AS fa, {_FLAG.replace('unit', 'b.unit')} AS fb, 1 - sum(a.u * b.u) AS d FROM un a JOIN un b ON a.feature = b.feature AND a.unit < b.unit GROUP BY a.unit, b.unit), m AS (SELECT avg(d) FILTER (WHERE fa AND fb) AS p, avg(d) FILTER (WHERE NOT fa AND NOT fb) AS n, avg(d) FILTER (WHERE fa <> fb) AS b FROM p) SELECT round(p, 6) AS within_positive, round(n, 6) AS within_negative, round(b, 6) AS between, round(b - (p + n) / 2, 6) AS separation FROM m")
def k7(spark, d):
    u = style.unit_vectors(source_frequencies(spark, d)).withColumn("flag", F.substr("unit", F.lit(4)).cast("int") < 7)
    out = style.separation(u, "flag")
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("K7_feature_deltas", f"WITH {_REL}, n AS (SELECT count(*) FILTER (WHERE f) AS p, count(*) FILTER (WHERE NOT f) AS q FROM (SELECT DISTINCT unit, {_FLAG} AS f FROM rel)), s AS (SELECT feature, coalesce(sum(v) FILTER (WHERE {_FLAG}), 0) AS p, coalesce(sum(v) FILTER (WHERE NOT {_FLAG}), 0) AS q FROM rel GROUP BY ALL) SELECT feature, round(s.p / n.p, 9) AS positive_mean, round(s.q / n.q, 9) AS negative_mean, round(s.p / n.p - s.q / n.q, 9) AS delta FROM s, n")
def k7b(spark, d):
    rel = source_frequencies(spark, d)
    flags = rel.select("unit").distinct().withColumn("flag", F.substr("unit", F.lit(4)).cast("int") < 7)
    out = style.feature_deltas(rel, flags, "flag")
    return out.select("feature", *[r6(c, 9).alias(c) for c in ("positive_mean", "negative_mean", "delta")])


@query("K7_span_permutation", """WITH r AS (SELECT lang, doc_id, CAST(n_chars AS DOUBLE) AS v, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pos, count(*) OVER (PARTITION BY lang) AS n, sum(CAST(n_chars AS DOUBLE)) OVER (PARTITION BY lang) AS total, sum(CAST(n_chars AS DOUBLE)) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM documents),
sp AS (SELECT lang, min(pos) FILTER (WHERE s) AS a, count(*) FILTER (WHERE s) AS size FROM (SELECT *, doc_id >= (SELECT 0.2::DOUBLE * max(doc_id) FROM documents) AND doc_id < (SELECT 0.3::DOUBLE * max(doc_id) FROM documents) AS s FROM r) GROUP BY lang),
g AS (SELECT x.lang, x.pos, a, size, x.n, y.cum - x.cum + x.v + CASE WHEN y.pos < x.pos THEN x.total ELSE 0 END AS w, x.total FROM r x JOIN sp ON sp.lang = x.lang JOIN r y ON y.lang = x.lang AND y.pos = (x.pos + size - 2) % x.n + 1 WHERE size > 0 AND size < x.n),
q AS (SELECT *, round(w / size - (total - w) / (n - size), 9) AS gap FROM g), o AS (SELECT lang, n, size, gap FROM q WHERE pos = a),
k AS (SELECT lang, gap, row_number() OVER (PARTITION BY lang ORDER BY md5('span|' || lang || '|' || pos), pos) AS rn FROM q WHERE pos <> a)
SELECT lang, any_value(o.n) AS "rows", any_value(size) AS span, round(any_value(o.gap), 6) AS difference, count(*) AS shifts, count(*) FILTER (WHERE abs(k.gap) >= abs(o.gap)) AS as_extreme, round((1 + count(*) FILTER (WHERE abs(k.gap) >= abs(o.gap))) / (1 + count(*)), 6) AS p_value FROM k JOIN o USING (lang) WHERE rn <= 199 GROUP BY lang""")
def k7c(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    top = docs.agg(F.max("doc_id").cast("double")).scalar()
    out = permute.span_permutation(docs, ["lang"], ["doc_id"], "n_chars", (F.col("doc_id") >= F.lit(0.2) * top) & (F.col("doc_id") < F.lit(0.3) * top), 199)
    return out.withColumn("difference", r6("difference")).withColumn("p_value", r6("p_value"))


@query("K7_bootstrap_intervals", """WITH h AS (SELECT source, CAST(n_chars AS DOUBLE) AS v, r, CAST('0x' || substr(md5('boot|' || (r // 8) || '|' || doc_id), CAST(4 * (r % 8) + 1 AS BIGINT), 4) AS INTEGER) / 65536.0::DOUBLE AS u FROM documents, range(40) t(r)),
m AS (SELECT source, r, sum(w * v) / sum(w) AS m FROM (SELECT source, v, r, len(list_filter([0.36787944117144233::DOUBLE, 0.7357588823428847::DOUBLE, 0.9196986029286058::DOUBLE, 0.9810118431238462::DOUBLE, 0.9963401531726563::DOUBLE, 0.9994058151824183::DOUBLE, 0.9999167588507119::DOUBLE], lambda p: u >= p)) AS w FROM h) GROUP BY ALL HAVING sum(w) > 0),
l AS (SELECT source, list_sort(list(m)) AS a, stddev_samp(m) AS s FROM m GROUP BY source)
SELECT source, n, round(mean, 4) AS mean, round(s, 4) AS stderr, round(a[CAST(floor((len(a) - 1) * 0.025) AS BIGINT) + 1], 4) AS low, round(a[CAST(floor((len(a) - 1) * 0.975) AS BIGINT) + 1], 4) AS high FROM l JOIN (SELECT source, count(*) AS n, avg(CAST(n_chars AS DOUBLE)) AS mean FROM documents GROUP BY source) USING (source)""")
def k7d(spark, d):
    out = permute.poisson_bootstrap(table(spark, d, "documents"), ["source"], ["doc_id"], "n_chars", 40)
    return out.select("source", "n", *[r6(c, 4).alias(c) for c in ("mean", "stderr", "low", "high")])


@query("K8_projection_2d")
def k8(spark, d):
    return style.project_2d(vectors(spark, d))


@query("K9_function_word_counts", f"""WITH t AS (SELECT l_orderkey % 50 AS unit, {UPOS_SQL.replace("'NOUN'", "'DET'").replace("'VERB'", "'ADP'")} AS u, lower(p_name) AS form, CASE WHEN l_linestatus = 'O' THEN 'obj' ELSE 'punct' END AS r FROM lineitem JOIN part ON p_partkey = l_partkey), f AS (SELECT * FROM t WHERE u <> 'PUNCT'),
x AS (SELECT unit, 'func_upos:' || u AS feature FROM f UNION ALL SELECT unit, 'func:' || form FROM f UNION ALL SELECT unit, 'func_form_upos:' || form || ':' || u FROM f UNION ALL SELECT unit, 'func_deprel:' || r FROM f WHERE r <> 'punct') SELECT unit, feature, count(*) AS n FROM x GROUP BY ALL""")
def k9(spark, d):
    upos = F.when(F.col("l_returnflag") == "A", "DET").when(F.col("l_returnflag") == "N", "adp").otherwise("PUNCT")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("form"))
    t = table(spark, d, "lineitem").join(p, "l_partkey").select(
        (F.col("l_orderkey") % 50).alias("unit"), upos.alias("upos"), "form", F.when(F.col("l_linestatus") == "O", "obj").otherwise("punct").alias("deprel"))
    return style.function_words(t, ["unit"])


_PRES = """t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents), g AS (SELECT doc_id, CAST(substr(source, 4) AS INTEGER) AS grp FROM documents),
r AS (SELECT k.grp, f.feature, any_value(k.units) AS units, count(t.term) AS hits FROM (SELECT grp, count(*) AS units FROM g GROUP BY ALL) k CROSS JOIN (VALUES ('the'), ('que'), ('zzz')) f(feature) LEFT JOIN g ON g.grp = k.grp LEFT JOIN t ON t.doc_id = g.doc_id AND t.term = f.feature GROUP BY k.grp, f.feature)"""


def presence(spark, d):
    c = doc_words(spark, d).select(F.col("doc_id").alias("unit"), F.explode(F.array_distinct("toks")).alias("feature"), F.lit(1).alias("n"))
    g = documents(spark, d).select(F.col("doc_id").alias("unit"), F.col("book").alias("grp"))
    return style.presence_rates(c, g, ("the", "que", "zzz"))


@query("K10_presence_rates", f"WITH {_PRES} SELECT grp, feature, units, hits, round(hits / units, 6) AS rate FROM r")
def k10(spark, d):
    return presence(spark, d).withColumn("rate", r6("rate"))


@query("K10_presence_trend", f"WITH {_PRES}, z AS (SELECT feature, count(*) AS n, sum(units) AS w, sum(units * grp) AS wx, sum(hits) AS wy, sum(units * grp * grp) AS wxx, sum(hits * grp) AS wxy FROM r GROUP BY ALL) SELECT feature, n, round((wxy - wx * wy / w) / (wxx - wx * wx / w), 9) AS slope FROM z")
def k10b(spark, d):
    return stats.weighted_line(presence(spark, d), "grp", "rate", "units", ["feature"]).select("feature", "n", r6("slope", 9).alias("slope"))


_VAR = "v AS (SELECT p_type AS entity, p_name AS variant, count(*) AS n FROM part GROUP BY ALL), b AS (SELECT entity, arg_max(variant, (n, CASE WHEN variant LIKE 'small%' THEN 1 ELSE 0 END, variant)) AS preferred FROM v GROUP BY ALL)"


def variant_counts(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("entity"), F.col("p_name").alias("variant")).agg(F.count("*").alias("n")).withColumn(
        "is_existing", F.col("variant").like("small%").cast("int"))


@query("K13_dominant_spelling", f"WITH {_VAR} SELECT entity, preferred, variant AS deprecated, n FROM v JOIN b USING (entity) WHERE variant <> preferred")
def k13(spark, d):
    return quality.dominant_spelling(variant_counts(spark, d))


_POL = "pol AS (SELECT DISTINCT upper(substr(w, 1, 1)) || substr(w, 2) AS deprecated, 'X' || left(w, 3) AS preferred FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{2,}')) AS w FROM benchmark)), safe AS (SELECT deprecated, min(preferred) AS preferred FROM pol GROUP BY ALL HAVING count(DISTINCT preferred) = 1 AND deprecated NOT IN (SELECT preferred FROM pol))"


def policies(spark, d):
    w = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("w")).distinct()
    return w.select(F.concat(F.upper(F.left("w", F.lit(1))), F.substr("w", F.lit(2))).alias("deprecated"), F.concat(F.lit("X"), F.left("w", F.lit(3))).alias("preferred")).distinct()


@query("K14_safe_replacements", f"WITH {_POL} SELECT * FROM safe")
def k14(spark, d):
    return quality.safe_replacements(policies(spark, d)).select("deprecated", "preferred")


@query("K15_policy_findings", f"WITH {_POL}, t AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+') AS p FROM documents)) SELECT doc_id, piece AS variant, count(*) AS n FROM t JOIN safe ON deprecated = piece GROUP BY ALL")
def k15(spark, d):
    pol = quality.safe_replacements(policies(spark, d)).select(F.col("deprecated").alias("variant"), F.col("preferred").alias("target"))
    found = spelling.findings(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", pol)
    return found.groupBy("doc_id", "variant").agg(F.count("*").alias("n"))


@query("K15_policy_changes", f"WITH {_POL}, t AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+') AS p FROM documents)) SELECT doc_id, md5(string_agg(coalesce(preferred, piece), '' ORDER BY i)) AS digest, CAST(count(preferred) AS INTEGER) AS replaced FROM t LEFT JOIN safe ON deprecated = piece GROUP BY ALL HAVING count(preferred) > 0")
def k15b(spark, d):
    pol = quality.safe_replacements(policies(spark, d)).select(F.col("deprecated").alias("variant"), F.col("preferred").alias("target"))
    out = spelling.apply_policy(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", pol)
    return out.select("doc_id", F.md5("new_text").alias("digest"), "replaced")


@query("K16_names_to_stopwords", r"WITH p AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word FROM documents), n AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '\p{Lu}[\p{Ll}]+'))) AS word FROM benchmark), s AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word FROM conversations) SELECT word FROM p WHERE word IN (SELECT word FROM n) AND word NOT IN (SELECT word FROM s)")
def k16(spark, d):
    p = doc_words(spark, d).select(F.explode(F.array_distinct("toks")).alias("phrase"))
    n = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{Lu}[\p{Ll}]+"), F.lit(0))).alias("word"))
    s = table(spark, d, "conversations").select(F.explode(F.array_distinct(tx.words("text"))).alias("word")).distinct()
    return audit.names_for_stopwords(p, n, s)


@query("K17_manifest_diff", """SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 10 = 1 THEN 'stale_size' WHEN doc_id % 10 = 2 THEN 'stale_hash' ELSE 'same' END AS status FROM documents UNION ALL SELECT 'q' || item_id, 'extra' FROM benchmark""")
def k17(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.length("text").alias("size"), F.sha2("text", 256).alias("sha256"), (F.col("doc_id") % 10).alias("k"))
    remote = docs.where("k <> 0").select(
        "path", F.when(F.col("k") == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("k") == 2, F.sha2("path", 256)).otherwise(F.col("sha256")).alias("sha256"))
    extra = table(spark, d, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("path"), F.length("text").alias("size"), F.sha2("text", 256).alias("sha256"))
    return audit.manifest_diff(docs.drop("k"), remote.unionByName(extra))


@query("K18_cross_reference_index", """WITH m AS (SELECT DISTINCT l_partkey AS entity, l_orderkey AS passage FROM lineitem) SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY passage) AS position, passage FROM m""")
def k18(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("passage"))
    return audit.cross_reference(m.withColumn("k", F.col("passage")), ["entity"], "passage", ["k"])


@query("K19_line_lemma_view", f"""WITH {LINES_SQL}, {_LEMMAS}, t AS (SELECT doc_id, line_no, generate_subscripts(w, 1) AS pos, unnest(w) AS term FROM (SELECT doc_id, line_no, regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM lines))
SELECT doc_id, line_no, md5(string_agg(coalesce(lemma, term), ' ' ORDER BY pos)) AS digest, count(*) FILTER (WHERE lemma IS NULL) AS missing FROM t LEFT JOIN lemmas ON surface = term GROUP BY ALL""")
def k19(spark, d):
    from .base import doc_lines

    t = doc_lines(spark, d).select("doc_id", "line_no", F.posexplode(tx.words("line")).alias("pos", "term"))
    out = terms.lemma_texts(terms.lemmatize(t, lemma_table(spark, d)), ["doc_id", "line_no"], "pos")
    return out.select("doc_id", "line_no", F.md5("text").alias("digest"), "missing")
