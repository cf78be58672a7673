"""G: scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, entities, names, numbers
from ..functions import text as tx
from ..operators import spelling, terms
from ..operators.quality import GONE_PHRASES, status_from_text
from ..sources.tables import table
from .base import COORDS_SQL, LINES_SQL, TOKENS_SQL, TYPED_SQL, coords, doc_lines, doc_words, documents, r6, tokens, typed_edges
from .registry import query
from .sqlforms import alnum, translit_keys, variants


def digest(arr) -> F.Column:
    return F.md5(F.array_join(arr, "|"))


@query("G1_word_tokens", f"WITH {TOKENS_SQL} SELECT lang, count(*) AS tokens, count(DISTINCT term) AS types FROM tokens GROUP BY ALL")
def g1(spark, d):
    c = doc_words(spark, d, "lang").select("lang", F.explode("toks").alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))
    return c.groupBy("lang").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"))


@query("G1_count_words", r"SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS INTEGER) AS n_words FROM conversations")
def g1b(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.count_words("text").alias("n_words"))


@query("G2_script_tokens", "SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '[A-Za-zÀ-ɏ]+(?:[ʼ''’][A-Za-zÀ-ɏ]*)?'), '|')) AS digest FROM documents")
def g2(spark, d):
    return table(spark, d, "documents").select("doc_id", digest(tx.script_tokens("text", tx.LATIN_BLOCKS)).alias("digest"))


@query("G3_parser_tokens", r"SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'), '|')) AS digest FROM documents")
def g3(spark, d):
    return table(spark, d, "documents").select("doc_id", digest(tx.parser_tokens("text")).alias("digest"))


@query("G3_review_tokens", r"SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '[A-Za-zÀ-ɏ]+(?:[ʼ''’][A-Za-zÀ-ɏ]*)?|\d+(?:[.,]\d+)?|[^\s]'), '|')) AS digest FROM documents")
def g3b(spark, d):
    return table(spark, d, "documents").select("doc_id", digest(tx.review_tokens("text", tx.LATIN_BLOCKS)).alias("digest"))


@query("G4_casefold_nfc", "SELECT doc_id, md5(nfc_normalize(replace(lower(text), 'ß', 'ss'))) AS digest FROM documents")
def g4(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.casefold_nfc("text")).alias("digest"))


@query("G5_strip_accents", "SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents")
def g5(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.strip_marks("text")).alias("digest"))


@query("G6_name_keys", f"SELECT page_id, {alnum('url')} AS alnum_key, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS snake_key FROM pages")
def g6(spark, d):
    return table(spark, d, "pages").select("page_id", tx.alnum_key("url").alias("alnum_key"), tx.snake_key("url").alias("snake_key"))


@query("G7_transliteration_keys", f"WITH {TOKENS_SQL} SELECT term, array_to_string(list_sort({translit_keys('[term]')}), '|') AS keys FROM (SELECT DISTINCT term FROM tokens)")
def g7(spark, d):
    v = doc_words(spark, d).select(F.explode("toks").alias("term")).distinct()
    return v.select("term", F.array_join(F.array_sort(names.transliteration_keys(F.array("term"))), "|").alias("keys"))


_NAMES = """named AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '* ' || p_name || ' (alt. ' || p_brand || ')' WHEN 1 THEN 'the ancient ' || p_name WHEN 2 THEN p_name || ' acropolis Hill'
 WHEN 3 THEN 'temple of ' || p_name WHEN 4 THEN p_name || ' at ' || p_type WHEN 5 THEN p_name || ' near ' || p_type || ' (' || p_brand || ')' WHEN 6 THEN 'The Old ' || p_name || ' river' ELSE p_name END AS name FROM part)"""


def named_parts(spark, d):
    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    k = F.col("p_partkey") % 8
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    name = (
        F.when(k == 0, cat("* ", n, " (alt. ", b, ")")).when(k == 1, cat("the ancient ", n)).when(k == 2, cat(n, " acropolis Hill"))
        .when(k == 3, cat("temple of ", n)).when(k == 4, cat(n, " at ", t)).when(k == 5, cat(n, " near ", t, " (", b, ")"))
        .when(k == 6, cat("The Old ", n, " river")).otherwise(n)
    )
    return table(spark, d, "part").select("p_partkey", name.alias("name"))


@query("G8_name_variants", f"WITH {_NAMES} SELECT p_partkey, array_to_string(list_sort({variants('name', True, True, True)}), '|') AS full_keys, array_to_string(list_sort({variants('name', False, False, False)}), '|') AS strict_keys FROM named")
def g8(spark, d):
    join = lambda a: F.array_join(F.array_sort(a), "|")
    return named_parts(spark, d).select(
        "p_partkey", join(names.name_variants(F.col("name"), parenthetical_content=True)).alias("full_keys"),
        join(names.name_variants(F.col("name"), location_container=False, generic_head=False)).alias("strict_keys"))


@query("G9_ending_variants", f"""WITH {TOKENS_SQL} SELECT term, CASE WHEN term LIKE '%os' THEN regexp_replace(term, 'os$', 'us') WHEN term LIKE '%us' THEN regexp_replace(term, 'us$', 'os')
 WHEN term LIKE '%on' THEN regexp_replace(term, 'on$', 'um') WHEN term LIKE '%um' THEN regexp_replace(term, 'um$', 'on') END AS variant FROM (SELECT DISTINCT term FROM tokens)""")
def g9(spark, d):
    v = doc_words(spark, d).select(F.explode("toks").alias("term")).distinct()
    return v.select("term", F.get(names.ending_variants(F.col("term")), F.lit(1)).alias("variant"))


STOP = ("the", "of", "and", "de", "la", "die", "der", "en")
_STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"


@query("G10_ngrams", f"""WITH k AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t NOT IN {_STOP_SQL}) AS t FROM documents),
g AS (SELECT unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS gram FROM k) SELECT gram, count(*) AS n FROM g GROUP BY ALL""")
def g10(spark, d):
    grams = tx.ngrams(terms.drop_stopwords(F.col("toks"), STOP), 1, 2)
    return doc_words(spark, d).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("G11_char_4grams", r"""WITH j AS (SELECT array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), ' ') AS s FROM documents), g AS (SELECT unnest(list_transform(range(1, len(s) - 2), lambda i: substr(s, i, 4))) AS gram FROM j WHERE len(s) >= 4)
SELECT gram, count(*) AS n FROM g GROUP BY ALL""")
def g11(spark, d):
    joined = doc_words(spark, d).select(F.array_join("toks", " ").alias("s"))
    return joined.select(F.explode(tx.char_ngrams(F.col("s"), 4)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


_LEMMAS = r"lemmas AS (SELECT DISTINCT surface, left(surface, 4) AS lemma FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS surface FROM benchmark))"


def lemma_table(spark, d):
    return table(spark, d, "benchmark").select(F.explode(tx.words("text")).alias("surface")).distinct().select(
        "surface", F.left("surface", F.lit(4)).alias("lemma"))


@query("G12_lemma_texts", f"""WITH {TOKENS_SQL}, {_LEMMAS} SELECT doc_id, md5(string_agg(coalesce(lemma, term), ' ' ORDER BY pos)) AS digest, count(*) FILTER (WHERE lemma IS NULL) AS missing, count(*) AS tokens
FROM tokens LEFT JOIN lemmas ON surface = term GROUP BY ALL""")
def g12(spark, d):
    lem = terms.lemmatize(tokens(spark, d), lemma_table(spark, d))
    return terms.lemma_texts(lem, ["doc_id"], "pos").select("doc_id", F.md5("text").alias("digest"), "missing", "tokens")


@query("G12_lemma_stats", f"""WITH {TOKENS_SQL}, {_LEMMAS} SELECT count(DISTINCT doc_id) AS text_count, count(*) AS token_count, count(lemma) AS lemmatized_count, count(*) FILTER (WHERE lemma IS NULL) AS missing_count,
 count(DISTINCT term) FILTER (WHERE lemma IS NULL) AS unique_missing_count FROM tokens LEFT JOIN lemmas ON surface = term""")
def g12b(spark, d):
    return terms.lemma_stats(terms.lemmatize(tokens(spark, d), lemma_table(spark, d)), "doc_id")


@query("G13_vocabulary_first_seen", r"""WITH t AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]{2,}') AS w FROM documents))
SELECT lower(word) AS form, arg_min(word, (doc_id, pos)) AS example, count(*) AS n FROM t GROUP BY ALL""")
def g13(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(tx.WORD2), F.lit(0))).alias("pos", "word"))
    return terms.vocabulary(w, F.lower("word"), F.col("word"), ["doc_id", "pos"])


@query("G14_whole_word_replace", """WITH s AS (SELECT doc_id, text, regexp_replace(regexp_replace(chr(10) || text || chr(10), '([^A-Za-z])the([^A-Za-z])', '\\1THE\\2', 'g'), '([^A-Za-z])the([^A-Za-z])', '\\1THE\\2', 'g') AS u FROM documents)
SELECT doc_id, md5(substr(u, 2, len(u) - 2)) AS digest, CAST((len(u) - len(replace(u, 'THE', ''))) // 3 - (len(text) - len(replace(text, 'THE', ''))) // 3 AS INTEGER) AS replaced FROM s""")
def g14(spark, d):
    pattern = F.lit(tx.whole_word("the"))
    return table(spark, d, "documents").select(
        "doc_id", F.md5(F.regexp_replace("text", pattern, F.lit("THE"))).alias("digest"), F.regexp_count("text", pattern).alias("replaced"))


@query("G14_snippet", """WITH s AS (SELECT doc_id, text, instr(text, 'and') - 1 AS a FROM documents WHERE contains(text, 'and'))
SELECT doc_id, CASE WHEN a > 80 THEN '...' ELSE '' END || replace(substr(text, greatest(0, a - 80) + 1, least(len(text), a + 83) - greatest(0, a - 80)), chr(10), ' ') || CASE WHEN a + 83 < len(text) THEN '...' ELSE '' END AS snippet FROM s""")
def g14b(spark, d):
    at = F.instr("text", "and") - 1
    return table(spark, d, "documents").where(F.contains("text", F.lit("and"))).select("doc_id", tx.snippet(F.col("text"), at, at + 3).alias("snippet"))


@query("G15_multi_pattern_replace", r"""WITH t AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+') AS p FROM documents)),
d AS (SELECT word, 'X' || upper(word) AS target FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM benchmark) WHERE regexp_matches(word, '^[A-Z][a-z]+$'))
SELECT doc_id, md5(string_agg(coalesce(target, piece), '' ORDER BY i)) AS digest, count(target) AS replaced FROM t LEFT JOIN d ON word = piece GROUP BY ALL""")
def g15(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).distinct()
    rules = words.where(F.rlike("word", F.lit("^[A-Z][a-z]+$"))).select(F.col("word").alias("variant"), F.concat(F.lit("X"), F.upper("word")).alias("target"))
    out = spelling.replace_many(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", rules)
    return out.select("doc_id", F.md5("text").alias("digest"), F.col("replaced").cast("long").alias("replaced"))


RULES = (("article", r"\b(the|les|der) ", "survives"), ("number", r"\d{3,}", "needs_review"), ("quoted", r"[a-z]{3,}, [a-z]{3,}", "does_not_survive"))
_RULES_SQL = "(VALUES " + ", ".join(f"('{a}', '(?i){b}', '{c}')" for a, b, c in RULES) + ") r(category, pattern, hint)"


@query("G16_rule_candidates", f"""WITH {LINES_SQL}, m AS (SELECT doc_id, line_no, r.category, r.hint, regexp_extract(line, r.pattern) AS matched FROM lines, {_RULES_SQL} WHERE regexp_matches(line, r.pattern))
SELECT *, sha1(concat_ws(chr(9), 'v1', 'regex', doc_id, line_no, category, matched)) AS candidate_key FROM m""".replace("regexp_extract(line, r.pattern)", "CASE " + " ".join(f"WHEN r.category = '{a}' THEN regexp_extract(line, '(?i){b}')" for a, b, _ in RULES) + " END"))
def g16(spark, d):
    lines = doc_lines(spark, d).select("doc_id", "line_no", "line")
    return entities.tag_candidates(lines, ["doc_id", "line_no"], "line", RULES, "regex", "v1")


_PHRASES = ("a city In Ruins and deserted", "now DESERTED; no longer a town", "unlocatable", "was destroyed", "no longer there", "stands", "stands, but Unlocated")
_GONE = " ".join(f"WHEN regexp_matches(s, '(?i){pattern}') THEN {{'reason': '{reason}', 'matched': regexp_extract(s, '(?i){pattern}')}}" for pattern, reason in GONE_PHRASES)


@query("G17_ordered_first_match", f"""WITH t AS (SELECT doc_id, text || ' ' || ['{"', '".join(_PHRASES)}'][doc_id % 7 + 1] AS s FROM documents)
SELECT doc_id, v.reason, v.matched FROM (SELECT doc_id, CASE {_GONE} WHEN regexp_matches(s, '(?i)\\bunlocat(able|ed)\\b') THEN {{'reason': 'unlocatable_without_survival_status', 'matched': 'unlocatable'}} ELSE {{'reason': 'mentioned_without_negative_status', 'matched': ''}} END AS v FROM t)""")
def g17(spark, d):
    # whole texts, each followed by a phrase, as invented texts hold none
    s = F.concat("text", F.lit(" "), F.element_at(F.array(*[F.lit(t) for t in _PHRASES]), (F.col("doc_id") % 7 + 1).cast("int")))
    v = table(spark, d, "documents").select("doc_id", status_from_text(s).alias("v"))
    return v.select("doc_id", "v.reason", "v.matched")


_CITE = """cite AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'Author ' || (o_custkey % 900 + 1) || ' BCE' WHEN 1 THEN (o_custkey % 9 + 1) || 'th century BC' WHEN 2 THEN (o_custkey % 3 + 1) || ' c. CE, copied 120 AD'
 WHEN 3 THEN 'Traveller, ' || (o_custkey % 300) || ' CE' WHEN 4 THEN 'undated' ELSE 'between 450 bce and 2nd century ad' END AS source FROM orders)"""


def citations(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = (
        F.when(k % 6 == 0, F.concat(F.lit("Author "), c % 900 + 1, F.lit(" BCE"))).when(k % 6 == 1, F.concat(c % 9 + 1, F.lit("th century BC")))
        .when(k % 6 == 2, F.concat(c % 3 + 1, F.lit(" c. CE, copied 120 AD"))).when(k % 6 == 3, F.concat(F.lit("Traveller, "), c % 300, F.lit(" CE")))
        .when(k % 6 == 4, "undated").otherwise("between 450 bce and 2nd century ad")
    )
    return table(spark, d, "orders").select(k.alias("id"), s.alias("source"))


_YEARS = _CITE + r""", years AS (SELECT id, source, CAST(list_max(
 list_transform(range(1, len(regexp_extract_all(source, '(?i)(\d{1,4})\s*(BCE|BC|CE|AD)\b', 1)) + 1), lambda i: CAST(regexp_extract_all(source, '(?i)(\d{1,4})\s*(BCE|BC|CE|AD)\b', 1)[i] AS INTEGER) * CASE WHEN upper(regexp_extract_all(source, '(?i)(\d{1,4})\s*(BCE|BC|CE|AD)\b', 2)[i]) LIKE 'B%' THEN -1 ELSE 1 END)
 || list_transform(range(1, len(regexp_extract_all(source, '(?i)(\d{1,2})(?:st|nd|rd|th)?\s*(?:c\.|century)\s*(BCE|BC|CE|AD)\b', 1)) + 1), lambda i: CASE WHEN upper(regexp_extract_all(source, '(?i)(\d{1,2})(?:st|nd|rd|th)?\s*(?:c\.|century)\s*(BCE|BC|CE|AD)\b', 2)[i]) LIKE 'B%' THEN -((CAST(regexp_extract_all(source, '(?i)(\d{1,2})(?:st|nd|rd|th)?\s*(?:c\.|century)\s*(BCE|BC|CE|AD)\b', 1)[i] AS INTEGER) - 1) * 100 + 1)
 ELSE CAST(regexp_extract_all(source, '(?i)(\d{1,2})(?:st|nd|rd|th)?\s*(?:c\.|century)\s*(BCE|BC|CE|AD)\b', 1)[i] AS INTEGER) * 100 END)) AS INTEGER) AS latest_year FROM cite)"""


@query("G18_latest_year", f"WITH {_YEARS} SELECT id, latest_year FROM years")
def g18(spark, d):
    return citations(spark, d).select("id", dates.latest_year(F.col("source")).alias("latest_year"))


@query("G19_evidence_filter", f"""WITH {_YEARS}, r AS (SELECT id, CASE WHEN contains(lower(source), 'traveller') THEN 'traveller_source' WHEN latest_year IS NULL THEN 'unknown_source_date' WHEN latest_year >= 150 THEN 'source_not_pre_traveller' END AS reason FROM years)
SELECT id, reason IS NULL AS usable, reason FROM r""")
def g19(spark, d):
    reason = dates.evidence_reason(F.col("source"), dates.latest_year(F.col("source")), ["traveller"], "traveller", 150)
    return citations(spark, d).select("id", reason.isNull().alias("usable"), reason.alias("reason"))


@query("G20_ids_from_urls", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN CAST(page_id AS VARCHAR) WHEN 1 THEN CAST(page_id AS VARCHAR) WHEN 2 THEN regexp_extract(regexp_extract(rtrim(url, '/'), '([^/#]*)$', 1), '^([A-Za-z0-9_.:-]{1,80})$', 1)
 WHEN 3 THEN NULL ELSE 'item_' || page_id END AS id FROM pages WHERE page_id % 5 <> 2 OR regexp_matches(regexp_extract(rtrim(url, '/'), '([^/#]*)$', 1), '^[A-Za-z0-9_.:-]{1,80}$')
UNION ALL SELECT page_id, NULL FROM pages WHERE page_id % 5 = 2 AND NOT regexp_matches(regexp_extract(rtrim(url, '/'), '([^/#]*)$', 1), '^[A-Za-z0-9_.:-]{1,80}$')""")
def g20(spark, d):
    p = F.col("page_id")
    v = F.when(p % 5 == 0, F.concat(F.lit("https://x.org/Objects/"), p)).when(p % 5 == 1, p.cast("string")).when(p % 5 == 2, F.col("url")).when(
        p % 5 == 3, F.lit("two words")).otherwise(F.concat(F.lit("item_"), p))
    return table(spark, d, "pages").select("page_id", entities.extract_id(v).alias("id"))


@query("G21_feature_maps", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax = 0 THEN '_' ELSE 'Case=' || l_returnflag || '|Number=' || l_linenumber || '|Tense=' || l_linestatus END AS canonical,
 CASE WHEN l_tax = 0 THEN NULL ELSE l_returnflag END AS case_value, CASE WHEN l_tax = 0 THEN NULL ELSE 'nmod:' || l_returnflag END AS second_rel FROM lineitem""")
def g21(spark, d):
    empty = F.col("l_tax") == 0
    raw = F.when(empty, "_").otherwise(F.concat(F.lit("Tense="), "l_linestatus", F.lit("|Number="), "l_linenumber", F.lit("|Case="), "l_returnflag"))
    deps = F.when(empty, "_").otherwise(F.concat(F.lit("2:nsubj|4:nmod:"), "l_returnflag"))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", tx.feats_canonical(raw).alias("canonical"), tx.feats_map(raw)["Case"].alias("case_value"),
        F.get(tx.deps_list(deps), F.lit(1))["deprel"].alias("second_rel"))


@query("G22_note_values", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status, '' AS absent FROM orders")
def g22(spark, d):
    note = F.concat(F.lit("customer="), "o_custkey", F.lit("; status= "), "o_orderstatus", F.lit(" ; end"))
    return table(spark, d, "orders").select("o_orderkey", *[tx.note_value(note, k).alias(k) for k in ("customer", "status", "absent")])


@query("G23_great_circle", f"""WITH {COORDS_SQL} SELECT place_id, round(2 * 6371.0088 * asin(sqrt(h)), 6) AS km, round(2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)), 6) AS km_round FROM
(SELECT place_id, pow(sin(radians(lat - 37.97) / 2), 2) + cos(radians(lat)) * cos(radians(37.97)) * pow(sin(radians(lon - 23.72) / 2), 2) AS h FROM coords)""")
def g23(spark, d):
    args = (F.lit(37.97), F.lit(23.72), F.col("lat"), F.col("lon"))
    return coords(spark, d).select("place_id", r6(numbers.haversine(*args)).alias("km"), r6(numbers.haversine_atan2(*args)).alias("km_round"))


@query("G24_entropy_and_cosine", """WITH p AS (SELECT l_suppkey, l_returnflag || l_linestatus AS action, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT action, sum(n) AS n FROM p GROUP BY ALL),
e AS (SELECT l_suppkey, -sum(s * log2(s)) AS entropy FROM (SELECT l_suppkey, n / sum(n) OVER (PARTITION BY l_suppkey) AS s FROM p) GROUP BY ALL)
SELECT p.l_suppkey, round(any_value(e.entropy), 6) AS entropy, round(sum(p.n * t.n) / (sqrt(sum(p.n * p.n)) * (SELECT sqrt(sum(n * n)) FROM t)), 6) AS cosine FROM p JOIN t USING (action) JOIN e ON e.l_suppkey = p.l_suppkey GROUP BY ALL""")
def g24(spark, d):
    from ..operators import profiles

    p = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("node"), F.concat("l_returnflag", "l_linestatus").alias("action")).agg(F.count("*").alias("n"))
    total = p.groupBy("action").agg(F.sum("n").alias("n"))
    ent = profiles.entropy(p, "node", "n")
    cos = profiles.cosine_to_reference(p, total, "node", "action", "n")
    return ent.join(cos, "node").select(F.col("node").alias("l_suppkey"), r6("entropy").alias("entropy"), r6("cosine").alias("cosine"))


@query("G25_jaccard", """WITH m AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), n AS (SELECT s, count(*) AS n FROM m GROUP BY ALL), x AS (SELECT a.s, count(*) AS k FROM m a JOIN m b ON b.s = a.s + 1 AND a.p = b.p GROUP BY ALL)
SELECT a.s AS l_suppkey, round(coalesce(k, 0) / (a.n + b.n - coalesce(k, 0)), 6) AS jaccard FROM n a JOIN n b ON b.s = a.s + 1 LEFT JOIN x ON x.s = a.s""")
def g25(spark, d):
    from ..operators import profiles

    m = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("item")).distinct()
    pairs = m.select(F.col("node").alias("a"), (F.col("node") + 1).alias("b")).distinct()
    return profiles.jaccard(m, pairs).select(F.col("a").alias("l_suppkey"), r6("jaccard").alias("jaccard"))


@query("G26_canonical_actions", """SELECT relation, action, count(*) AS n FROM (SELECT event_id % 5 AS r FROM events) JOIN (VALUES (0, 'Founded By', 'foundation'), (1, 'Ruler--of', 'rule'), (2, 'ruled by', 'rule'), (3, 'near', NULL), (4, 'Place of birth of', 'birth_at')) v(r, relation, action) USING (r) GROUP BY ALL""")
def g26(spark, d):
    names_ = F.array(*[F.lit(x) for x in ("Founded By", "Ruler--of", "ruled by", "near", "Place of birth of")])
    rel = F.element_at(names_, (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select(rel.alias("relation")).groupBy("relation", entities.action_of(F.col("relation")).alias("action")).agg(F.count("*").alias("n"))


@query("G27_edge_ids", "SELECT l_orderkey, l_linenumber, l_partkey, sha1(concat_ws(':', 'lineitem', l_linenumber, l_orderkey, l_suppkey, l_returnflag)) AS edge_id FROM lineitem")
def g27(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", entities.edge_id(F.lit("lineitem"), "l_linenumber", "l_orderkey", "l_suppkey", "l_returnflag").alias("edge_id"))


@query("G28_length_bins", r"WITH " + LINES_SQL + r""" SELECT CAST(least(40, len(regexp_extract_all(line, '[\p{L}\p{N}_]+')) // 5 * 5) AS INTEGER) AS length_bin, count(*) AS n FROM lines GROUP BY ALL""")
def g28(spark, d):
    return doc_lines(spark, d).groupBy(numbers.length_bin(tx.count_words("line")).alias("length_bin")).agg(F.count("*").alias("n"))


@query("G29_display_weights", """WITH c AS (SELECT c_custkey, c_acctbal AS v, c_acctbal >= 0 AS s FROM customer), r AS (SELECT s, min(abs(v)) AS lo, max(abs(v)) AS hi FROM c GROUP BY ALL)
SELECT c_custkey, round(0.3::DOUBLE + (abs(v) - lo) / (hi - lo) * 0.7::DOUBLE, 6) AS intensity FROM c JOIN r USING (s)""")
def g29(spark, d):
    return terms.intensity(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", r6("intensity").alias("intensity"))
