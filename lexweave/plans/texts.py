"""H1–H5: TF-IDF, class frequencies and term-label association."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import terms
from ..sources.tables import table
from .base import DOC_TERMS_SQL, doc_terms, doc_words, r6
from .registry import query

MIN_DF, TOP = 3, 2000


def n_docs(spark, d):
    return table(spark, d, "documents").agg(F.count("*")).scalar()


@query("H1_tfidf", f"""WITH {DOC_TERMS_SQL}, v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM doc_terms GROUP BY ALL HAVING count(*) >= {MIN_DF} ORDER BY total DESC, term LIMIT {TOP}),
w AS (SELECT doc_id, doc_terms.term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM doc_terms JOIN v ON v.term = doc_terms.term)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def h1(spark, d):
    dt = doc_terms(spark, d)
    vocab = terms.features(dt, MIN_DF, TOP)
    return terms.tfidf(dt, vocab, n_docs(spark, d)).select("doc_id", "term", r6("weight").alias("weight"))


@query("H2_binary_tfidf", f"""WITH {DOC_TERMS_SQL}, v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM doc_terms GROUP BY ALL HAVING count(*) >= {MIN_DF} ORDER BY total DESC, term LIMIT {TOP})
SELECT doc_id, doc_terms.term, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1, 6) AS weight FROM doc_terms JOIN v ON v.term = doc_terms.term""")
def h2(spark, d):
    dt = doc_terms(spark, d)
    vocab = terms.features(dt, MIN_DF, TOP)
    return terms.tfidf(dt, vocab, n_docs(spark, d), binary=True, normalize=False).select("doc_id", "term", r6("weight").alias("weight"))


_FREQ = r"""cf AS (SELECT term, count(*) FILTER (WHERE quality = 1) AS pos, count(*) FILTER (WHERE quality = 0) AS neg FROM
 (SELECT quality, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'))) AS term FROM documents JOIN labels USING (doc_id)) GROUP BY ALL)"""
_TOTALS = "t AS (SELECT count(*) FILTER (WHERE quality = 1) AS tp, count(*) FILTER (WHERE quality = 0) AS tn FROM documents JOIN labels USING (doc_id))"
_XLX = lambda x: f"(CASE WHEN {x} > 0 THEN {x} * ln({x}) ELSE 0 END)"
_G2 = "2 * (" + " + ".join(_XLX(x) for x in ("pos", "neg", "(tp - pos)", "(tn - neg)")) + " - " + " - ".join(_XLX(x) for x in ("tp", "tn", "(pos + neg)", "(tp + tn - pos - neg)")) + " + " + _XLX("(tp + tn)") + ")"
_LP = "(lgamma(pos + neg + 1) + lgamma(tp + tn - pos - neg + 1) + lgamma(tp + 1) + lgamma(tn + 1) - lgamma(tp + tn + 1) - lgamma({k} + 1) - lgamma(pos + neg - {k} + 1) - lgamma(tp - {k} + 1) - lgamma(tn - pos - neg + {k} + 1))"
_FISHER = f"list_sum(list_transform(range(greatest(0, pos + neg - tn), least(tp, pos + neg) + 1), lambda k: CASE WHEN {_LP.format(k='k')} <= {_LP.format(k='pos')} + 1e-7 THEN exp({_LP.format(k='k')}) ELSE 0 END))"
# erfc(sqrt(g/2)) as a smooth integral over an angle, midpoint rule
_CHI2 = "list_sum(list_transform(range(400), lambda i: exp(-g2 / 2 / pow(sin((i + 0.5) * pi() / 800), 2)))) / 400"
ASSOC_SQL = f"""{_FREQ}, {_TOTALS}, g AS (SELECT cf.*, tp, tn, greatest(0, {_G2}) AS g2 FROM cf, t),
a AS (SELECT DISTINCT pos, neg, tp, tn, g2 FROM g), ap AS (SELECT pos, neg, CASE WHEN pos < 5 OR neg < 5 OR tp - pos < 5 OR tn - neg < 5 THEN least(1.0, {_FISHER}) ELSE {_CHI2} END AS p FROM a),
p AS (SELECT g.term, g.pos, g.neg, g2, p FROM g JOIN ap ON ap.pos = g.pos AND ap.neg = g.neg)"""


def labelled_words(spark, d):
    return doc_words(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


def class_totals(spark, d):
    # sizes of the classes among labelled documents that exist
    lab = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return lab.agg(F.count_if(F.col("quality") == 1).alias("pos"), F.count_if(F.col("quality") == 0).alias("neg"))


@query("H3_class_document_frequency", f"WITH {_FREQ} SELECT * FROM cf")
def h3(spark, d):
    return terms.class_frequencies(labelled_words(spark, d), "toks", "quality")


@query("H4_term_class_test", f"WITH {ASSOC_SQL} SELECT term, pos, neg, round(g2, 6) AS g2, round(p, 6) AS p_value FROM p")
def h4(spark, d):
    freq = terms.class_frequencies(labelled_words(spark, d), "toks", "quality")
    cells = terms.association(freq.groupBy("pos", "neg").agg(F.count("*").alias("n")), class_totals(spark, d))
    return freq.join(cells.drop("n"), ["pos", "neg"]).select("term", "pos", "neg", r6("g2").alias("g2"), r6("p_value").alias("p_value"))


@query("H5_term_label_q_values", f"""WITH {ASSOC_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY p, term) AS i, count(*) OVER () AS n FROM p)
SELECT term, pos, neg, round(g2, 6) AS g2, round(p, 6) AS p_value, round(least(1.0, min(p * n / i) OVER (ORDER BY p DESC, term DESC ROWS UNBOUNDED PRECEDING)), 6) AS q_value FROM r""")
def h5(spark, d):
    freq = terms.class_frequencies(labelled_words(spark, d), "toks", "quality")
    out = terms.association_q(freq, class_totals(spark, d))
    return out.select("term", "pos", "neg", r6("g2").alias("g2"), r6("p_value").alias("p_value"), r6("q_value").alias("q_value"))
