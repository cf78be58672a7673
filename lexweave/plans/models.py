"""H6–H21: models, splits, metrics and their reports."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import many_fits, models, stats, style, terms
from ..session import cut, written
from ..sources.tables import table
from .base import BUCKET_SQL, TOKENS_SQL, doc_lines, doc_terms, doc_words, documents, labelled, r6, tokens
from .hypothesis import pairs
from .registry import query
from .scalars import STOP, lemma_table
from .style import source_counts
from .texts import class_totals, labelled_words

MAX_FEATURES = 500


def labelled_docs(spark, d, col="quality"):
    """One row per labelled document: unit, book, tokens, 0/1 label."""
    docs = doc_words(spark, d, "book").withColumnRenamed("doc_id", "unit")
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("unit"), F.col(col).alias("label"))
    return cut(docs.join(lab, "unit"))


def reals(df, *cols, places=6):
    return df.select(*[r6(c, places).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("H6_text_classifier_terms")
def h6(spark, d):
    m = models.fit_text_model(labelled_docs(spark, d), MAX_FEATURES)
    return reals(models.head_and_tail(m.coefficients(spark), 30), "idf", "coefficient", "points")


@query("H6_class_metrics")
def h6b(spark, d):
    s = cut(models.holdout(labelled_docs(spark, d), ["unit"], "label", 0.25, "42"))
    m = models.fit_text_model(s.where("NOT is_test"), MAX_FEATURES)
    return models.binary_metrics(m.predict(s.where("is_test")), "label", "predicted")


@query("H7_points_model")
def h7(spark, d):
    docs = labelled_docs(spark, d)
    freq = terms.class_frequencies(docs, "toks", "label")
    totals = docs.agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    keep = terms.association_q(freq, totals).where("q_value < 0.1").orderBy("q_value", "term")
    m = models.fit_text_model(docs, vocabulary=[r["term"] for r in keep.select("term").collect()], binary=True, normalize=False)
    if not m.available:
        return models.guard(docs, "label", 20, 5).select("status", "reason")
    return reals(m.coefficients(spark), "idf", "coefficient", "points").withColumn("threshold", F.lit(-m.intercept))


@query("H7_point_scores", f"""WITH {TOKENS_SQL}, pts AS (SELECT term, round((len(term) - 6) / 8.0::DOUBLE, 6) AS points FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM benchmark)), s AS (SELECT doc_id, sum(points) AS score FROM (SELECT DISTINCT doc_id, term FROM tokens) JOIN pts USING (term) GROUP BY ALL)
SELECT documents.doc_id AS unit, round(coalesce(score, 0), 5) AS score, CAST(coalesce(score, 0) > 1.23 AS INTEGER) AS predicted FROM documents LEFT JOIN s ON s.doc_id = documents.doc_id""")
def h7b(spark, d):
    pts = table(spark, d, "benchmark").select(F.explode(tx.words("text")).alias("term")).distinct().withColumn("points", F.round((F.length("term") - 6) / F.lit(8.0), 6))
    docs = doc_words(spark, d).withColumnRenamed("doc_id", "unit")
    return models.point_scores(docs, pts, F.lit(1.23)).withColumn("score", r6("score", 5))


@query("H8_sentence_classifier_terms")
def h8(spark, d):
    lines = doc_lines(spark, d).select("doc_id", F.concat_ws(".", "doc_id", "line_no").alias("unit"), tx.words("line").alias("toks"))
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    m = models.fit_text_model(cut(lines.join(lab, "doc_id")), MAX_FEATURES)
    return reals(models.head_and_tail(m.coefficients(spark), 30), "idf", "coefficient", "points")


@query("H9_stratified_holdout", "SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) <= ceil(count(*) OVER (PARTITION BY quality) * 0.25) AS is_test FROM labels")
def h9(spark, d):
    return models.holdout(table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"], "quality", 0.25, "42")


@query("H10_variant_grid")
def h10(spark, d):
    meta = documents(spark, d).select(F.col("doc_id").alias("unit"), "book").join(
        table(spark, d, "labels").select(F.col("doc_id").alias("unit"), F.col("quality").alias("label")), "unit")
    # only labelled documents' tokens meet the lemmas, and both lists of a document are made at once
    lem = terms.lemmatize(tokens(spark, d).join(meta.select(F.col("unit").alias("doc_id")), "doc_id", "left_semi"), lemma_table(spark, d))
    lists = written(lem.groupBy(F.col("doc_id").alias("unit")).agg(F.array_sort(F.collect_list(F.struct("pos", "term", "lemma"))).alias("t")).select(
        "unit", F.col("t.term").alias("term"), F.col("t.lemma").alias("lemma")))
    # four token lists of every document, two splits of the documents
    texts, members, tests = [], [], []
    splits = {wide: cut(models.holdout(meta if wide else meta.where(~F.col("book").isin(4, 8)), ["unit"], "label", 0.25, "42")) for wide in (True, False)}
    for source, col in (("surface", "term"), ("lemma", "lemma")):
        plain = lists.select("unit", F.col(col).alias("toks"))
        for extra in (False, True):
            own = F.concat_ws("|", F.lit(source), F.lit(extra), "unit")
            texts.append(plain.select(own.alias("unit"), (terms.drop_stopwords(F.col("toks"), STOP) if extra else F.col("toks")).alias("toks")))
            for wide, split in splits.items():
                model = F.concat_ws("|", F.lit(source), F.lit(wide), F.lit(extra)).alias("model")
                members.append(split.where("NOT is_test").select(model, own.alias("unit"), "label"))
                tests.append(split.where("is_test").select(model, own.alias("unit"), "label"))
    docs, members, tests = (functools.reduce(DataFrame.unionByName, x) for x in (texts, members, tests))
    # documents without any token have no row in ``docs`` and belong to no model
    fits = many_fits.fit_many(docs, members.join(docs.select("unit"), "unit"), MAX_FEATURES)
    tests = tests.join(docs.select("unit"), "unit")
    row = models.binary_metrics(fits.predict(docs, tests).join(tests, ["model", "unit"]), "label", "predicted", ["model"]).join(fits.coefficients.groupBy("model").agg(F.count("*").cast("int").alias("features")), "model")
    part = F.split("model", r"\|")
    return row.select(part[0].alias("token_source"), part[1].cast("boolean").alias("all_books"), part[2].cast("boolean").alias("extra_stopwords"), "features", "n", "accuracy", "balanced_accuracy", "macro_f1")


@query("H11_term_field_ablation")
def h11(spark, d):
    s = cut(models.holdout(labelled_docs(spark, d), ["unit"], "label", 0.25, "42"))
    fields = {"none": (), "articles": ("the", "la", "die", "der", "le", "les", "el", "los"), "joining": ("and", "et", "und", "de", "of")}
    out = None
    for name, words in fields.items():
        docs = s.withColumn("toks", terms.drop_stopwords(F.col("toks"), words))
        m = models.fit_text_model(docs.where("NOT is_test"), MAX_FEATURES)
        row = models.binary_metrics(m.predict(docs.where("is_test")), "label", "predicted").select(F.lit(name).alias("removed"), "n", "accuracy")
        out = row if out is None else out.unionByName(row)
    base = out.where("removed = 'none'").select("accuracy").scalar()
    return out.withColumn("delta", F.col("accuracy") - base)


@query("H12_leave_one_group_out")
def h12(spark, d):
    docs = labelled_docs(spark, d).withColumn("group", F.col("book"))
    pred, _ = models.leave_group_out(docs, "group", max_features=MAX_FEATURES)
    return models.binary_metrics(pred, "label", "predicted", ["group"]).select("group", "n", "tp", "fp", "fn", "tn", "accuracy", "majority_accuracy", (F.col("accuracy") - F.col("majority_accuracy")).alias("delta"))


@query("H12_group_summary", """WITH p AS (SELECT l_suppkey % 7 AS g, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS a, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS b FROM lineitem), m AS (SELECT g, count(*) AS n, count(*) FILTER (WHERE a = b) AS ok FROM p GROUP BY ALL)
SELECT count(*) AS groups, round(sum(ok) / sum(n), 6) AS weighted_accuracy, round(avg(ok / n), 6) AS macro_accuracy, CAST(sum(n) AS BIGINT) AS total_test FROM m""")
def h12b(spark, d):
    p = table(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("g"), (F.col("l_returnflag") == "R").cast("int").alias("a"), (F.col("l_linestatus") == "O").cast("int").alias("b"))
    return reals(models.group_metrics_summary(models.binary_metrics(p, "a", "b", ["g"])), "weighted_accuracy", "macro_accuracy")


@query("H13_error_listing")
def h13(spark, d):
    s = cut(models.holdout(labelled_docs(spark, d), ["unit"], "label", 0.25, "42"))
    m = models.fit_text_model(s.where("NOT is_test"), MAX_FEATURES)
    p = m.predict(s.where("is_test")).drop("toks")
    conf = F.when(F.col("predicted") == 1, F.col("p1")).otherwise(1 - F.col("p1"))
    errors = p.where("label <> predicted").withColumn("confidence", conf)
    return errors.orderBy(F.desc("confidence"), F.desc("unit")).limit(20).select("unit", "label", "predicted", r6("confidence").alias("confidence"))


@query("H13_top_contributions", f"""WITH {TOKENS_SQL}, w AS (SELECT doc_id AS unit, term, CAST(count(*) AS DOUBLE) AS weight FROM tokens GROUP BY ALL), c AS (SELECT term, (len(term) - 6) / 8.0::DOUBLE AS coefficient FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM benchmark)),
x AS (SELECT unit, term, weight * coefficient AS v, CASE WHEN unit % 2 = 1 THEN weight * coefficient > 0 ELSE weight * coefficient < 0 END AS side FROM w JOIN c USING (term)), y AS (SELECT *, max(side) OVER (PARTITION BY unit) AS has FROM x)
SELECT unit, rn, term, round(v, 6) AS contribution FROM (SELECT *, CAST(row_number() OVER (PARTITION BY unit ORDER BY abs(v) DESC, term) AS INTEGER) AS rn FROM y WHERE side OR NOT has) WHERE rn <= 8""")
def h13b(spark, d):
    w = doc_terms(spark, d).select(F.col("doc_id").alias("unit"), "term", F.col("tf").cast("double").alias("weight"))
    coefs = table(spark, d, "benchmark").select(F.explode(tx.words("text")).alias("term")).distinct().withColumn("coefficient", (F.length("term") - 6) / F.lit(8.0))
    pred = table(spark, d, "documents").select(F.col("doc_id").alias("unit"), (F.col("doc_id") % 2).cast("int").alias("predicted"))
    return reals(models.contributions(w, coefs, pred, 8), "contribution")


@query("H14_label_scenarios")
def h14(spark, d):
    docs = labelled_docs(spark, d)
    other = table(spark, d, "labels").select(F.col("doc_id").alias("unit"), (1 - F.col("toxic")).alias("b"))
    both = cut(docs.join(other, "unit"))
    agree = F.col("label") == F.col("b")
    scenarios = {
        "labeler_a": (both, None), "labeler_b": (both.withColumn("label", F.col("b")), None), "agreement": (both.where(agree), None),
        "down_weighted": (both.withColumn("w", F.when(agree, 1.0).otherwise(0.35)), "w")}
    out = None
    for name, (df, weight) in scenarios.items():
        m = models.fit_text_model(df, MAX_FEATURES, weight=weight)
        if m.available:
            c = m.coefficients(spark).select(F.lit(name).alias("scenario"), "term", r6("coefficient").alias("coefficient"))
            out = c if out is None else out.unionByName(c)
    return out


@query("H15_coefficient_stability", """WITH c AS (SELECT l_returnflag || l_linestatus AS scenario, p_name AS term, avg(l_discount) - 0.05 AS coefficient FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), b AS (SELECT term FROM c WHERE scenario = 'AF' ORDER BY round(abs(coefficient), 12) DESC, term LIMIT 12)
SELECT term, round(max(coefficient) FILTER (WHERE scenario = 'AF'), 6) AS baseline, count(*) AS present, round(min(coefficient), 6) AS lowest, round(max(coefficient), 6) AS highest, count(*) FILTER (WHERE coefficient > 1e-12) = 0 OR count(*) FILTER (WHERE coefficient < -1e-12) = 0 AS sign_stable FROM c WHERE term IN (SELECT term FROM b) GROUP BY term""")
def h15(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("term"))
    c = table(spark, d, "lineitem").join(p, "l_partkey").groupBy(F.concat("l_returnflag", "l_linestatus").alias("scenario"), "term").agg((F.avg("l_discount") - 0.05).alias("coefficient"))
    return reals(models.stability(c, "AF", 12), "baseline", "lowest", "highest")


_JOINT = f"j AS (SELECT doc_id AS unit, {BUCKET_SQL} AS observed, CASE WHEN doc_id % 5 = 0 THEN 'mixed' WHEN doc_id % 3 = 0 THEN 'historical' WHEN doc_id % 7 = 0 THEN 'other' ELSE 'mythic' END AS manual FROM labels)"


def joint(spark, d):
    i = F.col("doc_id")
    return labelled(spark, d).select(i.alias("unit"), F.col("bucket").alias("observed"), F.when(i % 5 == 0, "mixed").when(i % 3 == 0, "historical").when(i % 7 == 0, "other").otherwise("mythic").alias("manual"))


@query("H16_label_noise_draws", f"""WITH {_JOINT}, p AS (SELECT observed, sum(CASE manual WHEN 'historical' THEN 1 WHEN 'mixed' THEN 0.5 ELSE 0 END)::DOUBLE AS h, sum(CASE manual WHEN 'mythic' THEN 1 WHEN 'mixed' THEN 0.5 ELSE 0 END)::DOUBLE AS m, sum(CASE manual WHEN 'other' THEN 1 ELSE 0 END)::DOUBLE AS o FROM j GROUP BY ALL),
u AS (SELECT unit, CAST(run AS INTEGER) AS run, h, m, CAST('0x' || substr(md5('noise|' || unit || '|' || run), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * (h + m + o) AS u FROM j JOIN p USING (observed), range(30) r(run)) SELECT unit, run, CASE WHEN u < h THEN 'historical' WHEN u < h + m THEN 'mythic' ELSE 'other' END AS label FROM u""")
def h16(spark, d):
    j = joint(spark, d)
    return models.noisy_labels(j.select("unit", "observed"), j.select("observed", "manual"), ("historical", "mythic", "other"), 30, "noise")


@query("H16_label_noise_models")
def h16b(spark, d):
    j = joint(spark, d)
    draws = cut(models.noisy_labels(j.select("unit", "observed"), j.select("observed", "manual"), ("historical", "mythic", "other"), 30, "noise"))
    docs = labelled_docs(spark, d).drop("label")

    members = draws.where("label <> 'other'").select(F.col("run").cast("string").alias("model"), "unit", (F.col("label") == "mythic").cast("int").alias("label")).join(docs.select("unit"), "unit")
    out = many_fits.fit_many(docs, members, MAX_FEATURES).coefficients
    v = F.col("coefficient")
    return out.groupBy("term").agg(
        F.count("*").alias("present"), F.count_if(v > 0).alias("positive"), F.count_if(v < 0).alias("negative"), r6(F.avg(v)).alias("mean"), r6(F.min(v)).alias("lowest"), r6(F.max(v)).alias("highest"),
        (F.greatest(F.count_if(v > 0), F.count_if(v < 0)) / F.count("*")).alias("sign_stability"))


@query("H17_fold_assignment", "SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5('k5|' || doc_id), doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels")
def h17(spark, d):
    return models.folds(table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"], "quality", 5, "k5")


_M = "count(*) FILTER (WHERE a = 1 AND b = 1) AS tp, count(*) FILTER (WHERE a = 0 AND b = 1) AS fp, count(*) FILTER (WHERE a = 1 AND b = 0) AS fn, count(*) FILTER (WHERE a = 0 AND b = 0) AS tn"


@query("H17_pooled_metrics", f"""WITH p AS (SELECT quality AS a, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS b FROM documents JOIN labels USING (doc_id)), c AS (SELECT count(*) AS n, {_M} FROM p)
SELECT n, tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy, round(greatest(tp + fn, fp + tn) / n, 6) AS majority_accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(tp / (tp + fp), 6) AS precision_1, round(tp / (tp + fn), 6) AS recall_1, round(2 * tp / (2 * tp + fp + fn), 6) AS f1_1, round(tn / (tn + fn), 6) AS precision_0, round(tn / (tn + fp), 6) AS recall_0, round(2 * tn / (2 * tn + fp + fn), 6) AS f1_0,
 round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS macro_f1, round((2 * tp / (2 * tp + fp + fn) * (tp + fn) + 2 * tn / (2 * tn + fp + fn) * (tn + fp)) / n, 6) AS weighted_f1 FROM c""")
def h17b(spark, d):
    p = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("quality").alias("a"), (F.col("n_chars") > 300).cast("int").alias("b"))
    out = models.binary_metrics(p, "a", "b")
    return reals(out, *[c for c in out.columns if c not in ("n", "tp", "fp", "fn", "tn")])


@query("H17_cross_validated_model")
def h17c(spark, d):
    docs = cut(models.folds(labelled_docs(spark, d), ["unit"], "label", 3, "k3"))
    members = docs.select(F.explode(F.array(*map(F.lit, "012"))).alias("model"), "unit", "label", "fold").where("model <> string(fold)").drop("fold")
    fits = many_fits.fit_many(docs, members, MAX_FEATURES)
    out = fits.predict(docs, docs.select(F.col("fold").cast("string").alias("model"), "unit")).join(docs.select("unit", "label"), "unit")
    return models.binary_metrics(out, "label", "predicted")


@query("H18_task_labels", f"""WITH b AS (SELECT doc_id, {BUCKET_SQL} AS b FROM labels) SELECT doc_id, 'three_way' AS task, b AS label FROM b WHERE b <> 'both' UNION ALL SELECT doc_id, 'mythic_vs_historical', CASE b WHEN 'mythic' THEN '1' ELSE '0' END FROM b WHERE b IN ('mythic', 'historical')
UNION ALL SELECT doc_id, 'historical_vs_all', CASE WHEN b IN ('historical', 'both') THEN '1' ELSE '0' END FROM b UNION ALL SELECT doc_id, 'mythic_vs_all', CASE WHEN b IN ('mythic', 'both') THEN '1' ELSE '0' END FROM b""")
def h18(spark, d):
    return models.task_labels(labelled(spark, d).select("doc_id", "bucket"), "bucket")


def book_rows(spark, d, p=40):
    """Documents as relative-frequency vectors with their book number and fold."""
    counts = doc_terms(spark, d).select(F.col("doc_id").alias("unit"), F.col("term").alias("feature"), F.col("tf").alias("n"))
    sel = style.select_features(counts, p, 2)
    names = [r["feature"] for r in sel.orderBy("feature").collect()]
    rel = style.relative_frequencies(counts, sel)
    x = rel.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("feature", "v"))).alias("m"))
    arr = F.transform(F.array(*[F.lit(n) for n in names]), lambda t: F.coalesce(F.col("m")[t], F.lit(0.0)))
    docs = documents(spark, d).select(F.col("doc_id").alias("id"), F.col("book").cast("double").alias("y"))
    rows = docs.join(x.withColumnRenamed("unit", "id"), "id", "left").withColumn("x", F.coalesce(arr, F.array_repeat(F.lit(0.0), len(names))))
    return cut(models.folds(rows.select("id", "y", "x").withColumn("all", F.lit(1)), ["id"], "all", 5, "ridge").drop("all")), names


@query("H19_ridge_alpha_grid")
def h19(spark, d):
    rows, names = book_rows(spark, d)
    pred, report = models.ridge_cv(rows, 5)
    return models.regression_metrics(pred).withColumn("alpha", F.lit(report["alpha"])).withColumn("features", F.lit(len(names)))


@query("H20_data_guard", f"""WITH c AS (SELECT {BUCKET_SQL} AS b, count(*) AS n FROM labels GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS classes, min(n) AS smallest, CASE WHEN min(n) < 50 THEN 'blocked' ELSE 'ready' END AS status, CASE WHEN min(n) < 50 THEN 'class too small' ELSE '' END AS reason FROM c""")
def h20(spark, d):
    return models.guard(labelled(spark, d), "bucket", 20, 50)


_RUNS = "runs AS (SELECT l_orderkey * 100 + l_linenumber AS run_id, p_name AS family, l_shipdate AS completed_at, CAST(l_suppkey % 4 AS INTEGER) AS sample_count, CAST(p_size % 3 AS INTEGER) AS positive_count, max(l_discount * 10 + l_tax) AS balanced_accuracy FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"


@query("H21_comparable_runs", f"""WITH {_RUNS}, a AS (SELECT sample_count, positive_count FROM runs WHERE family = 'blue bolt' ORDER BY completed_at DESC, run_id DESC LIMIT 1), c AS (SELECT runs.* FROM runs JOIN a USING (sample_count, positive_count)),
l AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY completed_at DESC, run_id DESC, balanced_accuracy DESC) AS rn FROM c) SELECT family, completed_at, run_id, sample_count, positive_count, balanced_accuracy, run_id = (SELECT arg_max(run_id, (balanced_accuracy, run_id)) FROM l WHERE rn = 1) AS is_best FROM l WHERE rn = 1""")
def h21(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("family"), "p_size")
    runs = table(spark, d, "lineitem").join(p, "l_partkey").groupBy(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("run_id"), "family", F.col("l_shipdate").alias("completed_at"),
        (F.col("l_suppkey") % 4).cast("int").alias("sample_count"), (F.col("p_size") % 3).cast("int").alias("positive_count")).agg(F.max(F.col("l_discount") * 10 + F.col("l_tax")).alias("balanced_accuracy"))
    return models.comparable_runs(runs, "blue bolt")


@query("I2_residual_ridge")
def i2_ridge(spark, d):
    res = stats.residuals(pairs(spark, d), "x", "y").select(F.concat_ws(".", "conv_id", "turn").alias("unit"), tx.words("text").alias("toks"), F.col("residual").alias("y"))
    res = cut(res)
    dt = res.select(F.col("unit").alias("doc_id"), F.explode("toks").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    vocab = terms.features(dt, 2, 300).orderBy("term").collect()
    n = res.count()
    coefs, _ = models.ridge_text(res, 10.0, [r["term"] for r in vocab], [math.log((1 + n) / (1 + r["df"])) + 1 for r in vocab])
    return coefs.select("term", r6("coefficient", 5).alias("coefficient"))
