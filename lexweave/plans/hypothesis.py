"""I: regressions and hypothesis tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.special import chi2_sf, f_sf, t_two_sided
from ..operators import permute, stats, summaries
from ..operators.scan import quantiles
from ..sources.tables import table
from .aggregates import BUCKETS, bucket_docs
from .base import BUCKET_SQL, LINES_SQL, doc_lines, documents, r6
from .registry import query

# Tail probabilities in SQL.  Chi-square: the finite sum for whole degrees of
# freedom, odd ones starting from an angle integral.  t and F: Simpson's rule on
# the beta integral over an angle.
def chi2_sql(x: str, k: str) -> str:
    angle = f"list_sum(list_transform(range(2000), lambda i: exp(-({x}) / 2 / pow(sin((i + 0.5) * pi() / 4000), 2)))) / 2000"
    return f"(CASE WHEN {k} % 2 = 1 THEN {angle} ELSE 0 END + coalesce(list_sum(list_transform(range(CAST(({k}) // 2 AS BIGINT)), lambda j: exp(-({x}) / 2 + (j + ({k}) % 2 / 2.0) * ln(({x}) / 2) - lgamma(j + ({k}) % 2 / 2.0 + 1)))), 0))"


def beta_sql(a: str, b: str, x: str, steps: int = 20000) -> str:
    t = f"(asin(sqrt({x})) * i / {steps})"
    f = f"exp((2 * ({a}) - 1) * ln(greatest(sin({t}), 1e-300)) + (2 * ({b}) - 1) * ln(cos({t})) - lgamma({a}) - lgamma({b}) + lgamma(({a}) + ({b})))"
    w = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(list_sum(list_transform(range({steps + 1}), lambda i: {w} * {f})) * 2 * asin(sqrt({x})) / {steps} / 3)"


def t_sql(t: str, v: str) -> str:
    return beta_sql(f"({v}) / 2.0", "0.5", f"({v}) / (({v}) + pow({t}, 2))")


def f_sql(f: str, d1: str, d2: str) -> str:
    return beta_sql(f"({d2}) / 2.0", f"({d1}) / 2.0", f"({d2}) / (({d2}) + ({d1}) * ({f}))")


# Parallel lengths: a user turn and the reply that follows it.
_PAIRS = r"""turns AS (SELECT conv_id, turn, role, text, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS DOUBLE) AS n FROM conversations),
pl AS (SELECT a.conv_id, a.turn, a.text, a.n AS x, b.n AS y, CAST((a.conv_id % 3) AS INTEGER) AS bucket FROM turns a JOIN turns b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""


def pairs(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", tx.count_words("text").cast("double").alias("n"))
    a = t.where("role = 'user'").select("conv_id", "turn", "text", F.col("n").alias("x"))
    b = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("n").alias("y"))
    return a.join(b, ["conv_id", "turn"]).withColumn("bucket", (F.col("conv_id") % 3).cast("int"))


_OLS = """regr_count(y, x) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx, regr_avgx(y, x) AS mx,
 (regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (regr_count(y, x) - 2) AS v"""


@query("I1_length_model", f"WITH {_PAIRS} SELECT CAST(n AS BIGINT) AS n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, round(sqrt(v / sxx), 6) AS slope_se, round(sqrt(v * (1.0 / n + mx * mx / sxx)), 6) AS intercept_se, round({t_sql("slope / sqrt(v / sxx)", "n - 2")}, 6) AS p_slope, round({t_sql("intercept / sqrt(v * (1.0 / n + mx * mx / sxx))", "n - 2")}, 6) AS p_intercept FROM (SELECT {_OLS} FROM pl)")
def i1(spark, d):
    fit = stats.ols(pairs(spark, d), "x", "y")
    tails = [r6(t_two_sided(F.col(c) / F.col(f"{c}_se"), F.col("n") - 2)).alias(f"p_{c}") for c in ("slope", "intercept")]
    return fit.select("n", *[r6(c).alias(c) for c in ("slope", "intercept", "r2", "slope_se", "intercept_se")], *tails)


@query("I1_length_residuals", f"WITH {_PAIRS}, f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM pl) SELECT conv_id, turn, round(y - i - s * x, 6) AS residual FROM pl, f")
def i1b(spark, d):
    return stats.residuals(pairs(spark, d), "x", "y").select("conv_id", "turn", r6("residual").alias("residual"))


@query("I2_residual_by_term", f"""WITH {_PAIRS}, f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM pl), r AS (SELECT text, y - i - s * x AS e FROM pl, f),
t AS (SELECT e, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'))) AS term FROM r)
SELECT term, count(*) AS n, round(avg(e), 5) AS mean_with, round(((SELECT sum(e) FROM r) - sum(e)) / ((SELECT count(*) FROM r) - count(*)), 5) AS mean_without FROM t GROUP BY ALL HAVING count(*) >= 2""")
def i2(spark, d):
    res = stats.residuals(pairs(spark, d), "x", "y")
    total = res.agg(F.struct(F.sum("residual").alias("s"), F.count("*").alias("n")).alias("t")).scalar()
    by = res.select("residual", F.explode(F.array_distinct(tx.words("text"))).alias("term")).groupBy("term").agg(
        F.count("*").alias("n"), F.sum("residual").alias("s")).where("n >= 2")
    return by.select("term", "n", r6(F.col("s") / F.col("n"), 5).alias("mean_with"), r6((total["s"] - F.col("s")) / (total["n"] - F.col("n")), 5).alias("mean_without"))


@query("I3_extreme_residuals", f"""WITH {_PAIRS}, f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM pl), r AS (SELECT conv_id, turn, round(y - i - s * x, 6) AS residual FROM pl, f)
SELECT * FROM (SELECT 'longest' AS side, * FROM r ORDER BY residual DESC, conv_id, turn LIMIT 10) UNION ALL SELECT * FROM (SELECT 'shortest' AS side, * FROM r ORDER BY residual, conv_id, turn LIMIT 10)""")
def i3(spark, d):
    r = stats.residuals(pairs(spark, d), "x", "y").select("conv_id", "turn", r6("residual").alias("residual"))
    top = r.orderBy(F.desc("residual"), "conv_id", "turn").limit(10).withColumn("side", F.lit("longest"))
    return top.unionByName(r.orderBy("residual", "conv_id", "turn").limit(10).withColumn("side", F.lit("shortest")))


@query("I4_bucket_length_summary", f"""WITH {_PAIRS}, f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM pl), r AS (SELECT *, y - i - s * x AS e FROM pl, f)
SELECT bucket, count(*) AS n, round(avg(x), 6) AS mean_source, round(avg(y), 6) AS mean_target, round(avg(e), 6) AS mean_residual, round(median(e), 6) AS median_residual, round(regr_slope(y, x), 6) AS slope FROM r GROUP BY ALL""")
def i4(spark, d):
    r = stats.residuals(pairs(spark, d), "x", "y")
    base = r.groupBy("bucket").agg(
        F.count("*").alias("n"), r6(F.avg("x")).alias("mean_source"), r6(F.avg("y")).alias("mean_target"),
        r6(F.avg("residual")).alias("mean_residual"), r6(F.regr_slope("y", "x")).alias("slope"))
    return base.join(quantiles(r, ["bucket"], "residual", {"m": 0.5}).select("bucket", r6("m").alias("median_residual")), "bucket")


@query("I5_correlations", f"""WITH {_PAIRS}, r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM pl)
, c AS (SELECT count(*) AS n, corr(x, y) AS a, corr(rx, ry) AS b FROM r)
SELECT n, round(a, 6) AS pearson, round(b, 6) AS spearman, round({t_sql("a * sqrt((n - 2) / (1 - a * a))", "n - 2")}, 6) AS p_pearson, round({t_sql("b * sqrt((n - 2) / (1 - b * b))", "n - 2")}, 6) AS p_spearman FROM c""")
def i5(spark, d):
    p = pairs(spark, d).select("x", "y")
    s = stats.spearman(p, "x", "y")
    s = s.withColumn("pearson", p.agg(F.corr("x", "y")).scalar())
    tail = lambda r: t_two_sided(F.col(r) * F.sqrt((F.col("n") - 2) / (1 - F.col(r) * F.col(r))), F.col("n") - 2)
    return s.select("n", *[r6(c).alias(c) for c in ("pearson", "spearman")], *[r6(tail(c)).alias(f"p_{c}") for c in ("pearson", "spearman")])


@query("I6_quadratic_fit", f"""WITH {_PAIRS}, m AS (SELECT avg(x) AS mx, avg(y) AS my, avg((x) * (x)) AS mxx FROM pl), c AS (SELECT x - mx AS a, (x * x) - mxx AS b, y - my AS v FROM pl, m),
s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * v) AS av, sum(b * v) AS bv, sum(v * v) AS vv, count(*) AS n FROM c)
SELECT n, round(((av * bb - bv * ab) / (aa * bb - ab * ab) * av + (bv * aa - av * ab) / (aa * bb - ab * ab) * bv) / vv, 6) AS r2 FROM s""")
def i6(spark, d):
    return stats.quadratic_r2(pairs(spark, d), "x", "y").select("n", r6("r2").alias("r2"))


_WLS = """(SELECT {g} count(*) AS n, sum(w) AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * x) AS wxx, sum(w * x * y) AS wxy, sum(w * y * y) AS wyy FROM {t} {gb})"""
_WOUT = """n, round((wxy - wx * wy / w) / (wxx - wx * wx / w), 6) AS slope, round((wy - (wxy - wx * wy / w) / (wxx - wx * wx / w) * wx) / w, 6) AS intercept,
 round(pow(wxy - wx * wy / w, 2) / ((wxx - wx * wx / w) * (wyy - wy * wy / w)), 6) AS r2, round(sqrt(((wyy - wy * wy / w) - pow(wxy - wx * wy / w, 2) / (wxx - wx * wx / w)) / (n - 2) / (wxx - wx * wx / w)), 6) AS stderr"""


_WRAW = _WOUT.replace("round(", "(").replace(", 6) AS", ") AS")


@query("I7_weighted_trend", f"""WITH g AS (SELECT CAST(substr(source, 4) AS DOUBLE) AS x, avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0 END) AS y, CAST(count(*) AS DOUBLE) AS w FROM documents GROUP BY ALL), f AS (SELECT {_WRAW} FROM {_WLS.format(g='', t='g', gb='')})
SELECT n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, round(stderr, 6) AS stderr, round({t_sql("slope / stderr", "n - 2")}, 6) AS p_value FROM f""")
def i7(spark, d):
    g = documents(spark, d).groupBy("book").agg(F.avg((F.col("lang") == "en").cast("double")).alias("y"), F.count("*").alias("w"))
    return stats.weighted_line(g, "book", "y", "w").select(
        "n", *[r6(c).alias(c) for c in ("slope", "intercept", "r2", "stderr")], r6(t_two_sided(F.col("slope") / F.col("stderr"), F.col("n") - 2)).alias("p_value"))


@query("I8_linear_probability", f"""WITH b AS (SELECT CAST(substr(source, 4) AS DOUBLE) AS x, quality AS y, lang FROM documents JOIN labels USING (doc_id)),
g AS (SELECT x - avg(x) OVER (PARTITION BY lang) AS dx, y - avg(y) OVER (PARTITION BY lang) AS dy, lang FROM b), s AS (SELECT count(*) AS n, count(DISTINCT lang) AS k, sum(dx * dx) AS xx, sum(dx * dy) AS xy, sum(dy * dy) AS yy FROM g)
SELECT n, k AS categories, round(xy / xx, 6) AS slope, round(sqrt((yy - xy * xy / xx) / (n - k - 1) / xx), 6) AS stderr, n - k - 1 AS dof, round(1 - (yy - xy * xy / xx) / (SELECT var_pop(y) * count(*) FROM b), 6) AS r2, round({t_sql("(xy / xx) / sqrt((yy - xy * xy / xx) / (n - k - 1) / xx)", "n - k - 1")}, 6) AS p_value FROM s""")
def i8(spark, d):
    b = bucket_docs(spark, d).select(F.col("book").cast("double").alias("x"), F.col("quality").cast("double").alias("y"), "lang")
    return stats.lpm_slope(b, "x", "y", "lang").select("n", "categories", r6("slope").alias("slope"), r6("stderr").alias("stderr"), "dof", r6("r2").alias("r2"), r6(t_two_sided(F.col("slope") / F.col("stderr"), F.col("dof"))).alias("p_value"))


_LEN = "v AS (SELECT source AS g, CAST(n_chars AS DOUBLE) AS v FROM documents)"
_ANOVA = "SELECT round(statistic, 6) AS statistic, dof1, dof2, round(" + f_sql("statistic", "dof1", "dof2") + ", 6) AS p_value FROM (SELECT (((sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*)))) AS statistic, count(*) - 1 AS dof1, CAST(sum(n) - count(*) AS BIGINT) AS dof2 FROM (SELECT g, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM {t} GROUP BY g))"


def with_f_tail(test):
    return test.withColumn("p_value", r6(f_sf("statistic", "dof1", "dof2"))).withColumn("statistic", r6("statistic"))


def lengths(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("g"), F.col("n_chars").cast("double").alias("v"))


@query("I9_anova", f"WITH {_LEN} " + _ANOVA.format(t="v"))
def i9(spark, d):
    return with_f_tail(stats.anova(lengths(spark, d), "g", "v"))


@query("I10_kruskal_wallis", f"""WITH {_LEN}, r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r FROM v), t AS (SELECT sum(pow(c, 3) - c) AS t FROM (SELECT count(*) AS c FROM v GROUP BY v)),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(q) AS q FROM (SELECT g, count(*) AS n, pow(sum(r), 2) / count(*) AS q FROM r GROUP BY g))
SELECT round(h, 6) AS statistic, dof, round({chi2_sql("h", "dof")}, 6) AS p_value FROM (SELECT (12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (pow(n, 3) - n)) AS h, k - 1 AS dof FROM s, t)""")
def i10(spark, d):
    return stats.kruskal(lengths(spark, d), "g", "v").withColumn("p_value", r6(chi2_sf("statistic", "dof"))).withColumn("statistic", r6("statistic"))


@query("I11_levene", f"WITH {_LEN}, d AS (SELECT g, abs(v - median(v) OVER (PARTITION BY g)) AS v FROM v) " + _ANOVA.format(t="d"))
def i11(spark, d):
    return with_f_tail(stats.levene(lengths(spark, d), "g", "v"))


_CT = f"c AS (SELECT lang AS r, {BUCKET_SQL} AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL), e AS (SELECT a.r, b.k, coalesce(c.n, 0) AS n, a.t * b.t / (SELECT sum(n) FROM c) AS e FROM (SELECT r, sum(n) AS t FROM c GROUP BY ALL) a CROSS JOIN (SELECT k, sum(n) AS t FROM c GROUP BY ALL) b LEFT JOIN c ON c.r = a.r AND c.k = b.k)"


def table_counts(spark, d):
    return bucket_docs(spark, d).groupBy(F.col("lang").alias("r"), F.col("bucket").alias("k")).agg(F.count("*").alias("n"))


@query("I12_chi_square", f"WITH {_CT} SELECT *, round({chi2_sql('chi2', 'dof')}, 6) AS p_value FROM (SELECT round(sum(pow(n - e, 2) / e), 6) AS chi2, (count(DISTINCT r) - 1) * (count(DISTINCT k) - 1) AS dof, round(sqrt(sum(pow(n - e, 2) / e) / (sum(n) * least(count(DISTINCT r) - 1, count(DISTINCT k) - 1))), 6) AS cramers_v FROM e)")
def i12(spark, d):
    test, _ = stats.chi_square(table_counts(spark, d), "r", "k", "n")
    return test.select(r6("chi2").alias("chi2"), "dof", r6("cramers_v").alias("cramers_v"), r6(chi2_sf("chi2", "dof")).alias("p_value"))


@query("I12_standardised_residuals", f"WITH {_CT} SELECT r, k, n, round(e, 6) AS expected, round((n - e) / sqrt(e), 6) AS residual FROM e")
def i12b(spark, d):
    _, cells = stats.chi_square(table_counts(spark, d), "r", "k", "n")
    return cells.select("r", "k", "n", r6("expected").alias("expected"), r6("residual").alias("residual"))


@query("I13_pairwise_chi_square", f"""WITH c AS (SELECT lang AS r, {BUCKET_SQL} AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL), t AS (SELECT r, sum(n) AS t FROM c GROUP BY ALL),
x AS (SELECT p.r AS a, q.r AS b, p.t AS ta, q.t AS tb, k.k, coalesce(ca.n, 0) AS x, coalesce(cb.n, 0) AS y FROM t p JOIN t q ON p.r < q.r CROSS JOIN (SELECT DISTINCT k FROM c) k LEFT JOIN c ca ON ca.r = p.r AND ca.k = k.k LEFT JOIN c cb ON cb.r = q.r AND cb.k = k.k),
e AS (SELECT *, (x + y) * ta / (ta + tb) AS ea, (x + y) * tb / (ta + tb) AS eb FROM x WHERE x + y > 0)
, s AS (SELECT a, b, sum(pow(x - ea, 2) / ea + pow(y - eb, 2) / eb) AS chi2, count(*) - 1 AS dof, any_value(ta + tb) AS n FROM e GROUP BY a, b), p AS (SELECT *, {chi2_sql('chi2', 'dof')} AS p FROM s)
SELECT a, b, round(chi2, 6) AS chi2, dof, round(sqrt(chi2 / n), 6) AS cramers_v, round(p, 6) AS p_value, round(max(least(1.0, p * (m - i + 1))) OVER (ORDER BY p, a, b ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM (SELECT *, row_number() OVER (ORDER BY p, a, b) AS i, count(*) OVER () AS m FROM p)""")
def i13(spark, d):
    tests = stats.pairwise_chi_square(table_counts(spark, d), "r", "k", "n").withColumn("p_value", chi2_sf("chi2", "dof"))
    return stats.holm(tests, "p_value").select("a", "b", "dof", *[r6(c).alias(c) for c in ("chi2", "cramers_v", "p_value", "p_holm")])


@query("I14_odds_ratio_by_stratum", """WITH s AS (SELECT l_suppkey % 10 AS st, CAST(count(*) FILTER (WHERE f AND g) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE f AND NOT g) AS DOUBLE) AS b, CAST(count(*) FILTER (WHERE NOT f AND g) AS DOUBLE) AS c, CAST(count(*) FILTER (WHERE NOT f AND NOT g) AS DOUBLE) AS d
 FROM (SELECT l_suppkey, l_returnflag = 'R' AS f, l_linestatus = 'O' AS g FROM lineitem) GROUP BY ALL), n AS (SELECT *, a + b + c + d AS n FROM s), z AS (SELECT sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d, sum(a * d / n) AS x, sum(b * c / n) AS y, sum(a - (a + b) * (a + c) / n) AS t, sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))) AS v FROM n)
SELECT round(a * d / (b * c), 6) AS odds_ratio, round(exp(ln(a * d / (b * c)) - 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 6) AS low, round(exp(ln(a * d / (b * c)) + 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 6) AS high, round(x / y, 6) AS mh_odds_ratio, round(pow(greatest(0, abs(t) - 0.5), 2) / v, 6) AS cmh_chi2 FROM z""")
def i14(spark, d):
    f, g = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    s = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("st")).agg(
        F.count_if(f & g).alias("a"), F.count_if(f & ~g).alias("b"), F.count_if(~f & g).alias("c"), F.count_if(~f & ~g).alias("d"))
    out = stats.odds_ratio(s, "st")
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("I15_density_grid", r"""WITH v AS (SELECT lang AS g, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS DOUBLE) AS v FROM documents), s AS (SELECT g, count(*) AS n, stddev_samp(v) AS sd FROM v GROUP BY ALL), e AS (SELECT greatest(0, min(v) - 2) AS lo, max(v) + 2 AS hi FROM v),
b AS (SELECT g, v, count(*) AS c FROM v GROUP BY ALL)
SELECT b.g, CAST(i AS INTEGER) AS i, round(lo + i * (hi - lo) / 139, 6) AS x, round(sum(c * exp(-0.5 * pow((lo + i * (hi - lo) / 139 - b.v) / (sd * pow(n, -0.2)), 2))) / (any_value(n * sd * pow(n, -0.2)) * sqrt(2 * pi())), 8) AS density
FROM b JOIN s ON s.g = b.g CROSS JOIN e CROSS JOIN range(140) r(i) GROUP BY b.g, i, lo, hi""")
def i15(spark, d):
    v = table(spark, d, "documents").select(F.col("lang").alias("g"), tx.count_words("text").alias("v"))
    return stats.kde(v, "g", "v").select("g", "i", r6("x").alias("x"), r6("density", 8).alias("density"))


_RB = f"b AS (SELECT CAST(substr(source, 4) AS INTEGER) AS book, lang AS mode, quality AS hit FROM documents JOIN labels USING (doc_id))"


@query("I16_rate_by_group", f"WITH {_RB} SELECT book, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, round(avg(hit), 6) AS rate FROM b GROUP BY ALL")
def i16(spark, d):
    return bucket_docs(spark, d).groupBy("book").agg(F.count("*").alias("n"), F.sum("quality").alias("hits"), r6(F.avg("quality")).alias("rate"))


@query("I16_composition", f"WITH {_RB} SELECT k.book, m.mode, count(b.mode) AS n, round(count(b.mode) / any_value(k.t), 6) AS proportion FROM (SELECT book, count(*) AS t FROM b GROUP BY ALL) k CROSS JOIN (VALUES ('de'), ('en'), ('es'), ('fr'), ('xx')) m(mode) LEFT JOIN b ON b.book = k.book AND b.mode = m.mode GROUP BY k.book, m.mode")
def i16b(spark, d):
    modes = ("de", "en", "es", "fr", "xx")
    wide = bucket_docs(spark, d).groupBy("book").agg(F.count("*").alias("_t"), *[F.count_if(F.col("lang") == m).alias(m) for m in modes])
    cells = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("n"), r6(F.col(m) / F.col("_t")).alias("proportion")) for m in modes])
    return wide.select("book", F.inline(cells))


@query("I16_trend_by_category", f"WITH {_RB}, g AS (SELECT mode, CAST(book AS DOUBLE) AS x, avg(hit) AS y, CAST(count(*) AS DOUBLE) AS w FROM b GROUP BY ALL) SELECT mode, n, round((wxy - wx * wy / w) / (wxx - wx * wx / w), 6) AS slope FROM {_WLS.format(g='mode,', t='g', gb='GROUP BY mode')} WHERE n >= 3")
def i16c(spark, d):
    pts = bucket_docs(spark, d).groupBy(F.col("lang").alias("mode"), "book").agg(F.avg("quality").alias("y"), F.count("*").alias("w"))
    return stats.weighted_line(pts, "book", "y", "w", ["mode"]).where("n >= 3").select("mode", "n", r6("slope").alias("slope"))


REPS = 20


@query("I17_null_model", f"""WITH inc AS (SELECT DISTINCT l_suppkey AS place, l_partkey AS person FROM lineitem), parent AS (SELECT s_suppkey AS place, s_nationkey AS parent FROM supplier), reps AS (SELECT unnest(range({REPS})) AS rep),
slots AS (SELECT rep, place, row_number() OVER (PARTITION BY rep ORDER BY md5('slot|' || rep || '|' || place || '|' || person), place, person) AS k FROM inc, reps),
cards AS (SELECT rep, person, row_number() OVER (PARTITION BY rep ORDER BY md5('card|' || rep || '|' || person || '|' || place), person, place) AS k FROM inc, reps),
draw AS (SELECT DISTINCT rep, place, person FROM slots JOIN cards USING (rep, k) UNION ALL SELECT -1, place, person FROM inc),
cnt AS (SELECT rep, parent, person, count(*) AS c FROM draw JOIN parent USING (place) GROUP BY ALL),
s AS (SELECT draw.rep, draw.place, count(*) FILTER (WHERE c > 1) AS shared FROM draw JOIN parent USING (place) JOIN cnt ON cnt.rep = draw.rep AND cnt.parent = parent.parent AND cnt.person = draw.person GROUP BY ALL),
n AS (SELECT place, avg(shared) AS m, stddev_pop(shared) AS sd FROM s WHERE rep >= 0 GROUP BY ALL)
SELECT s.place, s.shared AS observed, round(m, 6) AS null_mean, round(sd, 6) AS null_std, round(CASE WHEN sd > 0 THEN (s.shared - m) / sd ELSE 0 END, 6) AS z FROM s JOIN n ON n.place = s.place WHERE s.rep = -1""")
def i17(spark, d):
    inc = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("place"), F.col("l_partkey").alias("person")).distinct()
    groups = table(spark, d, "supplier").select(F.col("s_suppkey").alias("place"), F.col("s_nationkey").alias("parent"))
    out = permute.shared_null_model(inc, groups, REPS)
    return out.select("place", "observed", *[r6(c).alias(c) for c in ("null_mean", "null_std", "z")])
