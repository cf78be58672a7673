"""Multiple-testing corrections, correlations and regressions from sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import average_ranks, ordered_scan, quantiles, value_histogram


def benjamini_hochberg(df: DataFrame, p: str, out: str = "q_value") -> DataFrame:
    """BH q-values.  Works on distinct p values: q is the running minimum, from
    the largest p down, of p * n / (number of p values <= p)."""
    return _adjust(df, p, out, holm=False)


def holm(df: DataFrame, p: str, out: str = "p_holm") -> DataFrame:
    """Holm adjusted p-values: running maximum of p * (n - rank)."""
    return _adjust(df, p, out, holm=True)


def _adjust(df: DataFrame, p: str, out: str, holm: bool) -> DataFrame:
    spans = value_histogram(df, [], p)
    n = df.where(F.col(p).isNotNull()).agg(F.count("*").alias("n")).scalar()
    if holm:
        raw = F.least(F.lit(1.0), F.col(p) * (n - F.col("lo")))
        done = ordered_scan(spans.select(p, raw.alias("_raw")), [], [F.asc(p)], {out: ("max", "_raw")})
    else:
        raw = F.least(F.lit(1.0), F.col(p) * n / F.col("hi"))
        done = ordered_scan(spans.select(p, raw.alias("_raw")), [], [F.desc(p)], {out: ("min", "_raw")})
    return df.join(done.select(p, out), p, "left")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(both, [], x, "_rx"), [], y, "_ry")
    return ranked.agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("spearman"))


def ols(df: DataFrame, x: str, y: str, group: Sequence[str] = ()) -> DataFrame:
    """Least squares of y on x with standard errors and t statistics; undefined
    (null) where x does not vary."""
    s = df.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_syy(y, x).alias("_syy"),
        F.regr_sxy(y, x).alias("_sxy"),
        F.regr_avgx(y, x).alias("_mx"),
    )
    dof = F.col("n") - 2
    ok = (F.col("_sxx") > 0) & (dof > 0)
    var = F.greatest(F.lit(0.0), F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx")) / dof
    se = F.when(ok, F.sqrt(var / F.col("_sxx")))
    se0 = F.when(ok, F.sqrt(var * (1.0 / F.col("n") + F.col("_mx") * F.col("_mx") / F.col("_sxx"))))
    keep = F.col("_sxx") > 0
    return s.select(
        *group,
        "n",
        F.when(keep, F.col("slope")).alias("slope"),
        F.when(keep, F.col("intercept")).alias("intercept"),
        F.when(keep, F.col("r2")).alias("r2"),
        se.alias("slope_se"),
        se0.alias("intercept_se"),
        F.when(se > 0, F.col("slope") / se).alias("t_slope"),
        dof.alias("dof"),
    )


def residuals(df: DataFrame, x: str, y: str, out: str = "residual") -> DataFrame:
    """Residual of every row; the fit enters as two scalar subqueries."""
    fit = df.agg(
        F.struct(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")).alias("f"))
    f = fit.scalar()
    expected = f["intercept"] + f["slope"] * F.col(x)
    return df.withColumn("expected", expected).withColumn(out, F.col(y) - F.col("expected"))


def weighted_line(df: DataFrame, x: str, y: str, w: str, group: Sequence[str] = ()) -> DataFrame:
    """Weighted least squares line; needs 3 points and 2 distinct x."""
    X, Y, W = F.col(x).cast("double"), F.col(y).cast("double"), F.col(w).cast("double")
    s = df.where((W > 0) & X.isNotNull() & Y.isNotNull()).groupBy(*group).agg(
        F.count("*").alias("n"),
        F.sum(W).alias("_w"), F.sum(W * X).alias("_wx"), F.sum(W * Y).alias("_wy"),
        F.sum(W * X * X).alias("_wxx"), F.sum(W * X * Y).alias("_wxy"), F.sum(W * Y * Y).alias("_wyy"),
        F.min(X).alias("_lo"), F.max(X).alias("_hi"))
    sxx = F.col("_wxx") - F.col("_wx") * F.col("_wx") / F.col("_w")
    sxy = F.col("_wxy") - F.col("_wx") * F.col("_wy") / F.col("_w")
    syy = F.col("_wyy") - F.col("_wy") * F.col("_wy") / F.col("_w")
    ok = (F.col("n") >= 3) & (F.col("_hi") > F.col("_lo"))
    slope = sxy / sxx
    sse = F.greatest(F.lit(0.0), syy - slope * sxy)
    se = F.sqrt(sse / (F.col("n") - 2) / sxx)
    return s.select(
        *group, "n",
        F.when(ok, slope).alias("slope"),
        F.when(ok, (F.col("_wy") - slope * F.col("_wx")) / F.col("_w")).alias("intercept"),
        F.when(ok, F.when(syy > 0, 1 - sse / syy).otherwise(0.0)).alias("r2"),
        F.when(ok, se).alias("stderr"),
        F.when(ok & (se > 0), slope / se).alias("t_slope"))


def quadratic_r2(df: DataFrame, x: str, y: str) -> DataFrame:
    """R² of y on x and x² from centred power sums (2×2 normal equations)."""
    mean = df.agg(F.struct(F.avg(x).alias("x"), F.avg(y).alias("y")).alias("m")).scalar()
    u = F.col(x) - mean["x"]
    c = df.select(u.alias("u"), (F.col(y) - mean["y"]).alias("v"))
    s = c.agg(
        F.count("*").alias("n"), F.sum(F.col("u") * F.col("u")).alias("s2"), F.sum(F.pow("u", F.lit(3))).alias("s3"),
        F.sum(F.pow("u", F.lit(4))).alias("s4"), F.sum(F.col("u") * F.col("v")).alias("t1"),
        F.sum(F.col("u") * F.col("u") * F.col("v")).alias("t2"), F.sum(F.col("v") * F.col("v")).alias("syy"))
    # columns u and u² centred: cross products below
    a, b = F.col("s2"), F.col("s3")
    e = F.col("s4") - F.col("s2") * F.col("s2") / F.col("n")
    det = a * e - b * b
    b1 = (F.col("t1") * e - F.col("t2") * b) / det
    b2 = (F.col("t2") * a - F.col("t1") * b) / det
    return s.select("n", F.when(F.col("syy") > 0, (b1 * F.col("t1") + b2 * F.col("t2")) / F.col("syy")).alias("r2"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way ANOVA F from group counts, means and variances."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where("n > 1")
    return _anova_from(g)


def _anova_from(g: DataFrame) -> DataFrame:
    s = g.agg(
        F.count("*").alias("k"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("m")).alias("_s"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("_q"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("_q") - F.col("_s") * F.col("_s") / F.col("N")
    d1, d2 = F.col("k") - 1, F.col("N") - F.col("k")
    return s.select(
        (between / d1 / (F.col("within") / d2)).alias("statistic"), d1.alias("dof1"), d2.alias("dof2"))


def levene(df: DataFrame, group: str, value: str) -> DataFrame:
    """Median-centred Levene test: ANOVA of the absolute deviations.

    Runs on the (group, value) histogram, so the medians come from an exact
    scan and no group is gathered.
    """
    sizes = df.groupBy(group).agg(F.count(value).alias("_n")).where("_n > 1").select(group)
    rows = df.join(sizes, group, "left_semi")
    med = quantiles(rows, [group], value, {"_median": 0.5})
    dev = rows.join(med, group).withColumn("_dev", F.abs(F.col(value) - F.col("_median")))
    g = dev.groupBy(group).agg(F.count("*").alias("n"), F.avg("_dev").alias("m"), F.var_pop("_dev").alias("v"))
    return _anova_from(g)


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """Kruskal–Wallis H with tie correction, from value counts."""
    sizes = df.groupBy(group).agg(F.count(value).alias("_n")).where("_n > 1").select(group)
    rows = df.join(sizes, group, "left_semi")
    spans = value_histogram(rows, [], value).withColumn("rank", (F.col("lo") + 1 + F.col("hi")) / 2)
    cells = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    sums = cells.join(spans.select(value, "rank"), value).groupBy(group).agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("r"))
    ties = spans.agg(F.sum(F.col("n").cast("double") * (F.col("n").cast("double") * F.col("n") - 1)).alias("t")).scalar()
    s = sums.agg(F.count("*").alias("k"), F.sum("n").alias("N"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"))
    N = F.col("N").cast("double")
    h = 12.0 / (N * (N + 1)) * F.col("q") - 3 * (N + 1)
    return s.select((h / (1 - ties / (N * N * N - N))).alias("statistic"), (F.col("k") - 1).alias("dof"))


def chi_square(counts: DataFrame, row: str, col: str, n: str) -> tuple[DataFrame, DataFrame]:
    """χ² of a contingency table in long form: (test row, cells with residuals).

    Empty rows and columns drop out, as they have no expected count.
    """
    seen = counts.where(F.col(n) > 0)
    r = seen.groupBy(row).agg(F.sum(n).alias("_r"))
    c = seen.groupBy(col).agg(F.sum(n).alias("_c"))
    total = seen.agg(F.sum(n).alias("t")).scalar()
    # One entry per category: the column margins travel as one small array.
    margins = c.agg(F.array_sort(F.collect_list(F.struct(col, "_c"))).alias("m")).scalar()
    full = r.select(row, "_r", F.inline(margins))
    cells = full.join(seen.select(row, col, n), [row, col], "left").fillna(0, [n])
    expected = F.col("_r") * F.col("_c") / total
    cells = cells.select(row, col, n, expected.alias("expected"), ((F.col(n) - expected) / F.sqrt(expected)).alias("residual"))
    rows, cols = r.agg(F.count("*")).scalar(), c.agg(F.count("*")).scalar()
    # chi2 = N (sum n^2 / (r c) - 1): empty cells add nothing
    share = F.col(n).cast("double") * F.col(n) / (F.col("_r") * F.col("_c").cast("double"))
    test = seen.join(r, row).join(c, col).agg(F.sum(share).alias("_s"), F.sum(n).alias("n")).select(
        (F.col("n") * (F.col("_s") - 1)).alias("chi2"), ((rows - 1) * (cols - 1)).alias("dof"), "n",
        F.sqrt((F.col("_s") - 1) / F.least(rows - 1, cols - 1)).alias("cramers_v"))
    return test, cells


def pairwise_chi_square(counts: DataFrame, row: str, col: str, n: str) -> DataFrame:
    """χ² and Cramér's V for every pair of rows of a small contingency table."""
    seen = counts.where(F.col(n) > 0).select(F.col(row).alias("r"), F.col(col).alias("c"), F.col(n).alias("n"))
    rows = seen.groupBy("r").agg(F.sum("n").alias("t"))
    # 2×k table of rows a, b: chi2 = N·Σ_j (n_aj·T_b − n_bj·T_a)² / (T_a·T_b·C_j)
    # One entry per category: the row totals travel as one small array.
    totals = rows.agg(F.array_sort(F.collect_list(F.struct(F.col("r").alias("b"), F.col("t").alias("tb")))).alias("m")).scalar()
    joined = rows.select(F.col("r").alias("a"), F.col("t").alias("ta"), F.inline(totals)).where("a < b")
    left = joined.join(seen.withColumnRenamed("r", "a"), "a").select("a", "b", "ta", "tb", "c", F.col("n").alias("x"), F.lit(0).cast("long").alias("y"))
    right = joined.join(seen.withColumnRenamed("r", "b"), "b").select("a", "b", "ta", "tb", "c", F.lit(0).cast("long").alias("x"), F.col("n").alias("y"))
    cells = left.unionByName(right).groupBy("a", "b", "ta", "tb", "c").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    diff = F.col("x") * F.col("tb").cast("double") - F.col("y") * F.col("ta").cast("double")
    total = F.col("ta") + F.col("tb")
    term = diff * diff / (F.col("ta") * F.col("tb").cast("double") * (F.col("x") + F.col("y")))
    out = cells.groupBy("a", "b", "ta", "tb").agg(F.sum(term).alias("chi2"), (F.count("*") - 1).alias("dof")).where("dof > 0")
    return out.select("a", "b", "chi2", "dof", F.sqrt(F.col("chi2") / total).alias("cramers_v"))


def odds_ratio(strata: DataFrame, stratum: str) -> DataFrame:
    """Crude odds ratio with 95% limits, Mantel–Haenszel ratio and CMH χ² from
    rows (stratum, a, b, c, d) of 2×2 tables."""
    A, B, C, D = (F.col(x).cast("double") for x in "abcd")
    N = A + B + C + D
    ea = (A + B) * (A + C) / N
    va = (A + B) * (C + D) * (A + C) * (B + D) / (N * N * (N - 1))
    s = strata.where(N > 1).agg(
        *[F.sum(F.col(x).cast("double")).alias(x) for x in "abcd"],
        F.sum(A * D / N).alias("_num"), F.sum(B * C / N).alias("_den"),
        F.sum(A - ea).alias("_diff"), F.sum(va).alias("_var"))
    log_or = F.ln(F.col("a") * F.col("d") / (F.col("b") * F.col("c")))
    se = F.sqrt(1 / F.col("a") + 1 / F.col("b") + 1 / F.col("c") + 1 / F.col("d"))
    return s.select(
        F.exp(log_or).alias("odds_ratio"), F.exp(log_or - 1.96 * se).alias("low"), F.exp(log_or + 1.96 * se).alias("high"),
        (F.col("_num") / F.col("_den")).alias("mh_odds_ratio"),
        (F.pow(F.greatest(F.lit(0.0), F.abs("_diff") - 0.5), F.lit(2)) / F.col("_var")).alias("cmh_chi2"))


def kde(df: DataFrame, group: str, value: str, points: int = 140, pad: float = 2.0) -> DataFrame:
    """Gaussian density per group on one shared grid (Scott bandwidth).

    Values are counted first, so the cost is distinct values × grid points.
    """
    bins = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    stats = df.groupBy(group).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd")).where("n > 1 AND sd > 0")
    edge = df.agg(F.struct(F.greatest(F.lit(0.0), F.min(value) - pad).alias("lo"), (F.max(value) + pad).alias("hi")).alias("e")).scalar()
    step = (edge["hi"] - edge["lo"]) / F.lit(points - 1)
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    rows = bins.join(stats, group).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = edge["lo"] + F.col("i") * step
    z = (x - F.col("v")) / h
    kernel = F.col("c") * F.exp(-0.5 * z * z)
    return rows.groupBy(group, "i").agg(
        F.max(x).alias("x"),
        (F.sum(kernel) / (F.max(F.col("n") * h) * F.lit(2.5066282746310002))).alias("density"))


def lpm_slope(df: DataFrame, x: str, y: str, category: str) -> DataFrame:
    """Slope of y on x with category dummies, by within-category demeaning, and
    the R² of the whole model."""
    g = df.groupBy(category).agg(
        F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy"))
    s = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("sxx").alias("sxx"), F.sum("sxy").alias("sxy"), F.sum("syy").alias("syy"),
        (F.sum("syy") + F.sum(F.col("n") * F.col("my") * F.col("my")) - F.pow(F.sum(F.col("n") * F.col("my")), F.lit(2)) / F.sum("n")).alias("sst"))
    dof = F.col("n") - F.col("k") - 1
    slope = F.col("sxy") / F.col("sxx")
    sse = F.col("syy") - slope * F.col("sxy")
    ok = (F.col("sxx") > 0) & (dof > 0)
    return s.select(
        "n", F.col("k").alias("categories"), F.when(ok, slope).alias("slope"),
        F.when(ok, F.sqrt(sse / dof / F.col("sxx"))).alias("stderr"), dof.alias("dof"),
        F.when(ok & (F.col("sst") > 0), 1 - sse / F.col("sst")).alias("r2"))
