"""Explainable text classifiers and ridge models on Spark ML and sums.

Only vocabulary-sized tables (at most ``max_features`` rows), class counts and
Gram matrices of the feature count reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .many_fits import fit_many
from .scan import md5_key, ordered_scan, top_per_group
from .terms import features as select_terms


# Splits and metrics ------------------------------------------------------


def stratified_order(df: DataFrame, key: Sequence[str], label: str, seed: str) -> DataFrame:
    """1-based position of each row in its class's md5 order, and class size."""
    keyed = df.withColumn("_h", md5_key(*key, seed=seed)).withColumn("_one", F.lit(1).cast("long"))
    size = df.groupBy(label).agg(F.count("*").alias("class_size"))
    ranked = ordered_scan(keyed, [label], ["_h", *key], {"position": ("sum", "_one")})
    return ranked.join(size, label).drop("_h", "_one")


def holdout(df: DataFrame, key: Sequence[str], label: str, ratio: float, seed: str) -> DataFrame:
    """Adds ``is_test``: the first ceil(ratio * n) rows of each class's md5 order."""
    o = stratified_order(df, key, label, seed)
    return o.withColumn("is_test", F.col("position") <= F.ceil(F.col("class_size") * F.lit(ratio))).drop("position", "class_size")


def folds(df: DataFrame, key: Sequence[str], label: str, k: int, seed: str) -> DataFrame:
    """Adds ``fold``: md5 position modulo k inside each class."""
    o = stratified_order(df, key, label, seed)
    return o.withColumn("fold", ((F.col("position") - 1) % k).cast("int")).drop("position", "class_size")


def binary_metrics(df: DataFrame, actual: str, predicted: str, group: Sequence[str] = ()) -> DataFrame:
    """Confusion cells and the usual rates for 0/1 labels, one aggregate."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    c = df.groupBy(*group).agg(
        F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
    div = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    f1p, f1n = div(2 * tp, 2 * tp + fp + fn), div(2 * tn, 2 * tn + fp + fn)
    return c.select(
        *group, n.alias("n"), "tp", "fp", "fn", "tn",
        div(tp + tn, n).alias("accuracy"),
        div(F.greatest(tp + fn, fp + tn), n).alias("majority_accuracy"),
        (F.when((tp + fn > 0) & (tn + fp > 0), (div(tp, tp + fn) + div(tn, tn + fp)) / 2).otherwise(div(tp + tn, n))).alias("balanced_accuracy"),
        div(tp, tp + fp).alias("precision_1"), div(tp, tp + fn).alias("recall_1"), f1p.alias("f1_1"),
        div(tn, tn + fn).alias("precision_0"), div(tn, tn + fp).alias("recall_0"), f1n.alias("f1_0"),
        ((f1p + f1n) / 2).alias("macro_f1"), div(f1p * (tp + fn) + f1n * (tn + fp), n).alias("weighted_f1"))


# Text classifier ---------------------------------------------------------


@dataclass
class TextModel:
    """A fitted TF-IDF logistic model."""

    terms: list[str]
    idf: list[float]
    binary: bool
    normalize: bool
    lr: LogisticRegressionModel | None
    message: str = ""
    counts: dict = field(default_factory=dict)

    @property
    def available(self) -> bool:
        return self.lr is not None

    @property
    def intercept(self) -> float:
        return float(self.lr.intercept)

    def vectorize(self, docs: DataFrame) -> DataFrame:
        cv = CountVectorizerModel.from_vocabulary(self.terms, inputCol="toks", outputCol="_tf", binary=self.binary)
        out = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_w").transform(cv.transform(docs))
        if self.normalize:
            out = Normalizer(p=2.0, inputCol="_w", outputCol="features").transform(out)
        else:
            out = out.withColumnRenamed("_w", "features")
        return out

    def predict(self, docs: DataFrame) -> DataFrame:
        """Adds ``predicted`` and the probability ``p1``."""
        out = self.lr.transform(self.vectorize(docs))
        return out.withColumn("p1", vector_to_array("probability")[1]).withColumn("predicted", F.col("prediction").cast("int")).drop(
            "_tf", "_w", "features", "rawPrediction", "probability", "prediction")

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """(term, idf, coefficient, points); points = coefficient × idf."""
        rows = [(t, float(i), float(c), float(c) * float(i)) for t, i, c in zip(self.terms, self.idf, self.lr.coefficients.toArray())]
        return spark.createDataFrame(rows, "term string, idf double, coefficient double, points double")


def fit_text_model(
    docs: DataFrame,
    max_features: int = 1000,
    min_df: int = 2,
    C: float = 1.0,
    weight: str | None = None,
    vocabulary: Sequence[str] | None = None,
    binary: bool = False,
    normalize: bool = True,
    min_class: int = 5,
) -> TextModel:
    """Class-balanced L2 logistic regression on TF-IDF of (toks, label).

    The penalty matches a C-scaled loss sum: regParam = 1 / (C · sum of
    weights), without standardisation.  Too little data gives an unavailable
    model with a message instead of an error.
    """
    counts = {int(r["label"]): (r["n"], float(r["w"])) for r in docs.groupBy("label").agg(
        F.count("*").alias("n"), F.sum(F.col(weight) if weight else F.lit(1.0)).alias("w")).collect()}
    if len(counts) < 2 or min(n for n, _ in counts.values()) < min_class:
        return TextModel([], [], binary, normalize, None, "not enough labelled units in each class", counts)
    n = sum(c for c, _ in counts.values())
    seen = docs.select(F.explode(F.array_distinct("toks")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    if vocabulary is None:
        tf = docs.select(F.explode("toks").alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
        top = tf.join(seen.where(F.col("df") >= min_df), "term").orderBy(F.desc("tf"), "term").limit(max_features)
        rows = top.select("term", "df").collect()
    else:
        rows = seen.where(F.col("term").isin(list(vocabulary))).collect()
    if not rows:
        return TextModel([], [], binary, normalize, None, "no repeated vocabulary", counts)
    rows = sorted(rows, key=lambda r: r["term"])
    idf = [float(np.log((1 + n) / (1 + r["df"])) + 1) for r in rows]
    model = TextModel([r["term"] for r in rows], idf, binary, normalize, None, "", counts)
    balance = F.when(F.col("label") == 1, n / (2.0 * counts[1][0])).otherwise(n / (2.0 * counts[0][0]))
    w = balance * (F.col(weight) if weight else F.lit(1.0))
    total = sum(n / (2.0 * c) * s for c, s in counts.values())
    train = model.vectorize(docs).select(F.col("label").cast("double").alias("label"), w.alias("_wt"), "features")
    model.lr = LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="_wt", regParam=1.0 / (C * total), elasticNetParam=0.0,
        standardization=False, maxIter=1000, tol=1e-9).fit(train)
    return model


def head_and_tail(coefs: DataFrame, k: int) -> DataFrame:
    top = coefs.where("coefficient > 0").orderBy(F.desc("coefficient"), "term").limit(k).withColumn("direction", F.lit(1))
    low = coefs.where("coefficient < 0").orderBy("coefficient", "term").limit(k).withColumn("direction", F.lit(0))
    return top.unionByName(low)


def point_scores(docs: DataFrame, points: DataFrame, threshold: Column) -> DataFrame:
    """Sum of the points of a unit's distinct terms, and the decision."""
    rows = docs.select("unit", F.explode(F.array_distinct("toks")).alias("term")).join(points.select("term", "points"), "term")
    s = rows.groupBy("unit").agg(F.sum("points").alias("score"))
    out = docs.select("unit").join(s, "unit", "left").fillna(0.0, ["score"])
    return out.withColumn("predicted", (F.col("score") > threshold).cast("int"))


def leave_group_out(docs: DataFrame, group: str, **fit) -> tuple[DataFrame, list[str]]:
    """Predictions for each group from a model trained on all the others.

    The groups are few (books); their models are fitted together.
    """
    names = [str(r[0]) for r in docs.select(group).where(F.col(group).isNotNull()).distinct().orderBy(group).collect()]
    own = F.col(group).cast("string")
    members = docs.select(F.explode(F.array(*map(F.lit, names))).alias("model"), "unit", "label", own.alias("_own")).where("model <> _own").drop("_own")
    fits = fit_many(docs, members, **fit)
    predicted = fits.predict(docs, docs.where(own.isNotNull()).select(own.alias("model"), "unit"))
    return predicted.drop("model").join(docs.drop("toks"), "unit"), fits.skipped


def group_metrics_summary(per_group: DataFrame) -> DataFrame:
    return per_group.agg(
        F.count("*").alias("groups"), (F.sum(F.col("tp") + F.col("tn")) / F.sum("n")).alias("weighted_accuracy"),
        F.avg("accuracy").alias("macro_accuracy"), F.sum("n").alias("total_test"))


def contributions(weights: DataFrame, coefs: DataFrame, predicted: DataFrame, k: int) -> DataFrame:
    """Top terms behind each prediction: weight × coefficient, on the predicted
    side if there is any such term, else the largest by size.

    ``weights`` is (unit, term, weight), ``predicted`` is (unit, predicted).
    """
    c = weights.join(coefs.select("term", "coefficient"), "term").join(predicted.select("unit", "predicted"), "unit").withColumn(
        "contribution", F.col("weight") * F.col("coefficient"))
    side = F.when(F.col("predicted") == 1, F.col("contribution") > 0).otherwise(F.col("contribution") < 0)
    c = c.withColumn("_side", side)
    # Terms of the predicted side sort first; others only count when there are none.
    has = c.where("_side").select("unit").distinct().withColumn("_has", F.lit(True))
    c = c.join(has, "unit", "left").where(F.col("_side") | F.col("_has").isNull())
    return top_per_group(c, ["unit"], [F.desc(F.abs("contribution")), F.asc("term")], k).select("unit", "rn", "term", "contribution")


def stability(coefs: DataFrame, baseline: str, k: int) -> DataFrame:
    """Sign, range and presence of the baseline's k largest terms over all
    scenarios of (scenario, term, coefficient)."""
    base = coefs.where(F.col("scenario") == baseline).orderBy(F.desc(F.abs("coefficient")), "term").limit(k)
    rows = coefs.join(base.select("term"), "term", "left_semi")
    v = F.col("coefficient")
    return rows.groupBy("term").agg(
        F.max(F.when(F.col("scenario") == baseline, v)).alias("baseline"), F.count("*").alias("present"),
        F.min(v).alias("lowest"), F.max(v).alias("highest"),
        ((F.count_if(v > 1e-12) == 0) | (F.count_if(v < -1e-12) == 0)).alias("sign_stable"))


def noisy_labels(units: DataFrame, joint: DataFrame, values: Sequence[str], runs: int, seed: str) -> DataFrame:
    """``runs`` label draws per unit from P(manual | observed).

    ``joint`` is (observed, manual) pairs; a ``mixed`` manual label counts half
    for each of the first two values.  The draw compares a hash-uniform number
    with the cumulative probabilities, so it repeats exactly.
    """
    share = {v: F.sum(F.when(F.col("manual") == v, 1.0).when((F.col("manual") == "mixed") & F.lit(v in values[:2]), 0.5).otherwise(0.0)).alias(v) for v in values}
    p = joint.groupBy("observed").agg(*share.values())
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    u = F.conv(F.left(md5_key("unit", "run", seed=seed), F.lit(8)), 16, 10).cast("double") / F.lit(float(16**8))
    drawn = units.join(p, "observed", "left").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("_u", u * total)
    label, cum = F.when(total.isNull() | (total <= 0), "other"), F.lit(0.0)
    for v in values[:-1]:
        cum = cum + F.col(v)
        label = label.when(F.col("_u") < cum, v)
    return drawn.select("unit", "run", label.otherwise(values[-1]).alias("label"))


def task_labels(units: DataFrame, bucket: str) -> DataFrame:
    """Labels of every classification task in long form (task, label)."""
    b = F.col(bucket)
    tasks = F.array(
        F.struct(F.lit("three_way").alias("task"), F.when(b.isin("mythic", "historical", "other"), b).alias("label")),
        F.struct(F.lit("mythic_vs_historical").alias("task"), F.when(b == "mythic", "1").when(b == "historical", "0").alias("label")),
        F.struct(F.lit("historical_vs_all").alias("task"), F.when(b.isin("historical", "both"), "1").otherwise("0").alias("label")),
        F.struct(F.lit("mythic_vs_all").alias("task"), F.when(b.isin("mythic", "both"), "1").otherwise("0").alias("label")))
    rest = [c for c in units.columns if c != bucket]
    return units.select(*rest, F.inline(tasks)).where(F.col("label").isNotNull())


def guard(df: DataFrame, label: str, min_rows: int, min_class: int) -> DataFrame:
    """One status row: ready, or blocked with the reason."""
    c = df.groupBy(label).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("classes"), F.coalesce(F.min("n"), F.lit(0)).alias("smallest"))
    reason = (
        F.when(F.col("rows") < min_rows, "too few rows").when(F.col("classes") < 2, "only one class").when(F.col("smallest") < min_class, "class too small"))
    return c.select("rows", "classes", "smallest", F.when(reason.isNull(), "ready").otherwise("blocked").alias("status"), F.coalesce(reason, F.lit("")).alias("reason"))


def comparable_runs(runs: DataFrame, anchor_family: str) -> DataFrame:
    """Runs that can be compared with the latest run of the anchor family (same
    sample and class counts): the latest per family, the best one flagged."""
    anchor = runs.where(F.col("family") == anchor_family).orderBy(F.desc("completed_at"), F.desc("run_id")).limit(1)
    same = ["sample_count", "positive_count"]
    cohort = runs.join(anchor.select(*same), same, "left_semi")
    rest = [c for c in runs.columns if c not in ("family", "completed_at", "run_id")]
    latest = cohort.groupBy("family").agg(F.max(F.struct("completed_at", "run_id", *rest)).alias("r")).select("family", "r.*")
    best = latest.agg(F.max_by("run_id", F.struct("balanced_accuracy", "run_id"))).scalar()
    return latest.withColumn("is_best", F.col("run_id") == best)


# Ridge -------------------------------------------------------------------


def ridge_text(df: DataFrame, alpha: float, terms: Sequence[str], idf: Sequence[float]) -> tuple[DataFrame, float]:
    """Ridge of ``y`` on normalised TF-IDF of ``toks``: coefficients and R².

    Spark scales the penalty by the label's deviation, so alpha becomes
    alpha / n × population std of y for the normal solver.
    """
    holder = TextModel(list(terms), list(idf), False, True, None)
    v = holder.vectorize(df).select("y", "features")
    s = df.agg(F.count("*").alias("n"), F.stddev_pop("y").alias("sd")).first()
    lr = LinearRegression(featuresCol="features", labelCol="y", regParam=alpha / s["n"] * s["sd"], elasticNetParam=0.0, standardization=False, solver="normal").fit(v)
    rows = [(t, float(c)) for t, c in zip(terms, lr.coefficients.toArray())]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double"), float(lr.summary.r2)


ALPHAS = tuple(np.logspace(-2, 4, 13))


def ridge_cv(df: DataFrame, k: int, alphas: Sequence[float] = ALPHAS) -> tuple[DataFrame, dict]:
    """Standardised ridge with leave-one-out alpha choice inside k outer folds.

    Input (id, fold, y, x array<double>).  Three passes over the data, none of
    which grows with the number of alphas × folds: Gram sums per fold; squared
    leave-one-out errors of every (model, alpha) from the closed form
    e / (1 - h); held-out predictions.  Returns predictions and a report with
    the metrics, the chosen alpha and the coefficients.
    """

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for fold, part in b.groupby("fold"):
                z = np.column_stack([np.ones(len(part)), np.stack(part["x"].to_numpy()), part["y"].to_numpy(float)])
                sums[int(fold)] = sums.get(int(fold), 0) + z.T @ z
        for fold, m in sums.items():
            for i, row in enumerate(m):
                yield pd.DataFrame({"fold": fold, "i": i, "j": np.arange(len(row)), "v": row})

    cells = df.select("fold", "x", "y").mapInPandas(gram, "fold int, i int, j int, v double").groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).collect()
    size = max(r["i"] for r in cells) + 1
    per_fold = np.zeros((k, size, size))
    for r in cells:
        per_fold[r["fold"], r["i"], r["j"]] = r["v"]
    total = per_fold.sum(axis=0)

    def prepare(m: np.ndarray):
        n = m[0, 0]
        mx, my = m[0, 1:-1] / n, m[0, -1] / n
        cov = m[1:-1, 1:-1] - n * np.outer(mx, mx)
        sd = np.sqrt(np.maximum(np.diag(cov) / n, 0.0))
        sd[sd < 1e-12] = 1.0
        A = cov / np.outer(sd, sd)
        b = (m[1:-1, -1] - n * mx * my) / sd
        val, vec = np.linalg.eigh(A)
        return n, mx, my, sd, np.maximum(val, 0.0), vec, b

    fits = [prepare(total - per_fold[f]) for f in range(k)] + [prepare(total)]

    def loo(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        err = np.zeros((k + 1, len(alphas)))
        for b in batches:
            X, y, fold = np.stack(b["x"].to_numpy()), b["y"].to_numpy(float), b["fold"].to_numpy()
            for f, (n, mx, my, sd, val, vec, rhs) in enumerate(fits):
                keep = fold != f
                Z = ((X[keep] - mx) / sd) @ vec
                rb = vec.T @ rhs
                for a, alpha in enumerate(alphas):
                    inv = 1.0 / (val + alpha)
                    h = 1.0 / n + (Z * Z) @ inv
                    e = y[keep] - my - Z @ (inv * rb)
                    err[f, a] += np.sum((e / np.maximum(1 - h, 1e-12)) ** 2)
        f, a = np.indices(err.shape)
        yield pd.DataFrame({"f": f.ravel(), "a": a.ravel(), "e": err.ravel()})

    errs = df.select("fold", "x", "y").mapInPandas(loo, "f int, a int, e double").groupBy("f", "a").agg(F.sum("e").alias("e")).collect()
    table = np.zeros((k + 1, len(alphas)))
    for r in errs:
        table[r["f"], r["a"]] = r["e"]
    chosen = [alphas[i] for i in table.argmin(axis=1)]
    betas = []
    for (n, mx, my, sd, val, vec, rhs), alpha in zip(fits, chosen):
        betas.append((my, mx, sd, vec @ ((vec.T @ rhs) / (val + alpha))))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            X, fold = np.stack(b["x"].to_numpy()), b["fold"].to_numpy()
            out, base = np.empty(len(b)), np.empty(len(b))
            for f in range(k):
                my, mx, sd, beta = betas[f]
                out[fold == f] = my + ((X[fold == f] - mx) / sd) @ beta
                base[fold == f] = my
            yield pd.DataFrame({"id": b["id"], "fold": fold, "y": b["y"], "predicted": out, "baseline": base})

    kind = df.schema["id"].dataType.simpleString()
    pred = df.select("id", "fold", "x", "y").mapInPandas(predict, f"id {kind}, fold int, y double, predicted double, baseline double")
    return pred, {"alpha": float(chosen[-1]), "coefficients": betas[-1][3].tolist()}


def regression_metrics(pred: DataFrame) -> DataFrame:
    e, b = F.col("y") - F.col("predicted"), F.col("y") - F.col("baseline")
    return pred.agg(
        F.count("*").alias("n"),
        (1 - F.sum(e * e) / F.when(F.var_pop("y") > 0, F.var_pop("y") * F.count("*"))).alias("r2"),
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(b)).alias("baseline_mae"), F.sqrt(F.avg(b * b)).alias("baseline_rmse"))
