"""Quality classifier by co-training on two views of a document.

The text view sees words and word shapes; the page view sees metadata (language,
source, length) and layout (lines, line length, share of distinct lines).  Each
view has a logistic model.  In every round each view scores all unlabelled
documents and hands the most confident ones, in the proportions of the labels,
to the other view's training set.  Both are then calibrated on labelled
documents kept aside, and their log odds over the prior are added up and
calibrated again.  A document is good if its quality label is 1 and its toxic
label is not.

The training sets are bounded: at most ``max_labelled`` labelled documents, by
hash of the id, and at most ``max_given`` pseudo-labels from a view in a round,
chosen out of everything.  Each round and the final scoring are one map pass
over all documents; a round's training rows are a table, so no plan grows.

Null values are values of their own ("lang=null"); null text has no words.
Labels without id or quality don't count; of several labels for one id the worst
holds, and of several texts for one id the one with the smallest hash trains.  If the labels lack one of the classes, there is nothing to tell apart:
every score is the share of good labels (1 without labels).
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import top_per_group
from ..session import scratch_path
from .words import give_back, text_batches

MAX_LABELLED = 20_000
MAX_GIVEN = 1_000
FIT_PARTITIONS = 2  # the samples are bounded, and an iteration is one small job
ROUNDS = 2
CONFIDENT = 0.95
REG = 4e-4  # absolute values: few of the words tell anything
VOCABULARY = 1 << 16
MIN_DOCS = 2  # training documents that hold a token; the penalty chooses among the rest
FEW = 50  # with fewer training documents any token counts
VIEWS = ("text", "page")
_SHAPE = bytes(88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256))
_EDGES = b".,;:!?()[]{}\"'"


def text_tokens(text: str | None) -> set[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = {w.strip(_EDGES) for w in raw.lower().split()}
    words.discard(b"")
    for shape in set(raw.translate(_SHAPE).split()):
        short = bytes(b for i, b in enumerate(shape) if i == 0 or b != shape[i - 1])
        words.add(b"\x01" + short[:8])
    return words


def _step(name: str, value: float | None) -> bytes:
    """A number as a step of powers of two."""
    return f"{name}={'null' if value is None else int(math.log2(1 + max(0, value)) * 2)}".encode()


def page_tokens(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> set[bytes]:
    lines = (text or "").split("\n")
    return {
        f"lang={lang if lang is not None else 'null'}".encode("utf-8", "surrogatepass"), f"source={source if source is not None else 'null'}".encode("utf-8", "surrogatepass"),
        _step("chars", n_chars), _step("lines", len(lines)), _step("line", len(text or "") / len(lines)), f"distinct={round(10 * len(set(lines)) / len(lines))}".encode()}


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, page = [], []
        for t, lang, source, n in zip(batch.column("text"), *(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars"))):
            t = t.as_py()
            text.append(sorted(w.decode("latin-1") for w in text_tokens(t)))
            page.append(sorted(w.decode("latin-1") for w in page_tokens(t, lang, source, n)))
        kind = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "good", "aside")], pa.array(text, kind), pa.array(page, kind)], names=["doc_id", "good", "aside", "text", "page"])


class View:
    """Token weights of a fitted model, and its calibration."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias, self.scale, self.shift = weights, bias, 1.0, 0.0

    def margin(self, tokens: set[bytes]) -> float:
        get = self.weights.get
        return self.bias + sum(get(w, 0.0) for w in tokens)

    def log_odds(self, tokens: set[bytes]) -> float:
        return self.scale * self.margin(tokens) + self.shift


def release(spark: SparkSession) -> None:
    """Let the driver drop what earlier fits left: Spark removes broadcasts, shuffle
    files and generated code only once their last references are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back()


def _fit(rows: DataFrame, view: str, reg: float) -> LogisticRegressionModel:
    return LogisticRegression(featuresCol=f"{view}_v", labelCol="y", maxIter=25, regParam=reg, elasticNetParam=1.0, standardization=False).fit(rows.coalesce(FIT_PARTITIONS))


def platt(margins: np.ndarray, good: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Scale and shift that make log odds of margins, by Newton steps with a weak prior."""
    n1 = good.sum()
    n0 = len(good) - n1
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g, w = p - target, p * (1 - p) + 1e-9
        grad = np.array([(g * margins).sum() + 1e-3 * a, g.sum() + 1e-3 * b])
        hess = np.array([[(w * margins * margins).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        size = max(1.0, float(np.abs(step).max()) / 4)
        a, b = a - step[0] / size, b - step[1] / size
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


class CoTrained:
    """The fitted pair of views."""

    def __init__(self, views: dict[str, View] | None, prior: float):
        self.views, self.prior, self.scale, self.shift = views, prior, 1.0, 0.0

    def scores(self, text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> tuple[float, float, float]:
        if self.views is None:
            return (self.prior,) * 3
        base = math.log(self.prior / (1 - self.prior))
        t, p = self.views["text"].log_odds(text_tokens(text)), self.views["page"].log_odds(page_tokens(text, lang, source, n_chars))
        both = self.scale * (t + p - base) + self.shift
        return sigmoid(t), sigmoid(p), sigmoid(both)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def judged(labels: DataFrame) -> DataFrame:
    """(_id, good) of every labelled id."""
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        (F.min((F.col("quality") == 1).cast("int")) * (1 - F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")))).alias("good"))


def readable(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")], F.col("n_chars").cast("long").alias("n_chars"))


def tokenised(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, good, aside, text, page) of the ids in ``wanted``, a bounded table (_id, good, aside)."""
    rows = docs.join(F.broadcast(wanted), F.col("doc_id") == F.col("_id")).drop("_id")
    first = F.struct(F.xxhash64("text"), F.xxhash64("lang", "source", "n_chars"))
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "doc_id"]), first).alias("r")).select("doc_id", "r.*")
    return one.mapInArrow(_tokenised, "doc_id long, good int, aside boolean, text array<string>, page array<string>")


def _confident(views: dict[str, View], bar: float):
    """(doc_id, view, good, p) of every document that a view is sure of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, doc, *rest in zip(batch.column("text"), *(batch.column(c).to_pylist() for c in ("doc_id", "lang", "source", "n_chars"))):
                t = t.as_py()
                for view, tokens in (("text", text_tokens(t)), ("page", page_tokens(t, *rest))):
                    p = sigmoid(views[view].margin(tokens))
                    if max(p, 1 - p) >= bar:
                        out.append((doc, view, int(p >= 0.5), max(p, 1 - p)))
            cols = list(zip(*out)) or [()] * 4
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "view", "good", "p"])
            give_back()

    return run


def pseudo_labels(docs: DataFrame, known: DataFrame, views: dict[str, View], most: dict[int, int], given: set[int]) -> dict[str, dict[int, float]]:
    """For each view the labels of its most confident documents, at most
    ``most[label]`` of them, out of all that have no label and were not given."""
    sure = docs.mapInArrow(_confident(views, CONFIDENT), "doc_id long, view string, good int, p double")
    new = sure.join(known.select(F.col("_id").alias("doc_id")), "doc_id", "left_anti")
    new = new.groupBy("doc_id", "view", "good").agg(F.max("p").alias("p"))  # an id may have several texts, and two labels
    ranked = top_per_group(new, ["view", "good"], [F.desc("p"), F.asc(F.xxhash64("doc_id")), F.asc("doc_id")], 2 * max(most.values()) + len(given))
    out: dict[str, dict[int, float]] = {v: {} for v in VIEWS}
    left = {(v, g): most[g] for v in VIEWS for g in (0, 1)}
    for r in ranked.orderBy("view", "good", "rn").toArrow().to_pylist():  # at most four times that many rows
        if left[r["view"], r["good"]] and r["doc_id"] not in given and r["doc_id"] not in out[r["view"]]:
            out[r["view"]][r["doc_id"]] = float(r["good"])
            left[r["view"], r["good"]] -= 1
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_given: int = MAX_GIVEN, rounds: int = ROUNDS, reg: float = REG) -> CoTrained:
    spark = docs.sparkSession
    text_batches(spark)
    docs = readable(docs)

    def table(rows: DataFrame, name: str) -> DataFrame:
        at = scratch_path(spark, name)
        rows.write.parquet(at)
        return spark.read.parquet(at)

    known = table(judged(labels), "judged")
    chosen = known.join(docs.select(F.col("doc_id").alias("_id")).distinct(), "_id").orderBy(F.xxhash64(F.lit(17), "_id"), "_id").limit(max_labelled)
    rows = table(tokenised(docs, chosen.withColumn("aside", F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(5)) == 0)), "labelled")
    seen = dict(rows.groupBy("good").count().collect())
    n0, n1 = seen.get(0, 0), seen.get(1, 0)
    if not n0 or not n1:
        return CoTrained(None, 1.0 if not n0 else 0.0)
    prior = n1 / (n0 + n1)
    words: dict[str, CountVectorizerModel] = {}
    least = MIN_DOCS if n0 + n1 >= FEW else 1
    for v in VIEWS:
        words[v] = CountVectorizer(inputCol=v, outputCol=f"{v}_v", binary=True, vocabSize=VOCABULARY, minDF=least).fit(rows.where("not aside"))

    def vectors(tokens: DataFrame, name: str) -> DataFrame:
        for v in VIEWS:
            tokens = words[v].transform(tokens)
        return table(tokens.select("doc_id", "good", "aside", F.col("good").cast("double").alias("y"), *[f"{v}_v" for v in VIEWS]).coalesce(FIT_PARTITIONS), name)

    own = vectors(rows, "vectors")
    training = {v: own.where("not aside").select("y", f"{v}_v") for v in VIEWS}
    given: set[int] = set()
    most = {1: int(max_given * prior), 0: int(max_given * (1 - prior))}
    for number in range(rounds + 1):
        models = {}
        for v in VIEWS:
            models[v] = _fit(training[v], v, reg)
            release(spark)
        views = {v: View({w.encode("latin-1"): float(c) for w, c in zip(words[v].vocabulary, models[v].coefficients.toArray()) if c}, float(models[v].intercept)) for v in VIEWS}
        if number == rounds:
            break
        found = pseudo_labels(docs, known, views, most, given)
        if not any(found.values()):
            break
        given |= {i for g in found.values() for i in g}
        for v, other in zip(VIEWS, VIEWS[::-1]):
            if found[v]:
                named = spark.createDataFrame([(i, int(y), False) for i, y in found[v].items()], "_id long, good int, aside boolean")
                training[other] = training[other].unionByName(vectors(tokenised(docs, named), "given").select("y", f"{other}_v"))
    fitted = CoTrained(views, prior)
    aside = own.where("aside")
    for v in VIEWS:
        models[v].setProbabilityCol("").setPredictionCol("").setRawPredictionCol(f"{v}_m")
        aside = models[v].transform(aside)
    kept = aside.select("good", *[F.get(vector_to_array(f"{v}_m"), F.lit(1)).alias(v) for v in VIEWS]).toArrow()  # at most max_labelled rows
    good = kept.column("good").to_numpy() == 1
    if good.any() and not good.all():
        odds = np.zeros(len(good))
        for v in VIEWS:
            margins = kept.column(v).to_numpy()
            views[v].scale, views[v].shift = platt(margins, good)
            odds += views[v].scale * margins + views[v].shift
        fitted.scale, fitted.shift = platt(odds - math.log(prior / (1 - prior)), good)
    del models, training, own, rows, aside
    release(spark)
    return fitted


def score(docs: DataFrame, model: CoTrained, threshold: float = 0.5) -> DataFrame:
    """``docs`` with text_score, page_score, quality_score (chance of a good
    document) and keep; they replace columns of these names."""
    text_batches(docs.sparkSession)
    docs = docs.drop("text_score", "page_score", "quality_score", "keep")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    names = docs.columns
    position = {c: names.index(c) for c in ("text", "lang", "source", "n_chars")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source, n = (batch.column(position[c]).to_pylist() for c in ("lang", "source", "n_chars"))
            found = [model.scores(t.as_py(), *rest) for t, *rest in zip(batch.column(position["text"]), lang, source, n)]
            cols = [pa.array([f[i] for f in found], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols, pa.array([f[2] >= threshold for f in found], pa.bool_())], names=[*names, "text_score", "page_score", "quality_score", "keep"])
            give_back()

    return docs.mapInArrow(run, f"{fields}, text_score double, page_score double, quality_score double, keep boolean")
