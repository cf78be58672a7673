"""Stylometric counts, distances, neighbours and group separation.

Counts are long tables (unit, feature, n); no wide matrix is built.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import length_bin
from ..session import cut, written
from .pairs import pairs_within
from .scan import md5_key, top_per_group

# Parts of speech counted as function words.
FUNCTION_UPOS = ("ADP", "AUX", "CCONJ", "DET", "PART", "PRON", "SCONJ")


def _feature(name: str, *parts: Column, when: Column) -> Column:
    return F.when(when, F.concat(F.lit(name + ":"), F.concat_ws(":", *parts)))


def morphosyntax_counts(tokens: DataFrame, unit: Sequence[str], sentence: Sequence[str]) -> DataFrame:
    """Counts of syntactic features per unit.

    Tokens carry (index, upos, deprel, head, feats array).  A token meets its
    head through a left join inside its sentence; every feature of a token then
    comes out of one ``inline`` and is combined map-side.
    """
    sent = list(dict.fromkeys([*unit, *sentence]))
    upos, rel = F.upper(F.coalesce("upos", F.lit(""))), F.lower(F.coalesce("deprel", F.lit("")))
    t = tokens.withColumn("upos", upos).withColumn("deprel", rel)
    heads = t.groupBy(*sent, F.col("index").alias("head")).agg(F.max("upos").alias("head_upos"))
    t = t.join(heads, [*sent, "head"], "left")
    word = (F.col("upos") != "") & (F.col("upos") != "PUNCT")
    arc = (F.col("deprel") != "") & (F.col("deprel") != "punct")
    root = F.coalesce(F.col("head"), F.lit(0)) == 0
    linked = ~root & (F.coalesce("head_upos", F.lit("")) != "") & word & (F.col("deprel") != "punct")
    side = F.when(F.col("head") > F.col("index"), "left").otherwise("right")
    feats = F.transform("feats", lambda f: F.concat(F.lit("feat:"), f))
    singles = F.array_compact(F.array(
        _feature("upos", F.col("upos"), when=word),
        _feature("deprel", F.col("deprel"), when=arc),
        _feature("deprel_upos", F.col("deprel"), F.col("upos"), when=word & arc),
        _feature("root_upos", F.col("upos"), when=root & word),
        _feature("head_child_upos", F.concat("head_upos", F.lit(">"), "upos"), when=linked),
        _feature("head_direction", F.col("deprel"), side, when=linked),
    ))
    per_token = t.select(*unit, F.explode(F.concat(singles, F.coalesce(feats, F.array().cast("array<string>")))).alias("feature"))
    bins = t.groupBy(*sent).agg(F.count_if(word | (F.col("upos") == "")).alias("w")).where("w > 0").withColumn("b", length_bin(F.col("w")))
    label = F.concat(F.lit("sentence_len_bin:"), F.lpad(F.col("b").cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("b") + 4).cast("string"), 2, "0"))
    return per_token.unionByName(bins.select(*unit, label.alias("feature"))).groupBy(*unit, "feature").agg(F.count("*").alias("n"))


def dependency_paths(tokens: DataFrame, sentence: Sequence[str]) -> DataFrame:
    """(sentence…, index, path, steps): the ``deprel-upos`` steps from the
    sentence's root down to every token.

    Pointer doubling: a token takes over its ancestor's ancestor and path, so
    rounds grow with the logarithm of the depth, and no sentence is gathered.  A
    head of 0 or null is the root's.  A token under a missing head or inside or
    below a cycle has no path (null).  Of tokens with one index the first by
    head, relation and part of speech counts.
    """
    keys = list(sentence)
    step = F.struct(F.coalesce("head", F.lit(0)).alias("up"), F.concat_ws("-", F.coalesce("deprel", F.lit("")), F.coalesce("upos", F.lit(""))).alias("path"))
    state = written(tokens.groupBy(*keys, "index").agg(F.min(step).alias("_s")).select(*keys, "index", F.col("_s.up").cast("long").alias("up"), "_s.path", F.lit(1).alias("steps")))
    longest = state.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    whole, open_ = state.where("up = 0"), state.where("up <> 0")
    # after this many doublings a path would have more steps than the sentence has tokens
    for _ in range(int(longest).bit_length()):
        if open_.isEmpty():
            break
        above = whole.unionByName(open_).select(*keys, F.col("index").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("steps").alias("_steps"))
        state = written(whole.unionByName(open_.join(above, [*keys, "up"]).select(
            *keys, "index", F.col("_up").alias("up"), F.concat_ws(">", "_path", "path").alias("path"), (F.col("_steps") + F.col("steps")).alias("steps"))))
        whole, open_ = state.where("up = 0"), state.where("up <> 0")
    return tokens.select(*keys, "index").distinct().join(whole.drop("up"), [*keys, "index"], "left")


def path_counts(tokens: DataFrame, unit: Sequence[str], sentence: Sequence[str]) -> DataFrame:
    """(unit…, feature, n) of the tokens' dependency paths; ``malformed`` counts tokens without one."""
    sent = list(dict.fromkeys([*unit, *sentence]))
    return dependency_paths(tokens, sent).groupBy(*unit, F.coalesce("path", F.lit("malformed")).alias("feature")).agg(F.count("*").alias("n"))


def function_words(tokens: DataFrame, unit: Sequence[str], upos_set: Sequence[str] = FUNCTION_UPOS) -> DataFrame:
    """Function-word profile counts from (upos, form, deprel) tokens."""
    upos, rel, form = F.upper("upos"), F.lower(F.coalesce("deprel", F.lit(""))), F.lower("form")
    has = F.rlike(form, F.lit(r"[\p{L}\p{N}_]"))
    items = F.array_compact(F.array(
        _feature("func_upos", upos, when=F.lit(True)),
        _feature("func", form, when=has),
        _feature("func_form_upos", form, upos, when=has),
        _feature("func_deprel", rel, when=(rel != "") & (rel != "punct")),
    ))
    return tokens.where(upos.isin(*upos_set)).select(*unit, F.explode(items).alias("feature")).groupBy(*unit, "feature").agg(F.count("*").alias("n"))


def select_features(counts: DataFrame, k: int, min_count: int = 1) -> DataFrame:
    """The k most frequent features with at least ``min_count`` occurrences;
    when none reaches it, the k most frequent of all."""
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    ok = F.col("total") >= min_count
    # Features that reach the count sort first, so one top-k serves both rules.
    top = totals.withColumn("_ok", ok).orderBy(F.desc("_ok"), F.desc("total"), "feature").limit(k)
    any_ok = top.agg(F.bool_or("_ok")).scalar()
    return top.where(F.col("_ok") | ~any_ok).select("feature", "total")


def relative_frequencies(counts: DataFrame, selected: DataFrame) -> DataFrame:
    """n / all features of the unit, for the selected features."""
    total = counts.groupBy("unit").agg(F.sum("n").alias("_t"))
    return counts.join(selected.select("feature"), "feature", "left_semi").join(total, "unit").select(
        "unit", "feature", (F.col("n") / F.col("_t")).alias("v"))


def unit_vectors(rel: DataFrame) -> DataFrame:
    norm = rel.groupBy("unit").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_n"))
    return rel.join(norm, "unit").select("unit", "feature", (F.col("v") / F.col("_n")).alias("u"))


def cosine_distances(rel: DataFrame) -> DataFrame:
    """Distance of every pair of units, a < b; meant for a list of units small
    enough to print as a matrix (use ``knn`` or ``separation`` beyond that)."""
    u = unit_vectors(rel)
    dots = pairs_within(u, ["feature"], "unit", ["u"]).groupBy(F.col("unit_a").alias("a"), F.col("unit_b").alias("b")).agg(
        F.sum(F.col("u_a") * F.col("u_b")).alias("dot"))
    everyone = pairs_within(u.select("unit").distinct().withColumn("all", F.lit(1)), ["all"], "unit").select(F.col("unit_a").alias("a"), F.col("unit_b").alias("b"))
    sim = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("dot", F.lit(0.0))))
    return everyone.join(dots, ["a", "b"], "left").select("a", "b", (1 - sim).alias("distance"))


def separation(vectors: DataFrame, flag: str) -> DataFrame:
    """Mean cosine distance within the flagged units, within the rest and
    between them.

    The mean cosine of all pairs of a group is (|sum of unit vectors|^2 - n) /
    (n (n-1)), and between groups it is the product of the two sums, so no pair
    is ever formed.  ``vectors`` is (unit, flag, feature, u).
    """
    f = F.col(flag)
    n = vectors.select("unit", flag).distinct().agg(F.count_if(f).alias("np"), F.count_if(~f).alias("nn"))
    sums = vectors.groupBy("feature").agg(
        F.sum(F.when(f, F.col("u")).otherwise(0.0)).alias("p"), F.sum(F.when(~f, F.col("u")).otherwise(0.0)).alias("q"))
    s = sums.agg(F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("q") * F.col("q")).alias("qq"), F.sum(F.col("p") * F.col("q")).alias("pq"))
    np_, nn = n.select("np").scalar().cast("double"), n.select("nn").scalar().cast("double")
    wp = F.when(np_ > 1, 1 - (F.col("pp") - np_) / (np_ * (np_ - 1)))
    wn = F.when(nn > 1, 1 - (F.col("qq") - nn) / (nn * (nn - 1)))
    between = F.when((np_ > 0) & (nn > 0), 1 - F.col("pq") / (np_ * nn))
    out = s.select(wp.alias("within_positive"), wn.alias("within_negative"), between.alias("between"))
    inner = F.coalesce((F.col("within_positive") + F.col("within_negative")) / 2, "within_positive", "within_negative")
    return out.withColumn("separation", F.col("between") - inner)


def feature_deltas(rel: DataFrame, flags: DataFrame, flag: str) -> DataFrame:
    """Mean relative frequency per feature in and outside the flagged units."""
    n = flags.agg(F.count_if(F.col(flag)).alias("p"), F.count_if(~F.col(flag)).alias("q"))
    s = rel.join(flags, "unit").groupBy("feature").agg(
        F.sum(F.when(F.col(flag), F.col("v")).otherwise(0.0)).alias("p"), F.sum(F.when(~F.col(flag), F.col("v")).otherwise(0.0)).alias("q"))
    a, b = F.col("p") / n.select("p").scalar(), F.col("q") / n.select("q").scalar()
    return s.select("feature", a.alias("positive_mean"), b.alias("negative_mean"), (a - b).alias("delta"))


def presence_rates(counts: DataFrame, groups: DataFrame, features: Sequence[str]) -> DataFrame:
    """Share of a group's units that have a feature, zero filled.

    ``counts`` is (unit, feature, n), ``groups`` is (unit, grp).
    """
    sizes = groups.groupBy("grp").agg(F.count("*").alias("units"))
    hits = counts.where(F.col("feature").isin(*features) & (F.col("n") > 0)).join(groups, "unit").groupBy("grp", "feature").agg(F.count("*").alias("hits"))
    grid = sizes.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    out = grid.join(hits, ["grp", "feature"], "left").fillna(0, ["hits"])
    return out.withColumn("rate", F.col("hits") / F.col("units"))


# Nearest neighbours ------------------------------------------------------

PIVOTS = 64
BLOCK = 32_000  # members of a tile; with half as many visitors 25 MB of 64 dimensions
CELLS = 2_000_000  # distances at a time, 16 MB


def nearest_in_tile(q: np.ndarray, qi: np.ndarray, c: np.ndarray, ci: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, nbr, distance) of the k members nearest to each visitor, ties to the
    smaller id, some visitors at a time."""
    order = np.argsort(ci, kind="stable")
    c, ci = c[order].T, ci[order]
    found: list[tuple[np.ndarray, ...]] = []
    step = max(1, CELLS // max(1, len(ci)))
    for at in range(0, len(qi), step):
        ids = qi[at : at + step]
        dist = q[at : at + step] @ c
        np.clip(np.subtract(1.0, dist, out=dist), 0.0, 2.0, out=dist)
        dist[ids[:, None] == ci[None, :]] = np.inf
        if k < len(ci):
            bar = np.partition(dist, k - 1, axis=1)[:, k - 1]
            row, col = np.nonzero(dist <= bar[:, None] + 2e-12)  # rounding may make ties of these
        else:
            row, col = np.nonzero(np.ones(dist.shape, bool))
        d = np.round(dist[row, col], 12)
        by = np.lexsort((col, d, row))
        row, col, d = row[by], col[by], d[by]
        first = np.searchsorted(row, np.arange(len(ids)))
        keep = (np.arange(len(row)) - first[row] < k) & np.isfinite(d)
        found.append((ids[row[keep]], ci[col[keep]], d[keep]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (qi, qi, np.zeros(0))


def knn(df: DataFrame, k: int, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """Exact k nearest neighbours by cosine distance of (id, vec).

    Vectors are scaled to unit length and assigned to the nearest of a fixed
    number of pivots.  A point only visits the cells that can hold one of its k
    nearest (distance to the pivot minus the cell's radius within a bound that
    provably covers k points).  Cells are put together, or hashed apart, to
    pieces of about ``block`` points, and a piece meets the points that visit
    it in blocks of about half as many: a tile, of bounded size however large the
    table is.  Each tile keeps the best k per visitor, so no pair list is
    shuffled.  Only the pivots and one count and radius per cell reach the driver.

    Where no cell can be left out the work is quadratic in the points, and so is
    the shuffle, by the square over ``block``.
    """
    points = df.select("id", F.col("vec").cast("array<double>").alias("vec"))
    seeds = points.orderBy(md5_key("id", seed="pivot"), "id").limit(pivots).collect()
    P = np.array([r["vec"] for r in seeds])
    P = P / np.maximum(np.linalg.norm(P, axis=1, keepdims=True), 1e-12)
    kind = df.schema["id"].dataType.simpleString()

    def stacked(v: pd.Series | list) -> np.ndarray:
        return np.frombuffer(b"".join(v)).reshape(len(v), -1)

    def to_pivots(m: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * m @ P.T))

    @F.pandas_udf("struct<cell:int,dist:double,vec:binary>")
    def assign(v: pd.Series) -> pd.DataFrame:
        m = np.stack(v.to_numpy())
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        d = to_pivots(m)
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "dist": d[np.arange(len(m)), cell], "vec": [x.tobytes() for x in m]})

    placed = cut(points.select("id", assign("vec").alias("a")).select("id", "a.cell", "a.dist", "a.vec"))
    stats = {r["cell"]: (r["n"], r["r"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("r")).collect()}
    counts = np.array([stats.get(i, (0, 0.0))[0] for i in range(len(P))])
    radii = np.array([stats.get(i, (0, 0.0))[1] for i in range(len(P))])
    # neighbouring cells share a piece up to its size; a larger cell has pieces of its own
    pieces: list[list[int]] = []
    room = n_pieces = 0
    for n in counts.tolist():
        if n > room:
            split = max(1, -(-n // block))
            pieces.append(list(range(n_pieces, n_pieces + split)))
            n_pieces, room = n_pieces + split, block - n if split == 1 else 0
        else:
            room -= n
            pieces.append([max(0, n_pieces - 1)])

    @F.pandas_udf("array<int>")
    def visits(v: pd.Series) -> pd.Series:
        d = to_pivots(stacked(v))
        far = np.where(counts > 0, d + radii, np.inf)
        order = np.argsort(far, axis=1)
        seen = np.cumsum(counts[order], axis=1)
        enough = np.minimum((seen < k + 1).sum(axis=1), len(P) - 1)
        bound = np.take_along_axis(far, np.take_along_axis(order, enough[:, None], 1), 1)
        ok = (d - radii <= bound + 1e-9) & (counts > 0)
        return pd.Series([sorted({p for c in np.flatnonzero(row) for p in pieces[c]}) for row in ok])

    blocks = max(1, -(-int(counts.sum()) * 2 // block))
    own = F.get(F.array(*[F.array(*[F.lit(p) for p in ps]) for ps in pieces]), F.col("cell"))
    vb = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).cast("int")
    cols = ["piece", "vb", "id", "vec", "member"]
    v = placed.select("id", "vec", F.explode(visits("vec")).alias("piece")).withColumn("vb", vb).withColumn("member", F.lit(False))
    m = placed.select("id", "vec", F.get(own, F.pmod(F.xxhash64("id"), F.size(own)).cast("int")).alias("piece"), F.lit(True).alias("member"))
    m = m.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def best(tile: pa.Table) -> pa.Table:
        inside = tile.column("member").to_numpy()
        ids = tile.column("id").to_numpy()
        vec = stacked(tile.column("vec").to_pylist())
        found = nearest_in_tile(vec[~inside], ids[~inside], vec[inside], ids[inside], k) if inside.any() and not inside.all() else (ids[:0], ids[:0], np.zeros(0))
        return pa.table({"id": pa.array(found[0], tile.schema.field("id").type), "nbr": pa.array(found[1], tile.schema.field("id").type), "distance": found[2]})

    part = v.select(*cols).unionByName(m.select(*cols)).groupBy("piece", "vb").applyInArrow(best, f"id {kind}, nbr {kind}, distance double")
    return top_per_group(part, ["id"], [F.asc("distance"), F.asc("nbr")], k)


def outliers(neighbours: DataFrame) -> DataFrame:
    """Outlier score: mean distance to the nearest neighbours."""
    return neighbours.groupBy("id").agg(F.avg("distance").alias("score"), F.min("distance").alias("nearest"))


def project_2d(df: DataFrame) -> DataFrame:
    """First two principal components of (id, vec), of the vectors less their mean;
    each axis points to where its largest weight is positive."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    v = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred").fit(v).transform(v)
    model = PCA(k=2, inputCol="centred", outputCol="pc").fit(v)
    axes = model.pc.toArray()
    sign = [1.0 if axes[abs(axes[:, i]).argmax(), i] > 0 else -1.0 for i in range(2)]
    xy = vector_to_array("pc")
    return model.transform(v).select("id", (xy[0] * sign[0]).alias("x"), (xy[1] * sign[1]).alias("y"))
