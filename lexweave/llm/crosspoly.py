"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates unit vectors by three rounds of random signs and a fast
Hadamard transform and gives each the nearest signed axis (``hashes`` of them,
joined).  A query visits its ``probes`` nearest axes in every table, and what
lies there is ranked by exact cosine in double precision.

``probes`` is fitted on a bounded sample of the index (``SAMPLE`` vectors, by
hash of the id; ``SAMPLE_QUERIES`` of them as queries) as the smallest number
that reaches the target recall there.  Every vector is indexed.  Neighbours
are nearer in the whole index than in a sample of it, which helps recall.

Equal vectors are indexed once with their smallest ids (k + 1 of them, all that
a result can need), and equal queries are searched once.  Buckets are cut into
blocks of bounded size and meet their queries block by block; each block gives
its best k + 1 per query.

Vectors that are null, zero or hold null or non-finite values take no part, as
index or query.  Vectors of different lengths are never compared.  Rows with a
null id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import top_per_group

K = 5
TABLES = 8
HASHES = 1
RECALL = 0.97
SAMPLE, SAMPLE_QUERIES = 4096, 256
BLOCK_ROWS = 8192
SEED = 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the normalised Hadamard matrix; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def axis_scores(x: np.ndarray, table: int, number: int) -> np.ndarray:
    """Rotated rows against all signed axes: axis i at 2i, its negative at 2i + 1."""
    width = 1 << max(x.shape[1] - 1, 0).bit_length()
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng([SEED, table, number, width]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        out = hadamard(out * s)
    return np.stack((out, -out), 2).reshape(len(x), 2 * width)


def probes_of(x: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    """The nearest ``probes`` buckets of every row, nearest first."""
    codes, total = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for number in range(hashes):
        score = axis_scores(x, table, number)
        axes = score.shape[1]
        both = (total[:, :, None] + score[:, None, :]).reshape(len(x), -1)
        code = (codes[:, :, None] * axes + np.arange(axes)[None, None, :]).reshape(len(x), -1)
        best = np.argsort(-both, 1, kind="stable")[:, :probes]
        total, codes = np.take_along_axis(both, best, 1), np.take_along_axis(code, best, 1)
    return codes


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_probes(x: np.ndarray, tables: int, hashes: int, recall: float, k: int = K) -> int:
    """Smallest number of probes with the recall on the sample ``x`` (unit rows)."""
    if len(x) < 2:
        return 1
    q = np.arange(min(SAMPLE_QUERIES, len(x)))
    score = x[q] @ x.T
    score[q, q] = -np.inf
    near = np.argsort(-score, 1)[:, : min(k, len(x) - 1)]
    most = (2 << max(x.shape[1] - 1, 0).bit_length()) ** hashes
    place = np.full((len(q), near.shape[1]), most)  # the first probe that finds the neighbour
    for t in range(tables):
        bucket = probes_of(x, t, hashes, 1)[:, 0]
        for i, row in enumerate(probes_of(x[q], t, hashes, most)):
            rank = np.empty(most, np.int64)
            rank[row] = np.arange(most)
            place[i] = np.minimum(place[i], rank[bucket[near[i]]])
    return min(most, int(np.quantile(place, recall, method="higher")) + 1)


def _matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _bucketed(tables: int, hashes: int, probes: int, carry: list[str]):
    """One row per table and visited bucket; dimensions may differ between rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(rows))
                x = unit(_matrix(part.column("v")))
                for t in range(tables):
                    codes = probes_of(x, t, hashes, probes)
                    again = np.repeat(np.arange(len(x)), codes.shape[1])
                    out = part.take(pa.array(again))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(again), t, np.int32)), pa.array(codes.ravel()), *[out.column(c) for c in carry]], names=["tab", "bucket", *carry])

    return run


def _best(k: int):
    def run(key: tuple, index: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["qk", "rep", "ids", "score"]
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64()]
        if not index.num_rows or not queries.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        raw, asked = _matrix(index.column("v")), _matrix(queries.column("v"))
        x, q = unit(raw), unit(asked)
        rep = index.column("rep").to_numpy()
        picked, who, exact = [], [], []
        for at in range(0, len(q), 256):
            score = q[at : at + 256] @ x.T
            m = min(k, len(x))
            floor = np.partition(score, len(x) - m, 1)[:, len(x) - m] - 1e-9
            for i, row in enumerate(score):
                near = np.flatnonzero(row >= floor[i])
                s = (x[near] * q[at + i]).sum(1)  # the same sum wherever the pair meets
                best = near[np.lexsort((rep[near], -s))[:m]]
                picked.append(best)
                who.append(np.full(len(best), at + i))
                exact.append(np.sort(s)[::-1][:m])
        picked, who = np.concatenate(picked), np.concatenate(who)
        return pa.table([queries.column("qk").take(pa.array(who)), index.column("rep").take(pa.array(picked)), index.column("ids").take(pa.array(picked)), pa.array(np.concatenate(exact))], names=names)

    return run


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, dim) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    good = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(vec_col).alias("dim"))


def search(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, hashes: int = HASHES, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, the k
    nearest other rows found, nearest first, ties to the smaller id."""
    rows = valid(vectors, id_col, vec_col)
    asking = valid(vectors.where(is_query), id_col, vec_col)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v", "dim").toArrow()
    dims = sample.column("dim").to_numpy()
    common = np.bincount(dims).argmax() if len(dims) else 1
    probes = fit_probes(unit(_matrix(sample.filter(pa.array(dims == common)).column("v"))), tables, hashes, recall, k) if len(dims) else 1

    few = top_per_group(rows.distinct(), ["v"], [F.asc("id")], k + 1)
    index = few.groupBy("v", "dim").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("rep", F.get("ids", F.lit(0)))
    entries = index.mapInArrow(_bucketed(tables, hashes, 1, ["rep", "dim", "v", "ids"]), "tab int, bucket long, rep long, dim int, v array<double>, ids array<long>")
    keyed = asking.select(F.col("id").alias("query_id"), F.xxhash64("v").alias("qk"), "v", "dim")
    distinct = keyed.groupBy("v", "dim").agg(F.min("qk").alias("qk"))
    visits = distinct.mapInArrow(_bucketed(tables, hashes, probes, ["qk", "dim", "v"]), "tab int, bucket long, qk long, dim int, v array<double>")
    sizes = entries.groupBy("tab", "dim", "bucket").agg(F.ceil(F.count("*") / F.lit(float(BLOCK_ROWS))).cast("int").alias("blocks"))
    key = ["tab", "dim", "bucket"]
    left = entries.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("blocks")
    right = visits.join(sizes, key).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    by = [*key, "block"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_best(k + 1), "qk long, rep long, ids array<long>, score double")
    once = found.groupBy("qk", "rep", "ids").agg(F.max("score").alias("score"))
    near = top_per_group(once, ["qk"], [F.desc("score"), F.asc("rep")], k + 1, "_at").select("qk", "ids", "score")
    flat = near.select("qk", "score", F.explode("ids").alias("vec_id"))
    named = keyed.select("query_id", "qk").distinct().join(flat, "qk").where(F.col("vec_id") != F.col("query_id"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
