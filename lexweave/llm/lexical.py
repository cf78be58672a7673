"""Ranked lexical search over posting lists in geometric blocks.

A document's score for an item sums, over the item's terms, the term's weight
floor(1000 * ln((2N + 2) / (2df + 1))) times the integer impact of its frequency
tf and the document's length n, (1e9 * tf) div (1000 * tf + 20 * m) with
m = 50 + (50 * n * N) div L; N documents hold L terms, df of them this one.

Index.  Documents are read once and keep only terms of items (a bit array of
fixed size lets these through).  Each goes next to the two nearest of 32 pivot
documents (cosine of weighted impacts), and a range partitioning by that pair
puts similar documents into the same stretch.  In a stretch of at most
``CHUNK`` documents the posting list of a term, in this order, is cut into
blocks of ``BLOCK`` similar documents; a block's summary is the
coordinatewise maximum of its documents' impacts.

Search.  The terms of an item are ordered from the heaviest to the lightest.  A
list answers for the documents whose first term in this order is its own, so a
block's bound sums weight times summary over this term and the later ones.  A
block is skipped only if its bound is below the item's threshold, the k-th best
score known so far; the stretch as a whole is the block above all others, and
its bound drops the lists of light terms.  Documents of other blocks are scored
in full.  Thresholds come from samples of the documents (every 16th of the next,
and so on) and grow inside each task, so they are always scores that k documents
reach, and the result is exact.

Items go through in sets of a bounded number of terms; what one task holds does
not depend on the number of items or documents.

Terms are runs of ASCII letters and digits (lower-cased) and other characters.
Null and empty texts have none: such documents don't count, such items find
nothing.  Items of equal id and text are one; items of equal id and different
texts are ranked apart.  Equal documents are ranked each; ties go to the smaller
id, null last.  Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import top_per_group
from ..session import scratch_path
from .contain import bit_filter, passes
from .words import slices, text_batches, words_of

TOP = 50
CHUNK, BLOCK = 4096, 8
CELLS = 1 << 25  # documents times terms of a stretch in memory
SET_TERMS = 4096  # (item, term) pairs of a set of items, about
PIVOTS, PIVOT_TERMS = 32, 400
SAMPLE = 16  # one document of so many gives the first thresholds


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _term_counts(key: str, bits: np.ndarray | None):
    """(key, n, terms, counts): distinct terms of every text that has any; only
    terms that ``bits`` lets through, where given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"), alnum=True)
            n = words.counts()
            row, term = words.row, words.hash
            if bits is not None:
                hit = passes(bits, term)
                row, term = row[hit], term[hit]
            order = np.lexsort((term, row))
            row, term = row[order], term[order]
            first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])))) if len(row) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(row)))
            has = np.flatnonzero(n)
            at = np.append(np.searchsorted(row[first], has), len(first))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(has)), pa.array(n[has].astype(np.int64)), _lists(at, pa.array(term[first].view(np.int64))), _lists(at, pa.array(count.astype(np.int64)))],
                names=[key, "n", "terms", "counts"])

    return run


def _flat(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, ...]:
    """Offsets (from 0) and flat values of list columns of equal lengths."""
    out = []
    for name in names:
        col = batch.column(name)
        off = col.offsets.to_numpy()
        out.append(col.values.to_numpy()[off[0] : off[-1]])
    return (off - off[0], *out)


def _impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(1e9 * tf) div (1000 * tf + 20 * m), below a million."""
    return (1_000_000_000 * tf // (1000 * tf + 20 * m)).astype(np.int32)


def _placed(n_docs: int, n_terms: int, pivots: np.ndarray, terms: np.ndarray):
    """(doc_id, terms, impacts, p, q): impacts, and the two nearest pivots.
    ``pivots`` holds a row of unit coordinates for each of ``terms`` (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            off, term, tf = _flat(batch, "terms", "counts")
            m = 50 + 50 * batch.column("n").to_numpy() * n_docs // n_terms
            row = np.repeat(np.arange(batch.num_rows), np.diff(off))
            impact = _impacts(tf, m[row])
            near = np.zeros((batch.num_rows, max(pivots.shape[1], 2)), np.float32)
            if len(terms):
                at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
                known = np.flatnonzero(terms[at] == term)
                for p in range(pivots.shape[1]):
                    near[:, p] = np.bincount(row[known], pivots[at[known], p] * impact[known], batch.num_rows)
            two = np.argsort(-near, axis=1, kind="stable")[:, :2].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("terms"), _lists(off, pa.array(impact)), pa.array(two[:, 0]), pa.array(two[:, 1])], names=["doc_id", "terms", "impacts", "p", "q"])

    return run


def _pivots(forward: DataFrame, weights: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of ``count`` documents, picked by hash: (terms, terms x pivots)."""
    picked = forward.where(F.size("terms").between(8, PIVOT_TERMS)).orderBy(F.xxhash64("terms", "n"), "doc_id").limit(count).withColumn("pivot", F.monotonically_increasing_id())
    parts = picked.select("pivot", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("pivot", F.col("t.terms").alias("term"), F.col("t.counts").alias("tf"))
    rows = parts.join(weights, "term").select("pivot", "term", (F.col("w") * F.col("w") * F.col("tf") / (F.col("tf") + 1)).cast("float").alias("x")).toArrow()
    names, column = np.unique(rows.column("pivot").to_numpy(), return_inverse=True)
    terms, line = np.unique(rows.column("term").to_numpy(), return_inverse=True)
    out = np.zeros((len(terms), len(names)), np.float32)
    out[line, column] = rows.column("x").to_numpy()
    return terms, out / np.maximum(np.sqrt((out**2).sum(0)), 1e-9)


class _Items:
    """A set of items: their terms as numbers in the set's vocabulary, heaviest first."""

    def __init__(self, rows: list[dict], floor: dict[int, int]):
        self.keys = [r["ik"] for r in rows]
        self.vocabulary = np.unique(np.array([t["term"] for r in rows for t in r["terms"]], np.int64))
        self.terms, self.weights = [], []
        for r in rows:
            heaviest = sorted(r["terms"], key=lambda t: (-t["w"], t["term"]))
            self.terms.append(np.searchsorted(self.vocabulary, [t["term"] for t in heaviest]))
            self.weights.append(np.array([t["w"] for t in heaviest], np.int64))
        self.floor = np.array([max(floor.get(k, 1), 1) for k in self.keys], np.int64)


def _best(ids: np.ndarray, null: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, null, -score))[:k]


def _search_stretch(items: _Items, impacts: np.ndarray, ids: np.ndarray, null: np.ndarray, found: list, floor: np.ndarray, k: int, block: int, seen: np.ndarray) -> None:
    """Brings ``found`` (ids, null, score per item) and ``floor`` up to date with
    the documents of a stretch; ``impacts`` is vocabulary x documents."""
    top = impacts.max(axis=1).astype(np.int64)
    lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i, (terms, w) in enumerate(zip(items.terms, items.weights)):
        rest = np.cumsum((w * top[terms])[::-1])[::-1]  # bound of what begins at each term
        for j in range(int(np.count_nonzero(rest >= floor[i]))):
            t = int(terms[j])
            if t not in lists:
                docs = np.flatnonzero(impacts[t])
                lists[t] = docs, np.arange(0, len(docs), block)
            docs, starts = lists[t]
            if not len(docs):
                continue
            mine = impacts[terms[j:, None], docs]
            summary = np.maximum.reduceat(mine, starts, axis=1)
            kept = w[j:] @ summary.astype(np.int64) >= floor[i]
            seen += (len(kept), np.count_nonzero(kept))
            if not kept.any():
                continue
            inside = np.flatnonzero(np.repeat(kept, np.diff(np.append(starts, len(docs)))))
            score = w[j:] @ mine[:, inside].astype(np.int64)
            good = score >= floor[i]
            hit, score = docs[inside[good]], score[good]
            if j and len(hit):  # those with an earlier term were met in its list
                new = ~impacts[terms[:j, None], hit].any(axis=0)
                hit, score = hit[new], score[new]
            if not len(hit):
                continue
            have = found[i]
            merged = [np.concatenate(pair) for pair in zip(have, (ids[hit], null[hit], score))]
            best = _best(*merged, k)
            found[i] = tuple(c[best] for c in merged)
            if len(best) == k:
                floor[i] = max(floor[i], found[i][2][-1])


def _search(items: _Items, k: int, chunk: int, block: int):
    size = max(1, min(chunk, CELLS // max(len(items.vocabulary), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        found, floor, seen = [(none, none.astype(bool), none)] * len(items.keys), items.floor.copy(), np.zeros(2, np.int64)
        impacts = np.zeros((len(items.vocabulary), size), np.int32)
        ids, null, used = np.zeros(size, np.int64), np.zeros(size, bool), 0

        def search() -> None:
            _search_stretch(items, impacts[:, :used], ids[:used], null[:used], found, floor, k, block, seen)

        for batch in batches:
            at = 0
            while at < batch.num_rows and len(items.vocabulary):
                part = batch.slice(at, min(size - used, batch.num_rows - at))
                off, term, impact = _flat(part, "terms", "impacts")
                row = np.repeat(np.arange(part.num_rows), np.diff(off)) + used
                line = np.minimum(np.searchsorted(items.vocabulary, term), len(items.vocabulary) - 1)
                hit = np.flatnonzero(items.vocabulary[line] == term)
                impacts[:, used : used + part.num_rows] = 0
                impacts[line[hit], row[hit]] = impact[hit]
                null[used : used + part.num_rows] = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                ids[used : used + part.num_rows] = part.column("doc_id").fill_null(0).to_numpy()
                used, at = used + part.num_rows, at + part.num_rows
                if used == size:
                    search()
                    used = 0
        if used:
            search()
        for i, (doc, none_id, score) in enumerate(found):
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), items.keys[i])), pa.array(doc, mask=none_id), pa.array(score)], names=["ik", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP, chunk: int = CHUNK, block: int = BLOCK, set_terms: int = SET_TERMS, sample: int = SAMPLE,
           doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, scores
    above 0.  Runs jobs while it is called."""
    spark = docs.sparkSession
    text_batches(spark)
    tests = items.select(F.xxhash64(F.col(item_id), F.col(text)).alias("ik"), F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")).dropDuplicates(["ik"])
    at = scratch_path(spark, "items")
    tests.select("ik", "text").mapInArrow(_term_counts("ik", None), "ik long, n long, terms array<long>, counts array<long>").select("ik", F.explode("terms").alias("term")).write.parquet(at)
    asked = spark.read.parquet(at)

    at = scratch_path(spark, "forward")
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    read.mapInArrow(_term_counts("doc_id", bit_filter(asked, "term")), "doc_id long, n long, terms array<long>, counts array<long>").write.parquet(at)
    forward = spark.read.parquet(at)
    n_docs, n_terms = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    at = scratch_path(spark, "weights")
    held = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    w = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    asked.select("term").distinct().join(held, "term").select("term", w.alias("w")).write.parquet(at)
    weights = spark.read.parquet(at)

    at = scratch_path(spark, "index")
    terms, pivots = _pivots(forward, weights, PIVOTS)
    placed = forward.where(F.size("terms") > 0).mapInArrow(_placed(n_docs, n_terms, pivots, terms), "doc_id long, terms array<long>, impacts array<int>, p int, q int")
    near = ["p", "q", F.xxhash64("doc_id", "terms")]
    placed.repartitionByRange(*near).sortWithinPartitions(*near).write.parquet(at)
    index = spark.read.parquet(at)

    at = scratch_path(spark, "asked")
    sets = max(1, math.ceil(asked.count() / set_terms))
    asked.join(weights, "term").groupBy("ik").agg(F.collect_list(F.struct("term", "w")).alias("terms")).withColumn("set", F.pmod("ik", F.lit(sets))).write.partitionBy("set").parquet(at)
    steps = [sample**i for i in range(int(math.log(max(n_docs / chunk, 1), sample)), 0, -1)] + [1]
    results = []
    for number in range(sets):
        rows = spark.read.schema("ik long, terms array<struct<term: long, w: long>>, set int").parquet(at).where(F.col("set") == number).drop("set").toArrow().to_pylist()
        floor: dict[int, int] = {}
        for step in steps if rows else []:
            part = index if step == 1 else index.where(F.pmod(F.xxhash64("terms", "doc_id"), F.lit(step)) == 0)
            part = part.select("doc_id", "terms", "impacts")
            if step > 1:  # few documents a file: whole stretches again, without a shuffle
                part = part.coalesce(max(1, part.rdd.getNumPartitions() // step))
            to = scratch_path(spark, "found")
            part.mapInArrow(_search(_Items(rows, floor), k, chunk, block), "ik long, doc_id long, score long").write.parquet(to)
            best = top_per_group(spark.read.parquet(to), ["ik"], [F.desc("score"), F.asc_nulls_last("doc_id")], k, "rank")
            if step > 1:
                full = best.groupBy("ik").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == k)
                floor = {r.ik: r.score for r in full.collect()}  # one row an item of the set
            else:
                results.append(best)
    if not results:
        results = [spark.createDataFrame([], "ik long, doc_id long, score long, rank int")]
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.join(tests.select("ik", "item_id"), "ik").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
