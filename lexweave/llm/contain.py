"""Benchmark decontamination by size-partitioned MinHash containment search.

A document holds a test item if it contains at least ``threshold`` of the item's
word shingles.  Items are partitioned by size (powers of two).  The MinHash
sketch of an item is its K smallest shingle hashes, where K follows from the
upper size u of its partition: a document that contains the item misses at most
floor((1 - threshold) * u) shingles, so it has at least one of
K = floor((1 - threshold) * u) + 1 of them, however long it is.  Documents with
fewer shingles than threshold times the item's are passed over.  Candidates are
then verified by exact containment, on the shingles' words.

Documents are read once.  A bit array, filled with the hashes of all items'
shingles, goes to every task and lets only shingles through that may be an
item's; what it lets through too much, the join by hash removes.  Its size
follows the number of shingles up to MOST_BITS.

Words are runs of ASCII letters and digits (lower-cased) and other characters.
An item of fewer words than a shingle has one shingle of all its words, and the
documents that hold these words in a row match.  Null and empty texts match
nothing.  ``clean`` removes for items of MIN_WORDS words or more only: a word or
two of a test stand in any text.  Rows with equal or null ids are told apart by their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .words import Words, ngrams, run_hash, slices, text_batches, words_of

SHINGLE = 5
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
FILTER_BITS = 1 << 24  # 2 MB in every task at least
MOST_BITS = 1 << 27  # and 16 MB at most
BITS_PER_SHINGLE = 16
MIN_WORDS = 3  # of items for which ``clean`` removes documents


def bit_filter(hashes: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for each hash's low bits; at most bits/64 numbers reach the driver."""
    place = F.expr(f"`{column}` & {bits - 1}L")
    words = hashes.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def sketch_size(n: int, threshold: float = THRESHOLD) -> int:
    upper = (1 << n.bit_length()) - 1
    return min(n, int((1 - threshold) * upper + 1e-9) + 1)


def _item_shingles(n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"), alnum=True)
            hashes, at, _ = shingles_of(words, n)
            cut = np.searchsorted(words.row[at], np.arange(batch.num_rows + 1))
            counts, out = words.counts(), ([], [], [], [], [])
            for row in np.flatnonzero(np.diff(cut)):
                h = np.unique(hashes[cut[row] : cut[row + 1]])  # ascending: the sketch comes first
                out[0].append(np.full(len(h), row))
                out[1].append(h)
                out[2].append(np.full(len(h), len(h)))
                out[3].append(np.arange(len(h)) < sketch_size(len(h), threshold))
                out[4].append(np.full(len(h), min(n, counts[row])))
            join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
            row = join(out[0], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("ik").take(pa.array(row)), pa.array(join(out[1], np.uint64).view(np.int64)), pa.array(join(out[2], np.int64)), pa.array(join(out[3], bool)), pa.array(join(out[4], np.int32))],
                names=["ik", "h", "n", "sketch", "words"])

    return run


def shingles_of(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first words, lengths) of the shingles; rows of fewer than n words have one, of all their words."""
    hashes, at = ngrams(words, n)
    counts = words.counts()
    few = np.flatnonzero((counts > 0) & (counts < n))
    start = words.first[:-1][few]
    hashes, at = np.concatenate((hashes, run_hash(words, start, start + counts[few]))), np.concatenate((at, start))
    lens = np.concatenate((np.full(len(at) - len(few), n), counts[few]))
    by = np.argsort(at, kind="stable")
    return hashes[by], at[by], lens[by]


def _hits(sizes: list[int], bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"), alnum=True)
            for n in sizes:
                hashes, at = ngrams(words, n)
                hit = np.flatnonzero(passes(bits, hashes))
                rows, size = words.row[at[hit]], np.maximum(words.counts() - n + 1, 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("dk").take(pa.array(rows)), pa.array(size[rows].astype(np.int64)), pa.array(hashes[hit].view(np.int64)), pa.array([shingle(words, i, n) for i in at[hit].tolist()], pa.binary())],
                    names=["dk", "size", "h", "shingle"])

    return run


def shingle(words, i: int, n: int) -> bytes:
    return b" ".join(words.data[words.start[j] : words.end[j]].tobytes().lower() for j in range(i, i + n))


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", filter_bits: int | None = None) -> DataFrame:
    """(doc_id, item_id, item_shingles, matched, containment, dk): every document
    and item with containment >= threshold.  dk names the document's row by id
    and text.  Runs jobs while it is called (items, then one pass over ``docs``)."""
    spark = docs.sparkSession
    text_batches(spark)
    tests = items.select(F.xxhash64(F.col(item_id), F.col(text_col)).alias("ik"), F.col(item_id).alias("item_id"), F.col(text_col).cast("string").alias("text")).dropDuplicates(["ik"])
    at = scratch_path(spark, "items")
    tests.select("ik", "text").mapInArrow(_item_shingles(n, threshold), "ik long, h long, n long, sketch boolean, words int").write.parquet(at)
    shingles = spark.read.parquet(at)
    of_size = dict(shingles.groupBy("words").count().collect())  # at most n rows
    wanted = min(MOST_BITS, max(FILTER_BITS, 1 << (BITS_PER_SHINGLE * sum(of_size.values())).bit_length()))
    bits = bit_filter(shingles, "h", filter_bits or wanted)

    keyed = docs.select(document_key(doc_id, text_col), F.col(text_col).cast("string").alias("text"))
    hits_at = scratch_path(spark, "hits")
    keyed.mapInArrow(_hits(sorted(of_size), bits), "dk long, size long, h long, shingle binary").write.parquet(hits_at)
    hits = spark.read.parquet(hits_at)

    found = hits.join(shingles.where("sketch"), "h").where(F.col("size") >= F.lit(threshold) * F.col("n") - 1e-9).select("dk", "ik").distinct()
    words = tests.select("ik", "text").mapInArrow(_item_words(n), "ik long, shingle binary").distinct()
    sizes = words.groupBy("ik").agg(F.count("*").alias("item_shingles"))
    matched = hits.select("dk", "shingle").distinct().join(words, "shingle").join(found, ["dk", "ik"]).groupBy("dk", "ik").agg(F.count("*").alias("matched"))
    exact = matched.join(sizes, "ik").where(F.col("matched") >= F.lit(threshold) * F.col("item_shingles") - 1e-9)
    ids = docs.select(document_key(doc_id, text_col), F.col(doc_id).alias("doc_id"))
    named = exact.join(tests.select("ik", "item_id"), "ik").select("dk", "item_id", "item_shingles", "matched", (F.col("matched") / F.col("item_shingles")).alias("containment"))
    return named.join(ids, "dk").select("doc_id", "item_id", "item_shingles", "matched", "containment", "dk")


def _item_words(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"), alnum=True)
            _, at, lens = shingles_of(words, n)
            yield pa.RecordBatch.from_arrays([batch.column("ik").take(pa.array(words.row[at])), pa.array([shingle(words, i, k) for i, k in zip(at.tolist(), lens.tolist())], pa.binary())], names=["ik", "shingle"])

    return run


def document_key(doc_id: str, text_col: str):
    return F.xxhash64(F.col(doc_id), F.col(text_col)).alias("dk")


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, **names: str) -> DataFrame:
    """``docs`` without the documents that hold an item of ``min_words`` words or more."""
    items = items.where(F.regexp_count(F.col(names.get("text_col", "text")), F.lit(WORD)) >= min_words)
    leaked = matches(docs, items, threshold, **names).select(F.col("dk").alias("_leaked")).distinct()
    rows = docs.select(F.struct("*").alias("_doc"), document_key(names.get("doc_id", "doc_id"), names.get("text_col", "text")))
    return rows.join(leaked, F.col("dk") == F.col("_leaked"), "left_anti").select("_doc.*")
