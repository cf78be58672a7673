"""N-gram Jaccard join by MinHash LSH banding.

Documents are sets of word shingles.  Documents with the same set form a class
and go on as one.  A signature of ``trees * depth`` minima (one permutation,
empty bins filled from others) labels each class with one path of ``depth``
values per tree.  Two classes are compared where their paths share a prefix.
Its length d is the same everywhere and follows from the constants: the longest
for which the share of pairs at the threshold that meet in some tree,
1 - (1 - t**d)**trees, reaches the target recall.  No sorted trie is searched,
and no prefix is shortened by what is found.

Classes in one bucket are compared on their signatures, with a margin of five
standard errors, and joined to candidate components.  Inside a component every
pair is verified by exact Jaccard similarity, with array arithmetic that counts
links without writing pairs down.  Buckets and components of more than
``BLOCK`` classes are dealt out as pairs of blocks, so a group with a third of
all rows is spread over many tasks and no link is left out.

Words are runs of ASCII letters and digits (lower-cased) and other characters.
A text of fewer words than a shingle has one shingle, all its words; null and
empty texts have none, and are linked to nothing.  Classes are named by a
64-bit hash of their set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph_iter import components
from ..session import scratch_path
from .words import Words, give_back, mix, ngrams, run_hash, slices, text_batches, words_of

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 16, 8
RECALL = 0.999
BLOCK = 1024
ATTEMPTS = 64
ROWS = 128  # of a block pair, held against all its others at once


def prefix_length(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with the recall at the threshold (1 if none has it)."""
    d = depth
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of every row, sorted."""
    hashes, at = ngrams(words, n)
    short = np.flatnonzero((words.counts() > 0) & (words.counts() < n))
    row = np.concatenate((words.row[at], short))
    hashes = np.concatenate((hashes, run_hash(words, words.first[short], words.first[short + 1])))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[new], hashes[new]


def signatures(row: np.ndarray, hashes: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """One-permutation MinHash of every row (32 bits a bin); rows without shingles are zero."""
    sig = np.full(rows * bins, np.uint64(2**64 - 1))
    np.minimum.at(sig, row * bins + (hashes % np.uint64(bins)).astype(np.int64), hashes)
    sig = sig.reshape(rows, bins)
    empty = sig == np.uint64(2**64 - 1)
    todo = np.flatnonzero(empty.any(1) & ~empty.all(1))
    source, hole = sig[todo], empty[todo]
    filled = source.copy()
    for attempt in range(ATTEMPTS):
        if not hole.any():
            break
        take = np.random.default_rng([attempt, bins]).integers(0, bins, bins)
        found = hole & ~empty[todo][:, take]
        filled[found] = source[:, take][found]
        hole &= ~found
    for shift in range(1, bins):  # what chance has left, from the next bin that has a value
        if not hole.any():
            break
        found = hole & ~np.roll(empty[todo], -shift, 1)
        filled[found] = np.roll(source, -shift, 1)[found]
        hole &= ~found
    sig[todo] = filled
    return (mix(sig) >> np.uint64(32)).astype(np.uint32)


def _signed(n: int, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = batch.num_rows
            row, hashes = shingle_sets(words_of(batch.column("text"), alnum=True), n)
            name = np.zeros(rows, np.uint64)
            np.add.at(name, row, mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))
            size = np.bincount(row, minlength=rows)
            name = mix(name + size.astype(np.uint64))
            sig = signatures(row, hashes, rows, bins)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("dk"), pa.array(name.view(np.int64), mask=size == 0), pa.array(size.astype(np.int32)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(bins * 4), rows, [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary()) if rows else pa.array([], pa.binary())],
                names=["doc_id", "dk", "cls", "size", "sig"])

    return run


def _paths(trees: int, depth: int, d: int):
    """(tree, prefix, cls, size, sig8): the prefix of every tree, and the low byte of every bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(m, trees, depth)
            small = np.ascontiguousarray(sig.astype(np.uint8)).reshape(m, trees * depth)
            small = pa.FixedSizeBinaryArray.from_buffers(pa.binary(trees * depth), m, [None, pa.py_buffer(small)]).cast(pa.binary()) if m else pa.array([], pa.binary())
            for t in range(trees):
                prefix = np.full(m, np.uint64(t + 1))
                for k in range(d):
                    prefix = mix(prefix * np.uint64(0x9E3779B97F4A7C15) + sig[:, t, k])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, t, np.int32)), pa.array(prefix.view(np.int64)), batch.column("cls"), batch.column("size"), small], names=["tree", "prefix", "cls", "size", "sig"])

    return run


def in_blocks(df: DataFrame, key: list[str], item: str, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of groups of at least two, dealt to (key, lo, hi): one pair of blocks
    of at most about ``block`` rows; ``side`` is the row's own block."""
    counted = df.join(sizes.where("_n > 1"), key).withColumn("_b", F.ceil(F.col("_n") / F.lit(float(block))).cast("int")).drop("_n")
    tagged = counted.withColumn("side", F.pmod(F.xxhash64(item), F.col("_b")).cast("int"))
    spread = tagged.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return spread.withColumn("lo", F.least("side", "_o")).withColumn("hi", F.greatest("side", "_o")).drop("_b", "_o")


def groups(batches: Iterator[pa.RecordBatch], key: list[str], rows: int = 20_000, size: int = 8_000_000) -> Iterator[pa.Table]:
    """Tables of whole groups (sorted by key), several small ones at a time."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows and sum(b.nbytes for b in held) < size:
            continue
        table = pa.Table.from_batches(held)
        change = _starts(table, key)
        last = change[-1]
        if last:
            yield table.slice(0, last)
        held = table.slice(last).combine_chunks().to_batches()
        count = table.num_rows - last
        del table
        give_back()
    if held:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table, key: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in key:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after joining a[i] with b[i]; ``parent`` holds roots."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (parent != parent[parent]).any():
            parent = parent[parent]


def _candidates(threshold: float):
    """(a, b): a spanning forest of the pairs of each bucket whose signatures agree well enough."""
    key = ["tree", "prefix", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, key):
            start = _starts(table, key)
            group = np.repeat(np.arange(len(start)), np.diff(np.append(start, table.num_rows)))
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(table.num_rows, -1)
            size, side = table.column("size").to_numpy(), table.column("side").to_numpy()
            across = table.column("lo").to_numpy() != table.column("hi").to_numpy()
            parent, bins = np.arange(table.num_rows), sig.shape[1]
            for lag in range(1, table.num_rows):
                a = np.flatnonzero(group[:-lag] == group[lag:])
                if not len(a):
                    break
                b = a + lag
                keep = (parent[a] != parent[b]) & (~across[a] | (side[a] != side[b]))
                a, b = a[keep], b[keep]
                if not len(a):
                    continue
                small = np.minimum(np.minimum(size[a], size[b]), bins)
                same = (sig[a] == sig[b]).sum(1)
                near = same / bins >= threshold - 5 * np.sqrt(threshold * (1 - threshold) / small)
                parent = joined(parent, a[near], b[near])
            tied = np.flatnonzero(parent != np.arange(table.num_rows))
            cls = table.column("cls").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(cls[tied]), pa.array(cls[parent[tied]])], names=["a", "b"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, hashes = shingle_sets(words_of(batch.column("text"), alnum=True), n)
            off = np.searchsorted(row, np.arange(batch.num_rows + 1)) * 8
            col = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(hashes)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("members"), batch.column("component"), col], names=["cls", "members", "component", "hashes"])

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share, by products of incidence blocks."""
    m = len(sets)
    lens = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(m), lens)
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[col] > 1
    row, col = row[shared], col[shared]
    number = np.cumsum(times > 1) - 1
    col = number[col]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total, width = np.zeros((m, m), np.float32), max(256, 4_000_000 // m)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, (at, at + width))
        dense = np.zeros((m, min(width, int(col[-1]) + 1 - at)), np.float32)
        dense[row[lo:hi], col[lo:hi] - at] = 1
        total += dense @ dense.T
    return total


def _verified(threshold: float):
    """Per class of a block pair: documents and classes linked to it, and a class that it is joined with."""
    key = ["component", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, key, 4_000):
            start = np.append(_starts(table, key), table.num_rows)
            cls, members, side = (table.column(c).to_numpy() for c in ("cls", "members", "side"))
            across = table.column("lo").to_numpy() != table.column("hi").to_numpy()
            hashes = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
            docs, texts, root = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64), cls.copy()
            for lo, hi in zip(start[:-1], start[1:]):
                sets = hashes[lo:hi]
                size = np.array([len(s) for s in sets], np.int32)
                same = shared_counts(sets)
                link = np.empty(same.shape, bool)
                for at in range(0, len(sets), ROWS):
                    some = same[at : at + ROWS].astype(np.int32)
                    link[at : at + ROWS] = some >= threshold * (size[at : at + ROWS, None] + size[None, :] - some) - 1e-9
                del same
                np.fill_diagonal(link, False)
                if across[lo]:
                    link &= side[lo:hi, None] != side[None, lo:hi]
                docs[lo:hi], texts[lo:hi] = link @ members[lo:hi], link.sum(1)
                parent = np.arange(hi - lo)
                for a, row in enumerate(link):  # a row at a time: a dense group has millions of links
                    b = np.flatnonzero(row)
                    b = b[parent[b] != parent[a]]
                    if len(b):
                        parent = joined(parent, np.full(len(b), a), b)
                root[lo:hi] = cls[lo:hi][parent]
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(docs), pa.array(texts), pa.array(root), table.column("component").combine_chunks()], names=["cls", "docs", "texts", "root", "component"])

    return run


def document_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col))


def join(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links, n_same, dk) for every row of ``docs``.

    class_id: the smallest doc_id of the near-duplicate group (connected by
    links); n_links: other documents at the threshold or above, n_same of them
    with the very same shingles; dk: key of the row by id and text.  Rows equal
    in id and text are documents of their own.  Runs jobs while it is called."""
    spark = docs.sparkSession
    text_batches(spark)
    d = prefix_length(threshold, trees, depth, recall)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), document_key(id_col, text_col).alias("dk"), F.col(text_col).cast("string").alias("text"))
    signed_at = scratch_path(spark, "signed")
    keyed.mapInArrow(_signed(n, trees * depth), "doc_id long, dk long, cls long, size int, sig binary").write.parquet(signed_at)
    signed = spark.read.parquet(signed_at)
    some = signed.where("cls is not null")
    classes = some.groupBy("cls").agg(F.count("*").alias("members"), F.min("doc_id").alias("first_id"), F.min("dk").alias("dk"))
    sigs = some.join(classes.select("dk", "cls"), ["dk", "cls"]).dropDuplicates(["cls"]).select("cls", "size", "sig")

    paths = sigs.mapInArrow(_paths(trees, depth, d), "tree int, prefix long, cls long, size int, sig binary")
    sizes = paths.groupBy("tree", "prefix").agg(F.count("*").alias("_n"))
    bucket = ["tree", "prefix"]
    dealt = in_blocks(paths, bucket, "cls", sizes, block)
    by = [*bucket, "lo", "hi"]
    edges_at = scratch_path(spark, "edges")
    # within a group by class, so that the trees join a class with the same smallest one, and few edges differ
    dealt.repartition(*by).sortWithinPartitions(*by, "cls").mapInArrow(_candidates(threshold), "a long, b long").distinct().write.parquet(edges_at)
    edges = spark.read.parquet(edges_at).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    comp = components(edges).select(F.col("node").alias("cls"), "component")

    asked = classes.join(comp, "cls").select("dk", "cls", "members", "component")
    sets = keyed.select("dk", "text").join(asked, "dk").dropDuplicates(["cls"]).mapInArrow(_sets(n), "cls long, members long, component long, hashes binary")
    in_comp = comp.groupBy("component").agg(F.count("*").alias("_n"))
    pairs = in_blocks(sets, ["component"], "cls", in_comp, block)
    by = ["component", "lo", "hi"]
    links_at = scratch_path(spark, "links")
    pairs.repartition(*by).sortWithinPartitions(*by, "cls").mapInArrow(_verified(threshold), "cls long, docs long, texts long, root long, component long").write.parquet(links_at)
    links = spark.read.parquet(links_at)
    wide = in_comp.where(F.col("_n") > block).select("component")
    # roots of a component in one block are final; those of several blocks are joined
    across = links.join(wide, "component", "left_semi").where("cls != root").select(F.col("cls").alias("src"), F.col("root").alias("dst"))
    final = links.join(wide, "component", "left_anti").select("cls", "root")
    if not across.isEmpty():
        final = final.unionByName(components(across).select(F.col("node").alias("cls"), F.col("component").alias("root")))
    final = final.where("cls != root").unionByName(final.where("cls != root").select(F.col("root").alias("cls"), "root")).distinct()
    linked = links.groupBy("cls").agg(F.sum("docs").alias("docs"))

    about = classes.select("cls", "members", "first_id").join(linked, "cls", "left").join(final, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = about.join(about.groupBy("root").agg(F.min("first_id").alias("class_id")), "root").select("cls", "members", "docs", "class_id")
    out = signed.select("doc_id", "dk", "cls").join(named, "cls", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("members", F.lit(1)) - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"), (F.coalesce("members", F.lit(1)) - 1).alias("n_same"), "dk")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the
    smallest id (null last), then text hash.  Rows without shingles all stay."""
    found = join(docs, id_col=id_col, text_col=text_col, **settings)
    # the group's first id names it; a group whose ids are all null stays apart by its own key
    alone = found.where("n_links = 0").select(F.col("dk").alias("_dk"), F.lit(False).alias("_single"))
    group = F.coalesce(F.col("class_id").cast("string"), F.lit("null"))
    chosen = found.where("n_links > 0").groupBy(group.alias("_g")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "dk")).alias("_m")).select(F.col("_m.dk").alias("_dk"), F.lit(True).alias("_single"))
    kept = alone.unionByName(chosen).groupBy("_dk").agg(F.max("_single").alias("_single"))
    rows = docs.select(F.struct("*").alias("_doc"), document_key(id_col, text_col).alias("_k")).join(kept, F.col("_k") == F.col("_dk"))
    return rows.where("not _single").select("_doc.*").unionByName(rows.where("_single").dropDuplicates(["_dk"]).select("_doc.*"))
