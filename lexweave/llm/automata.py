"""Substring dedup by suffix automata of reference shards.

A window is ``width`` consecutive words of a document.  It is a repeat if its
word sequence also starts in a document with a smaller id; words under a repeat
are removed.

1. Each window has an anchor, the smallest hash of its ``gram``-word runs, so
   equal windows have equal anchors.  Anchors that occur in one document only
   are let go.  Neighbouring windows with one anchor form a run.
2. Runs whose anchor always has the same surroundings are looked up as a whole,
   the windows of other anchors one by one: the first document of each, and the
   place there, is its reference.
3. A reference shard is the part of a document that some other document refers
   to (rounded outwards).  It is cut out once and sent to each document that
   refers to it.
4. A document streams through the suffix automaton of its shards; where the
   matching statistic is at least ``width``, the last ``width`` words are a
   repeat.  The automaton decides on the words themselves: hashes only choose
   what to compare.  Tasks keep recent automata up to a number of states, so a shard
   that many documents share is built once per task.

Shards are sent to the documents that need them, not to all tasks: their total
size grows with the corpus, so it has no bound for a broadcast.  Bit arrays of
fixed size carry to the next pass over the documents what step 1 found, and who
refers to whom; if they fill up, more is looked up or shuffled and the result is
the same.

Words are runs without ASCII white space, unchanged.  Null text has no words.
A null id is neither reference nor referring.  Rows with equal ids are judged
one by one against smaller ids.
"""

from __future__ import annotations

import itertools
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .contain import bit_filter, passes
from .words import Words, run_hash, sliding_min, slices, text_batches, words_of

WIDTH = 50
GRAM = 24
FILTER_BITS = 1 << 25  # 4 MB each
ROUND = 64
STATES = 100_000  # of the automata that a task keeps, some 50 MB
_RUN = np.uint64(0xA24BAED4963EE407)


def windows_of(words: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, anchor) of every window."""
    m = len(words.hash)
    if m < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = run_hash(words, np.arange(m - gram + 1), np.arange(gram, m + 1))  # those across rows are in no window
    anchor = sliding_min(grams, width - gram + 1)
    at = np.flatnonzero(words.row[: m - width + 1] == words.row[width - 1 :])
    return at, anchor[at]


def runs_of(words: Words, at: np.ndarray, anchor: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the first window, number of windows, hash of the words) of every
    run of windows of one document with one anchor."""
    if not len(at):
        return at, at, anchor
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (words.row[at[1:]] != words.row[at[:-1]])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    return first, n, run_hash(words, at[first], at[first] + n + width - 1) ^ _RUN


def _anchors(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"))
            at, anchor = windows_of(words, width, gram)
            first, _, content = runs_of(words, at, anchor, width)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[first].view(np.int64)), pa.array(content.view(np.int64)), batch.column("doc_id").take(pa.array(words.row[at[first]]))], names=["a", "c", "doc_id"])

    return run


def _lookups(width: int, gram: int, one: np.ndarray, many: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"))
            at, anchor = windows_of(words, width, gram)
            first, n, content = runs_of(words, at, anchor, width)
            single = passes(many, anchor)
            whole = passes(one, anchor[first]) & ~single[first]
            start = np.concatenate((at[single], at[first[whole]]))
            key = np.concatenate((run_hash(words, at[single], at[single] + width), content[whole]))
            size = np.concatenate((np.ones(int(single.sum()), np.int64), n[whole]))
            # a document asks for equal words once: all of it streams through what it gets
            order = np.lexsort((start, key, words.row[start]))
            start, key, size = start[order], key[order], size[order]
            row = words.row[start]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            start, key, size, row = start[new], key[new], size[new], row[new]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), batch.column("doc_id").take(pa.array(row)), pa.array((start - words.first[row]).astype(np.int32)), pa.array(size.astype(np.int32))], names=["key", "doc_id", "pos", "n"])

    return run


def _members(bits: np.ndarray):
    """The rows whose key may be among those of the bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(bits, batch.column("_key").to_numpy().view(np.uint64))))

    return run


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes split on ASCII white space only


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted spans of words of each reference document."""
    for batch in slices(batches, "text"):
        out: tuple[list, ...] = ([], [], [], [])
        for ref, text, spans in zip(batch.column("ref").to_pylist(), batch.column("text"), batch.column("spans").to_pylist()):
            words = split_words(text.as_py())
            for span in spans:
                for column, value in zip(out, (ref, span["lo"], span["hi"], b" ".join(words[span["lo"] : span["hi"]]))):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=["ref", "lo", "hi", "shard"])


class SuffixAutomaton:
    """Of several word sequences; no match runs over the end of one of them."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._add(last, word)

    def _add(self, last: int, word: bytes) -> int:
        nxt, link, size = self.next, self.link, self.size
        q = nxt[last].get(word)
        if q is not None:  # a prefix of an earlier sequence
            if size[q] == size[last] + 1:
                return q
            return self._clone(last, q, word)
        state = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = state
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[state] = q if size[q] == size[p] + 1 else self._clone(p, q, word)
        return state

    def _clone(self, p: int, q: int, word: bytes) -> int:
        nxt, link, size = self.next, self.link, self.size
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        return copy

    def repeats(self, words: list[bytes], width: int) -> list[tuple[int, int]]:
        """Maximal spans of ``words`` covered by matches of at least ``width``."""
        nxt, link, size = self.next, self.link, self.size
        state = matched = 0
        spans: list[tuple[int, int]] = []
        for i, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                matched = size[state]
            state = nxt[state].get(word, 0)
            matched = matched + 1 if state else 0
            if matched >= width:
                start = i + 1 - width
                if spans and spans[-1][1] >= start:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((start, i + 1))
        return spans


def _streamed(width: int, columns: list[str], others: np.ndarray | None = None):
    """Repeats of every row against its shards; with ``others``, of the rows that
    ``others`` leaves out, which have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: OrderedDict[tuple, SuffixAutomaton] = OrderedDict()
        states = 0
        if others is not None:
            batches = (batch.filter(pa.array(~passes(others, batch.column("_key").to_numpy().view(np.uint64)))) for batch in batches)
        for batch in slices(batches, "_text"):
            sent = (s.as_py() for s in batch.column("_shards")) if others is None else itertools.repeat(None)
            n_words, removed, spans_out, kept = [], [], [], []
            for text, shards in zip(batch.column("_text"), sent):
                words = split_words(text.as_py())
                spans = []
                if shards:
                    key = tuple(sorted(set(shards)))
                    if key not in built:
                        built[key] = SuffixAutomaton([s.split(b" ") for s in key])
                        states += len(built[key].next)
                        while states > STATES and len(built) > 1:
                            states -= len(built.popitem(last=False)[1].next)
                    built.move_to_end(key)
                    spans = built[key].repeats(words, width)
                at, stay = 0, []
                for start, end in spans:
                    stay += words[at:start]
                    at = end
                stay += words[at:]
                n_words.append(len(words))
                removed.append(len(words) - len(stay))
                spans_out.append([{"start": a, "end": b} for a, b in spans])
                kept.append(b" ".join(stay).decode("utf-8", "surrogatepass"))
            spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans_out, spans_type), pa.array(kept, pa.string())],
                names=[*columns, "n_words", "n_removed", "removed", "kept"])

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, carry: tuple[str, ...] = (), filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, carried columns, n_words, n_removed, removed, kept) for every row:
    removed holds the maximal spans (start, end) of words that go, kept the words
    that stay, joined by one space.  Runs jobs while it is called."""
    spark = docs.sparkSession
    text_batches(spark)
    gram = min(gram, width)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = texts.where("doc_id is not null")
    variants = known.mapInArrow(_anchors(width, gram), "a long, c long, doc_id long").groupBy("a", "c").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    anchors_at = scratch_path(spark, "anchors")
    variants.groupBy("a").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("a", "n").write.parquet(anchors_at)
    anchors = spark.read.parquet(anchors_at)
    one, many = (bit_filter(anchors.where(which), "a", filter_bits) for which in ("n = 1", "n > 1"))

    lookups_at = scratch_path(spark, "lookups")
    known.mapInArrow(_lookups(width, gram, one, many), "key long, doc_id long, pos int, n int").write.parquet(lookups_at)
    lookups = spark.read.parquet(lookups_at)
    first_at = scratch_path(spark, "first")  # written, so that the join below is free to split hot keys
    lookups.groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.max("doc_id").alias("last")).where("f.doc_id < last").select("key", F.col("f.doc_id").alias("ref"), F.col("f.pos").alias("ref_pos")).write.parquet(first_at)
    referred = lookups.join(spark.read.parquet(first_at), "key").where("doc_id > ref")
    spans = referred.groupBy("doc_id", "ref", (F.col("ref_pos") - F.col("pos")).alias("_shift")).agg(F.min("ref_pos").alias("lo"), F.max(F.col("ref_pos") + F.col("n") + (width - 1)).alias("hi"))
    rounded = spans.select("doc_id", "ref", (F.floor(F.col("lo") / ROUND) * ROUND).cast("int").alias("lo"), (F.ceil(F.col("hi") / ROUND) * ROUND).cast("int").alias("hi")).distinct()
    wanted_at = scratch_path(spark, "wanted")
    rounded.write.parquet(wanted_at)
    wanted = spark.read.parquet(wanted_at)

    # only texts that refer or are referred to are shuffled; the bits let a few more through
    key = F.xxhash64("doc_id").alias("_key")
    refs, asking = (bit_filter(wanted.select(F.xxhash64(c).alias("k")).distinct(), "k", filter_bits) for c in ("ref", "doc_id"))
    by_ref = wanted.select("ref", "lo", "hi").distinct().groupBy("ref").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    held = known.select("doc_id", "text", key).mapInArrow(_members(refs), "doc_id long, text string, _key long")
    shards = held.join(by_ref, F.col("doc_id") == F.col("ref")).select("ref", "text", "spans").mapInArrow(_cut, "ref long, lo int, hi int, shard binary")
    sent = wanted.join(shards, ["ref", "lo", "hi"]).groupBy(F.col("doc_id").alias("_to")).agg(F.collect_list("shard").alias("_shards"))
    kept = [c for c in carry if c != "doc_id"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *kept, F.col(text_col).cast("string").alias("_text"), F.xxhash64(F.col(id_col).cast("long")).alias("_key"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if not f.name.startswith("_")) + ", n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept string"
    meeting = rows.mapInArrow(_members(asking), fields).join(sent, F.col("doc_id") == F.col("_to"), "left").select("doc_id", *kept, "_text", "_shards")
    return rows.mapInArrow(_streamed(width, ["doc_id", *kept], asking), out).unionByName(meeting.mapInArrow(_streamed(width, ["doc_id", *kept]), out))
