"""Byte-level BPE by a global shuffle of distinct words.

Map tasks split the texts of a block of documents into pre-tokens and keep each
distinct word of the block once, with its positions.  Words are dealt out by
their hash, so a task of the second step sees every block's copy of a word and
encodes it once; ids and positions go back to the block, where the documents'
ids are put together by position.  Decoding looks ids up in the token-byte
table (its size is the vocabulary's).

A message to the same part of the words is one packed row (sorted words, varint
position gaps), which keeps the two shuffles smaller than the text.  A word
that makes up more than 1/64 of a block is dealt by (word, block), so that a
word with a third of all tokens doesn't load one task.

Null text counts as empty; empty texts give no ids.  Rows with equal or null
doc_id are kept apart, one result each.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import give_back, ragged, text_batches

BLOCK_CHARS = 18_000_000
HOT_SHARE = 64
GATHER = 1 << 19  # tokens put in place at once
_MESSAGE = "block long, part int, words binary, lens binary, counts binary, gaps binary, doc_ids array<long>, sizes array<int>"
_MESSAGE_TYPES = [pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.list_(pa.int32())]
_ANSWER = "block long, ids binary, n_ids binary, counts binary, gaps binary, doc_ids array<long>, sizes array<int>"


def varints(values: np.ndarray) -> bytes:
    """Seven bits a byte, low bits first; the high bit says that more follow."""
    v = values.astype(np.uint64)
    n = np.ones(len(v), np.int64)
    for k in range(1, 10):
        n += v >= np.uint64(1 << (7 * k))
    out, at = np.zeros(int(n.sum()), np.uint8), np.cumsum(n) - n
    for k in range(int(n.max(initial=0))):
        more = n > k
        out[at[more] + k] = ((v[more] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(n[more] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def from_varints(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(b < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    shift = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * shift), first)


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(9).compress(data)


def spread(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


class _Block:
    """Documents of one block as numbers of its distinct words."""

    def __init__(self) -> None:
        self.words: defaultdict = defaultdict()
        self.words.default_factory = self.words.__len__
        self.doc_ids: list = []
        self.tokens: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id, text: str, found: list[str]) -> None:
        self.doc_ids.append(doc_id)
        self.tokens.append(np.fromiter(map(self.words.__getitem__, found), np.int32, len(found)))
        self.chars += len(text)

    def messages(self, block: int, parts: int) -> pa.RecordBatch:
        """The documents' row, and for each part its words, sorted, with their positions."""
        sizes = [len(t) for t in self.tokens]
        seq = np.concatenate(self.tokens)
        self.tokens.clear()
        words = [w.encode("utf-8", "surrogatepass") for w in self.words]
        self.words.clear()
        count = np.bincount(seq, minlength=len(words))
        order = np.argsort(seq, kind="stable").astype(np.int32)
        place = np.cumsum(count) - count
        part = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts
        hot = count * HOT_SHARE > len(seq)
        part[hot] = (part[hot] + block) % parts
        out = [(block, block % parts, None, None, None, None, self.doc_ids, sizes)]
        for p in range(parts):
            mine = np.array(sorted(np.flatnonzero(part == p).tolist(), key=words.__getitem__), np.int64)
            if not len(mine):
                continue
            # gaps of words of like frequency stand together, for the sake of compression
            often = mine[np.argsort(-count[mine], kind="stable")]
            n = count[often]
            pos = order[ragged(place[often], n)]
            gap = np.diff(pos, prepend=0)
            heads = np.cumsum(n) - n
            gap[heads] = pos[heads]
            lens = np.array([len(words[i]) for i in mine])
            out.append((block, p, squeeze(b"".join(words[i] for i in mine)), squeeze(varints(lens)), squeeze(varints(count[mine])), squeeze(varints(gap)), None, None))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _MESSAGE_TYPES)], schema=pa.schema(list(zip(("block", "part", "words", "lens", "counts", "gaps", "doc_ids", "sizes"), _MESSAGE_TYPES))))


def _messages(pattern: str, parts: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        task = TaskContext.get().partitionId()
        number, block = 0, _Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                block.add(doc_id, text, split.findall(text))
                if block.chars >= size:
                    yield block.messages((task << 24) + number, parts)
                    number, block = number + 1, _Block()
                    give_back()
        if block.doc_ids:
            yield block.messages((task << 24) + number, parts)
        del block
        give_back()

    return run


def _encoder(pattern: str, file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(file)
        width = "<u2" if max(table.values()) < 1 << 16 else "<u4"
        encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={})._encode_single_piece
        known: dict[bytes, tuple[bytes, int]] = {}
        part = None
        for batch in batches:
            parts, words, lens = (batch.column(c).to_pylist() for c in ("part", "words", "lens"))
            out_ids, out_n = [], []
            for p, blob, n in zip(parts, words, lens):
                if p != part:
                    part, known = p, {}
                if blob is None:
                    out_ids.append(None)
                    out_n.append(None)
                    continue
                blob, ends = spread(blob), np.cumsum(from_varints(spread(n))).tolist()
                got, start = [], 0
                for end in ends:
                    w = blob[start:end]
                    start = end
                    have = known.get(w)
                    if have is None:
                        ids = encode(w)
                        have = known[w] = (np.array(ids, width).tobytes(), len(ids))
                    got.append(have)
                out_ids.append(squeeze(b"".join(g[0] for g in got)))
                out_n.append(squeeze(varints(np.array([g[1] for g in got]))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), pa.array(out_ids, pa.binary()), pa.array(out_n, pa.binary()), *[batch.column(c) for c in ("counts", "gaps", "doc_ids", "sizes")]],
                names=["block", "ids", "n_ids", "counts", "gaps", "doc_ids", "sizes"])

    return run


def _one_block(rows: list[dict]) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, the ids of the block one after another, and where each document ends."""
    head = next(r for r in rows if r["doc_ids"] is not None)
    total = int(np.sum(head["sizes"], dtype=np.int64))
    start, size = np.zeros(total, np.int32), np.zeros(total, np.int32)
    flat, at = [], 0
    for r in rows:
        if r["ids"] is None:
            continue
        n, count, gap = (from_varints(spread(r[c])) for c in ("n_ids", "counts", "gaps"))
        r["gaps"] = None
        ids = spread(r["ids"])
        ids = np.frombuffer(ids, "<u2" if len(ids) == 2 * n.sum() else "<u4").astype(np.uint32)
        first = at + np.cumsum(n) - n
        often = np.argsort(-count, kind="stable")
        count, first, n = count[often], first[often], n[often]
        heads = np.cumsum(count) - count
        run = np.cumsum(gap)
        pos = run - np.repeat(run[heads] - gap[heads], count)
        start[pos] = np.repeat(first, count)
        size[pos] = np.repeat(n, count)
        flat.append(ids)
        at += len(ids)
    flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
    done = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    ids = np.empty(done[-1], "<u4")
    for a in range(0, total, GATHER):
        b = min(a + GATHER, total)
        ids[done[a] : done[b]] = flat[ragged(start[a:b], size[a:b])]
    return head["doc_ids"], ids, done[np.cumsum(head["sizes"], dtype=np.int64)]


def _assemble(packed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for _, group in itertools.groupby(rows, key=lambda r: r["block"]):
            doc_ids, ids, ends = _one_block(list(group))
            off = np.concatenate(([0], ends))
            column = (pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(off * 4), pa.py_buffer(ids)]).cast(pa.binary()) if packed
                      else pa.LargeListArray.from_arrays(off, pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(np.diff(off)), column], names=["doc_id", "n_tokens", "ids"])
            del column, ids
            give_back()

    return run


def encode(docs: DataFrame, file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as an array, or with ``packed`` as
    little-endian unsigned 32-bit values in one binary."""
    spark = docs.sparkSession
    text_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = texts.mapInArrow(_messages(pattern, parts, block_chars), _MESSAGE)
    encoded = sent.repartition("part").sortWithinPartitions("part").mapInArrow(_encoder(pattern, file), _ANSWER)
    kind = "binary" if packed else "array<int>"
    return encoded.repartition("block").sortWithinPartitions("block").mapInArrow(_assemble(packed), f"doc_id long, n_tokens long, ids {kind}")


def decode(encoded: DataFrame, file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes of ``ids`` (array or packed binary; null stays null)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(file)
        words = sorted(table, key=table.get)
        size = np.array([len(w) for w in words])
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(words), np.uint8)
        slot = np.full(max(table.values(), default=0) + 1, -1)
        slot[sorted(table.values())] = np.arange(len(words))
        for batch in batches:
            col = batch.column(ids)
            if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type):
                whole = [None if v is None else np.frombuffer(v, "<u4") for v in col.to_pylist()]
            else:
                whole = [None if not v.is_valid else v.values.to_numpy(zero_copy_only=False) for v in col]
            made = []
            for v in whole:
                if v is None:
                    made.append(None)
                    continue
                if len(v) and (v.max() >= len(slot) or slot[v].min() < 0):
                    raise ValueError("an id outside the vocabulary")
                k = slot[v]
                made.append(data[ragged(start[k], size[k])].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, out])

    return encoded.mapInArrow(run, f"{fields}, `{out}` binary")
