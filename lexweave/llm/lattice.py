"""Subword lattice likelihood of whole texts.

The pieces of an existing subword vocabulary form a lattice over every word.
Their weights start from the vocabulary's own scores (order of merging) and are
refitted on the distinct training words by expected counts over all
segmentations.  A forward recursion in log space sums over all segmentations of
a word, and the text's probability is the product over its words, since no
piece crosses white space:

    P(word) = (c + V q(word)) / (N + V)

with c, N, V the training counts of the words and q the lattice probability
(Witten-Bell weights), the end of the text being one more token.

Words are counted and scored once each, over all documents.  Documents meet the
scored words in packed messages per (word hash, block of documents), each of
which returns one packed row of partial sums.  The number of word hashes follows
the number of words; a task holds the words of one hash and streams the messages
past them.

Null text counts as empty: one token, the end.  Rows with equal or null doc_id
are kept apart.  A null doc_id is not held out.  With no training text every
probability is the lattice's own (and the base score's counts are zero).
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from ..session import scratch_path
from .bpe import from_varints, varints
from .words import BASE, _BYTES, _power, give_back, mix, ragged, text_batches

ROUNDS = 2
BLOCK_CHARS = 12_000_000
CHUNK_WORDS = 50_000  # words that go through the recursion together
PART_WORDS = 250_000  # distinct words of one hash, on average at most
DICTIONARY = -1  # block number of rows that hold scored words
MARK = "▁".encode()
SLOTS = 1 << 18
_SUMS = ("score", "lattice_score", "base_score")
_HEADER = {"doc_ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int64())}
_MESSAGE = {"part": pa.int32(), "block": pa.int64(), **dict.fromkeys(("words", "lens", "n_docs", "docs", "times"), pa.binary()), **_HEADER}
_PARTIAL = {"block": pa.int64(), **dict.fromkeys(("docs", "n_known", *_SUMS), pa.binary()), **_HEADER}
_HEADER_DDL = "doc_ids array<long>, held array<boolean>, sizes array<long>"
_MESSAGE_DDL = f"part int, block long, words binary, lens binary, n_docs binary, docs binary, times binary, {_HEADER_DDL}"
_PARTIAL_DDL = f"block long, docs binary, n_known binary, {', '.join(f'{c} binary' for c in _SUMS)}, {_HEADER_DDL}"


class Pieces:
    """Vocabulary pieces by the hash of their bytes, with log weights."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        sizes = np.array([len(p) for p in pieces])
        start = np.cumsum(sizes) - sizes
        h = substring_hashes(np.frombuffer(b"".join(pieces), np.uint8), start, start + sizes)
        # an open table: the low bits point at the first candidate in the sorted hashes' order of low bits
        low = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        order = np.argsort(low, kind="stable")
        self.by_low, self.low_first = order, np.searchsorted(low[order], np.arange(SLOTS + 1))
        self.depth = int(np.diff(self.low_first).max())
        self.hash = h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece number for each hash, or -1."""
        low = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        first, size = self.low_first[low], self.low_first[low + 1] - self.low_first[low]
        out = np.full(len(h), -1)
        for k in range(self.depth):
            there = np.flatnonzero(size > k)
            if not len(there):
                break
            piece = self.by_low[first[there] + k]
            hit = self.hash[piece] == h[there]
            out[there[hit]] = piece[hit]
        return out


def substring_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _power(BASE, len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[:-1], dtype=np.uint64)))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def vocabulary(file: str) -> tuple[list[bytes], np.ndarray]:
    """Distinct pieces as bytes and their first weights: the scores' order as a
    Zipf law.  The mark and all 256 single bytes are there, so every word has a
    segmentation."""
    model = SentencePieceProcessor(model_file=file)
    score: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).encode()
            score[piece] = max(score.get(piece, -np.inf), model.get_score(i))
    lowest = min(score.values(), default=0.0)
    for piece in (MARK, *(bytes([b]) for b in range(256))):
        score.setdefault(piece, lowest - 1)
    pieces = list(score)
    rank = np.argsort(np.argsort([-score[p] for p in pieces], kind="stable"), kind="stable")
    weight = 1.0 / (rank + 10.0)
    return pieces, weight / weight.sum()


def forward(table: Pieces, logp: np.ndarray, words: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log of each word's probability over all segmentations, and with
    ``counts`` the expected uses of every piece."""
    out = np.zeros(len(words))
    expected = None if counts is None else np.zeros(len(logp))
    length = np.array([len(w) for w in words]) + len(MARK)
    for size in np.unique(length):
        rows = np.flatnonzero(length == size)
        step = max(1, 400_000 // int(size))
        for at in range(0, len(rows), step):
            mine = rows[at : at + step]
            out[mine] = _same_length(table, logp, [words[i] for i in mine], int(size), None if counts is None else counts[mine], expected)
    return out, expected


def _same_length(table: Pieces, logp: np.ndarray, words: list[bytes], size: int, counts: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
    n = len(words)
    data = np.frombuffer(b"".join(MARK + w for w in words), np.uint8)
    base = np.arange(n) * size
    longest = min(table.longest, size)
    up, down = _power(BASE, len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[:-1], dtype=np.uint64)))
    arcs: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(size + 1)]
    for m in range(1, longest + 1):
        ends = np.arange(m, size + 1)
        start = (base[:, None] + ends[None, :] - m).ravel()
        h = mix((total[start + m] - total[start]) * down[start] + np.uint64(m))
        piece = table.find(h)
        begin = ends - m  # no piece starts or ends inside the mark
        piece[np.tile((begin > 0) & (begin < len(MARK)) | (ends < len(MARK)), n)] = -1
        hit = np.flatnonzero(piece >= 0)
        row, col = hit // len(ends), hit % len(ends)
        by = np.argsort(col, kind="stable")
        row, col, found = row[by], col[by], piece[hit][by]
        cut = np.searchsorted(col, np.arange(len(ends) + 1))
        for k in range(len(ends)):
            if cut[k + 1] > cut[k]:
                arcs[k + m].append((m, row[cut[k] : cut[k + 1]], found[cut[k] : cut[k + 1]]))
    alpha = np.full((size + 1, n), -np.inf)
    alpha[0] = 0
    for i in range(1, size + 1):
        for m, row, piece in arcs[i]:
            alpha[i, row] = np.logaddexp(alpha[i, row], alpha[i - m, row] + logp[piece])
    if expected is not None:
        # a word's mass goes back along its arcs, in shares of the way it came
        mass = np.zeros((size + 1, n))
        mass[size] = counts
        pieces, uses = [], []
        for i in range(size, 0, -1):
            for m, row, piece in arcs[i]:
                use = np.exp(alpha[i - m, row] + logp[piece] - alpha[i, row]) * mass[i, row]
                mass[i - m, row] += use
                pieces.append(piece)
                uses.append(use)
        expected += np.bincount(np.concatenate(pieces), np.concatenate(uses), len(expected))
    return alpha[size]


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_WORDS) -> Iterator[pa.Table]:
    """The same rows, about ``size`` at a time: the recursion runs over columns
    of words of one length, and short columns cost more than they hold."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def held_out_flag(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of about BLOCK_CHARS of text, with their training counts."""
    train, other, size = Counter(), set(), 0

    def packed() -> pa.RecordBatch:
        rest = [w for w in other if w not in train]
        return pa.RecordBatch.from_arrays([pa.array([*train, *rest], pa.binary()), pa.array([*train.values(), *[0] * len(rest)], pa.int64())], names=["word", "c"])

    for batch in batches:
        for text, held in zip(batch.column("text"), batch.column("held").to_pylist()):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass").lower()
            size += len(raw)
            (other if held else train).update(raw.split())
            if size >= BLOCK_CHARS:
                yield packed()
                train, other, size = Counter(), set(), 0
    yield packed()


def _messages(parts: int):
    """Distinct words of a block with the documents that hold them, by word hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def packed(number: int, local: dict, pairs: list, ids: list, held: list, sizes: list) -> pa.RecordBatch:
            block = (task << 24) + number
            words = list(local)
            word = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(pairs)), [len(p[0]) for p in pairs])
            times = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
            by = np.argsort(word, kind="stable")
            doc, times = doc[by], times[by]
            count = np.bincount(word, minlength=len(words))
            place = np.cumsum(count) - count
            part = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts
            rows = [(block % parts, block, None, None, None, None, None, ids, held, sizes)]
            for p in range(parts):
                mine = sorted(np.flatnonzero(part == p).tolist(), key=words.__getitem__)
                if mine:
                    n = count[mine]
                    at = ragged(place[mine], n)
                    gap = np.diff(doc[at], prepend=0)
                    heads = np.cumsum(n) - n
                    gap[heads] = doc[at][heads]
                    rows.append((p, block, b"".join(words[i] for i in mine), varints(np.array([len(words[i]) for i in mine])), varints(n), varints(gap), varints(times[at]), None, None, None))
            return _rows(rows, _MESSAGE)

        number, size = 0, 0
        local: defaultdict = defaultdict()
        local.default_factory = local.__len__
        pairs, ids, held, sizes = [], [], [], []
        for batch in batches:
            for doc_id, flag, text in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), batch.column("text")):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass").lower()
                found = Counter(raw.split())
                pairs.append((np.fromiter(map(local.__getitem__, found), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))))
                ids.append(doc_id)
                held.append(flag)
                sizes.append(sum(found.values()))
                size += len(raw)
                if size >= BLOCK_CHARS:
                    yield packed(number, local, pairs, ids, held, sizes)
                    number, size = number + 1, 0
                    local.clear()
                    pairs, ids, held, sizes = [], [], [], []
        if ids:
            yield packed(number, local, pairs, ids, held, sizes)
        give_back()

    return run


def _rows(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(fields.values())], names=list(fields))


def _packed_words(parts: int, words: list[bytes], c: np.ndarray, lp: np.ndarray, lq: np.ndarray) -> pa.RecordBatch:
    """Scored words by word hash, in the columns of messages: counts in n_docs,
    log10 of the model's and of the lattice's probability in docs and times."""
    part = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts
    by = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[by], np.arange(parts + 1))
    rows = []
    for p in np.flatnonzero(np.diff(cut)).tolist():
        mine = by[cut[p] : cut[p + 1]]
        own = [words[i] for i in mine.tolist()]
        rows.append((p, DICTIONARY, b"".join(own), varints(np.array([len(w) for w in own])), varints(c[mine]), lp[mine].tobytes(), lq[mine].tobytes(), None, None, None))
    return _rows(rows, _MESSAGE)


def _split(blob: bytes, lens: bytes) -> Iterator[bytes]:
    at = 0
    for end in np.cumsum(from_varints(lens)).tolist():
        yield blob[at:end]
        at = end


def _partial_sums(base_denominator: float):
    """Sums over the words of one part, for every document of a block.  Rows come
    by part, the part's words before its messages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known, read, columns = None, {}, [], []
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["part"] != part:
                    part, known, read, columns = r["part"], {}, [], []
                if r["block"] == DICTIONARY:
                    for word in _split(r["words"], r["lens"]):
                        known[word] = len(known)
                    read.append((from_varints(r["n_docs"]), np.frombuffer(r["docs"]), np.frombuffer(r["times"])))
                    continue
                if r["doc_ids"] is not None:
                    rows.append((r["block"], *[None] * (2 + len(_SUMS)), r["doc_ids"], r["held"], r["sizes"]))
                    continue
                if read:
                    c, lp, lq = map(np.concatenate, zip(*read))
                    columns, read = [c > 0, lp, lq, np.log10((c + 1.0) / base_denominator)], []
                n, gap, times = (from_varints(r[k]) for k in ("n_docs", "docs", "times"))
                heads = np.cumsum(n) - n
                total = np.cumsum(gap)
                doc = total - np.repeat(total[heads] - gap[heads], n)
                word = np.repeat(np.array([known[w] for w in _split(r["words"], r["lens"])]), n)
                docs, where = np.unique(doc, return_inverse=True)
                n_known, *sums = [np.bincount(where, times * w[word], len(docs)) for w in columns]
                rows.append((r["block"], varints(np.diff(docs, prepend=0)), varints(n_known), *[x.tobytes() for x in sums], None, None, None))
            yield _rows(rows, _PARTIAL)
        give_back()

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the packed sums of every block."""
    rows = (r for b in batches for r in b.to_pylist())
    for _, group in itertools.groupby(rows, key=lambda r: r["block"]):
        group = list(group)
        head = next(r for r in group if r["doc_ids"] is not None)
        n_known, *sums = (np.zeros(len(head["doc_ids"])) for _ in range(1 + len(_SUMS)))
        for r in group:
            if r["docs"] is not None:
                at = np.cumsum(from_varints(r["docs"]))
                n_known[at] += from_varints(r["n_known"])
                for total, name in zip(sums, _SUMS):
                    total[at] += np.frombuffer(r[name])
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(head[c], t.value_type) for c, t in _HEADER.items()], pa.array(n_known.astype(np.int64)), *map(pa.array, sums)],
            names=["doc_id", "held", "size", "n_known", *_SUMS])


def score(docs: DataFrame, file: str, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    lattice_score) for every row; lattice_score is the log10 probability by the
    lattice alone, without the words' own counts.

    ``held_out`` marks rows the model does not learn from (default: the crc32
    fold of the id).  Runs jobs while it is called: counts, and one per round.
    """
    spark = docs.sparkSession
    text_batches(spark)
    flag = held_out_flag(F.col(id_col)) if held_out is None else held_out
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(flag, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    counts_at = scratch_path(spark, "words")
    texts.select("held", "text").mapInArrow(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).write.parquet(counts_at)
    counts = spark.read.parquet(counts_at)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count("*").alias("words")).first()
    ends = texts.where(~F.col("held")).count()
    n, v = total["n"] + ends, total["v"] + (ends > 0)

    pieces, weight = vocabulary(file)  # bounded by the vocabulary's size
    first = weight.copy()
    for _ in range(rounds):
        logp = np.log(weight)

        def expect(batches: Iterator[pa.RecordBatch], logp: np.ndarray = logp) -> Iterator[pa.RecordBatch]:
            table, uses = Pieces(pieces), np.zeros(len(pieces))
            for chunk in chunks(batches):
                words = chunk.column("word").to_pylist()
                uses += forward(table, logp, words, np.ones(len(words)))[1]
            used = np.flatnonzero(uses > 0)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(uses[used])], names=["piece", "uses"])

        found = counts.where("c > 0").select("word").mapInArrow(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.zeros(len(pieces))
        uses[found.column("piece").to_numpy()] = found.column("uses").to_numpy()
        weight = uses + first  # the first weights stand in for unseen pieces
        weight /= weight.sum()
    logp = np.log(weight)
    # Words start with a marked piece, so the products of weights sum to 1 over all words; the end takes its share.
    end_share = min(ends / n, n / (n + 1)) if n else 0.5  # words keep a chance where all training texts are empty

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total["words"] // PART_WORDS), 1)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Pieces(pieces)
        for chunk in chunks(batches):
            words, c = chunk.column("word").to_pylist(), chunk.column("c").to_numpy()
            log_q = forward(table, logp, words)[0] + np.log1p(-end_share)
            log_p = log_q
            if n + v:
                with np.errstate(divide="ignore"):
                    log_p = np.logaddexp(np.log(c), np.log(v) + log_q) - np.log(n + v)
            yield _packed_words(parts, words, c, log_p / np.log(10), log_q / np.log(10))
        give_back()

    dictionary = counts.mapInArrow(scored, _MESSAGE_DDL)
    sent = texts.mapInArrow(_messages(parts), _MESSAGE_DDL)
    denominator = float(n + v + 1)
    met = dictionary.unionByName(sent).repartition("part").sortWithinPartitions("part", "block")
    sums = met.mapInArrow(_partial_sums(denominator), _PARTIAL_DDL)
    totals = sums.repartition("block").sortWithinPartitions("block").mapInArrow(_totals, f"doc_id long, held boolean, size long, n_known long, {', '.join(f'{c} double' for c in _SUMS)}")
    end_base = float(np.log10((ends + 1) / denominator))
    end_p = (ends + v * end_share) / (n + v) if n + v else end_share
    return totals.select(
        "doc_id", F.col("held").alias("held_out"), (F.col("size") + 1).alias("n_tokens"), (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + end_base).alias("base_score"), (F.col("score") + float(np.log10(end_p))).alias("score"), (F.col("lattice_score") + float(np.log10(end_share))).alias("lattice_score"))
