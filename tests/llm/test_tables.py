"""Operators on conversations and embeddings, and the named queries' digests."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
from harness import compare, connect
from lexweave.llm import bpe, chat, crosspoly, queries

DIR = "/root/testdata/sf0.001"
TRICKY = ["\\### Assistant: </turn> ok", "a\\", "</turn>\n### user: x</turn>\n", "####  \\\\### \\", "", None, "plain", "é\U0001f600 ### "]


def turns(spark):
    rows = []
    for conv in (1, 2, None):
        rows.append((conv, 0, "system", "be brief " * (3 if conv else 200)))
        rows += [(conv, i + 1, ("user", "assistant", "to:ol \\", None)[i % 4], (TRICKY[i % len(TRICKY)] if i % 3 else f"turn {i} " * (i % 29 + 1))) for i in range(60)]
    rows += [(3, None, "user", "hi"), (3, None, "user", "hi"), (3, 1, "assistant", "yes " * 900), (4, 0, "system", "only"), (5, 0, "assistant", None)]
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("window", F.lit(0)).withColumn("n", F.lit("x"))


def test_chat_round_trip(spark):
    df = turns(spark)
    made = chat.windows(df, window_tokens=128, history=32).cache()
    out = {r.conv_id: r for r in chat.read_back(made).collect()}
    by = {}
    for r in df.collect():
        by.setdefault(r.conv_id, []).append((-1 if r.turn is None else r.turn, r.role or "", r.text or ""))
    assert set(out) == set(by)
    for conv, rows in by.items():
        rows = sorted(rows)
        learn = "".join(t for _, role, t in rows if role == "assistant")
        got = out[conv]
        assert got.n_turns == len(rows) and got.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in rows).encode()).hexdigest()
        assert (got.loss_chars, got.loss_sha256) == (len(learn), hashlib.sha256(learn.encode()).hexdigest())
    tokens = lambda t: 4 + len(t.split())
    for r in made.collect():
        parsed = chat.parse(r.text)
        system = parsed[0][0] == "system"
        repeated, new = parsed[: r.n_repeated], parsed[r.n_repeated :]
        assert new and (r.conv_id in (3, 5) or system)
        assert sum(tokens(t) for _, t in repeated if _ != "system") <= 32
        fresh = [t for role, t in new if role != "system"]
        lead = tokens(parsed[0][1]) if system else 0
        assert len(fresh) <= 1 or sum(map(tokens, fresh)) <= max(128 - 32 - lead, 32)
        assert "".join(r.text[s.start : s.end] for s in r.loss) == "".join(chat_escape(t) for role, t in new if role == "assistant")
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0


def chat_escape(t):
    return t.replace("\\", "\\\\").replace("### ", "\\### ").replace("</turn>", "\\</turn>")


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % 50 == 0:
            near = sorted((-(v / np.linalg.norm(v)) @ (w / np.linalg.norm(w)), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def test_cross_polytope(spark):
    rng = np.random.default_rng(1)
    same = rng.normal(size=16).tolist()
    rows = [(i, rng.normal(size=16).tolist()) for i in range(600)] + [(i, same) for i in range(600, 700)]
    rows += [(700, None), (750, [0.0] * 16), (800, [float("nan")] + [1.0] * 15), (850, [None] + [1.0] * 15), (900, []), (None, same), (950, [1.0, 2.0]), (951, [2.0, 1.0]), (952, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("bucket", F.lit(1))
    want = brute(rows, 5)
    got = {}
    for r in crosspoly.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and [j for j, _ in got[950]] == [951, 952]
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert [j for j, _ in got[600]] == [601, 602, 603, 604, 605] and [j for j, _ in got[650]] == [600, 601, 602, 603, 604]
    exact = {q: {j: s for j, s in near} for q, near in brute(rows, 10_000).items()}
    assert all(abs(exact[q][j] - s) < 1e-12 for q, near in got.items() for j, s in near)
    assert crosspoly.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 24))
    scores = crosspoly.axis_scores(x, 1, 0)
    assert np.allclose((scores[:, ::2] ** 2).sum(1), (x**2).sum(1)) and np.allclose(scores[:, ::2], -scores[:, 1::2])
    two = crosspoly.probes_of(x, 0, 2, 7)
    assert two.shape == (5, 7) and all(len(set(r)) == 7 for r in two.tolist()) and (two[:, :1] == crosspoly.probes_of(x, 0, 2, 1)).all()


def test_named_queries(spark):
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in queries.QUERIES} and set(queries.QUERIES) | {"pipeline"} <= names
    con = connect(DIR)
    for name in queries.ORACLES:
        assert [p for p in compare(queries.QUERIES[name](spark, DIR), con, queries.ORACLES[name]) if p != "EMPTY"] == []


def test_bpe_digests(spark):
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    for r in queries.op6(spark, DIR).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


@pytest.mark.parametrize("name", ["op1_cotraining", "op2_lattice_likelihood", "op4_feistel_pseudonyms", "op9_jaccard_forest", "op10_line_runs"])
def test_one_row_per_document(spark, name):
    out = queries.QUERIES[name](spark, DIR)
    ids = [r.doc_id for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(ids)


def test_pipeline(spark):
    """The stages one after another, each against what it must keep and drop."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id: r for r in cp.run(spark, DIR).collect()}
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontaminate", "tokens"]
    assert 0 < len(out) < len(texts) and all(r.n_tokens == len(r.ids) for r in out.values())
    assert all(set(r.text.split("\n")) <= set(texts[i].split("\n")) for i, r in out.items())
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, DIR).columns == docs.columns
    one_each = cp.near_duplicates(spark, docs, DIR).collect()
    classes = {r.doc_id: r.class_id for r in queries.op9(spark, DIR).collect()}
    assert sorted(classes[r.doc_id] for r in one_each) == sorted(set(classes.values()))
    leaks = {r.doc_id for r in queries.op5(spark, DIR).collect()}
    assert {r.doc_id for r in cp.decontaminate(spark, docs, DIR).collect()} == set(texts) - leaks
