"""Operators on documents against plain Python, and on hard and empty tables."""

import collections
import itertools
import math
import os
import re
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lexweave.llm import automata, bpe, contain, cotrain, feistel, forest, lattice, lineruns

BPE, PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
SPACE, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def shingles(text, n=5):
    w = ALNUM.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_bpe(docs, empty):
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(BPE), special_tokens={})
    want = sorted(((i, enc.encode_ordinary(t or "")) for i, t in rows_of(docs)), key=str)
    for size in (500, bpe.BLOCK_CHARS):
        out = bpe.decode(bpe.encode(docs, BPE, public_tokenizers.PATTERN, block_chars=size), BPE).collect()
        assert sorted(((r.doc_id, list(r.ids)) for r in out), key=str) == want
        assert all(bytes(r.decoded) == b"".join(enc.decode_single_token_bytes(i) for i in r.ids) and r.n_tokens == len(r.ids) for r in out)
    packed = bpe.encode(docs, BPE, public_tokenizers.PATTERN, packed=True).collect()
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in packed), key=str) == want
    assert bpe.encode(empty, BPE, public_tokenizers.PATTERN).count() == 0


def test_varints():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40])
    assert bpe.from_varints(bpe.varints(values)).tolist() == values.tolist()
    assert bpe.from_varints(bpe.varints(values[:0])).tolist() == []


def brute_lattice(pieces, logp, word):
    data, table = lattice.MARK + word, dict(zip(pieces, logp))
    total = [0.0] + [-math.inf] * len(data)
    for i in range(1, len(data) + 1):
        for j in range(i):
            inside = 0 < j < 3 or i < 3
            if not inside and data[j:i] in table:
                total[i] = np.logaddexp(total[i], total[j] + table[data[j:i]])
    return total[-1]


def brute_uses(weight, words):
    """Expected uses of every piece over the segmentations of every word."""
    uses = collections.Counter()
    for word in words:
        data = lattice.MARK + word
        arcs = [(j, i) for i in range(3, len(data) + 1) for j in range(max(0, i - 60), i) if not 0 < j < 3 and data[j:i] in weight]
        before, after = [1.0] + [0.0] * len(data), [0.0] * len(data) + [1.0]
        for j, i in arcs:
            before[i] += before[j] * weight[data[j:i]]
        for j, i in reversed(arcs):
            after[j] += weight[data[j:i]] * after[i]
        for j, i in arcs:
            uses[data[j:i]] += before[j] * weight[data[j:i]] * after[i] / before[-1]
    return uses


def test_forward_sums_all_segmentations():
    pieces, weight = lattice.vocabulary(PIECES)
    words = ["the", "naïve", "segmentation", "日本語", "x" * 40, "▁odd"]
    got, uses = lattice.forward(lattice.Pieces(pieces), np.log(weight), [w.encode() for w in words], np.ones(len(words)))
    assert np.allclose(got, [brute_lattice(pieces, np.log(weight), w.encode()) for w in words])
    # expected uses cover every byte of every word once
    assert math.isclose(sum(u * len(p) for u, p in zip(uses, pieces)), sum(len(w.encode()) + 3 for w in words), rel_tol=1e-9)


def test_lattice_scores(docs, empty, monkeypatch):
    out = lattice.score(docs, PIECES).collect()
    tokens = [(i, [*SPACE.findall((t or "").translate(LOWER)), None]) for i, t in rows_of(docs)]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    # the model in plain Python: refitted weights, then counts and lattice by Witten-Bell
    pieces, weight = lattice.vocabulary(PIECES)
    words = {w for w in c if w is not None}
    fitted = weight
    for _ in range(lattice.ROUNDS):
        uses = brute_uses(dict(zip(pieces, fitted)), [w.encode() for w in words])
        fitted = np.array([uses[p] for p in pieces]) + weight
        fitted /= fitted.sum()
    every = {w for _, ws in tokens for w in ws if w is not None}
    end = c[None] / n
    q = {w: (1 - end) * math.exp(brute_lattice(pieces, np.log(fitted), w.encode())) for w in every} | {None: end}
    for r in out:
        r_words = next(ws for i, ws in tokens if i == r.doc_id and len(ws) == r.n_tokens)
        if sum(i == r.doc_id for i, _ in tokens) == 1:
            assert math.isclose(r.lattice_score, sum(math.log10(q[w]) for w in r_words), rel_tol=1e-9)
            assert math.isclose(r.score, sum(math.log10((c[w] + v * q[w]) / (n + v)) for w in r_words), rel_tol=1e-9)
    for part_words in (1, lattice.PART_WORDS):  # a part a word; long parts
        monkeypatch.setattr(lattice, "PART_WORDS", part_words)
        again = lattice.score(docs.limit(8), PIECES).collect()
        assert len(again) == 8 and all(math.isfinite(r.lattice_score) for r in again)
    assert lattice.score(empty, PIECES).count() == 0
    blank = lattice.score(docs.withColumn("text", F.when(F.col("doc_id") == 1, F.lit("one two"))), PIECES, held_out=F.col("doc_id") == 1).collect()
    assert all(math.isfinite(r.score) and math.isfinite(r.lattice_score) for r in blank)  # all training texts are empty
    unseen = lattice.score(docs, PIECES, held_out=F.lit(True)).collect()
    assert {(r.train_tokens, r.n_known) for r in unseen} == {(0, 0)} and all(math.isfinite(r.score) for r in unseen)


def line_oracle(rows, min_lines, min_words):
    seen, out = {}, []
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    dead = collections.defaultdict(set)
    for doc in order:
        lines = doc[1].split("\n")
        for p in range(len(lines)):
            keys = [("l", *lines[p : p + min_lines])] if p + min_lines <= len(lines) else []
            if min_lines > 1 and len(SPACE.findall(lines[p])) >= min_words:
                keys.append(("w", lines[p]))
            for k in keys:
                if k in seen:
                    dead[doc].update(range(p, p + len(k) - 1))
                seen.setdefault(k, doc)
    for i, t in rows:
        gone = dead[(i, t)]
        out.append((i, t if not gone else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone), 0 if t is None else t.count("\n") + 1, len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("min_lines", "min_words"), [(1, 1), (2, 20), (3, 6), (4, 1000)])
def test_line_runs(docs, empty, min_lines, min_words):
    # equal ids with different texts are ordered by a hash, so the plain version gets them apart
    single = docs.where("doc_id is null or doc_id <> 11 or text not like 'alpha%'")
    out = lineruns.decide(single, min_lines=min_lines, min_words=min_words)
    assert [c for c in out.columns if c not in ("n_lines", "n_deleted")] == docs.columns
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_deleted) for r in out.collect()), key=str)
    assert got == line_oracle(rows_of(single), min_lines, min_words)
    assert lineruns.decide(empty).count() == 0


def test_substrings(docs, empty):
    out = automata.dedup(docs, width=50, carry=("lang", "dk"))
    rows = rows_of(docs)
    first = {}
    words = [(i, SPACE.findall(t or "")) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - 49):
            if i is not None:
                first[tuple(w[p : p + 50])] = min(first.get(tuple(w[p : p + 50]), i), i)
    want = []
    for i, w in words:
        dead = {q for p in range(len(w) - 49) if i is not None and first[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        want.append((str(i), len(w), len(dead), " ".join(x for j, x in enumerate(w) if j not in dead)))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in out.collect()) == sorted(want)
    assert any(n for _, _, n, _ in want)
    tiny = automata.dedup(docs, width=50, filter_bits=64)  # a full filter only means more to look up
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in tiny.collect()) == sorted(want)
    assert automata.dedup(empty).count() == 0


def test_suffix_automaton():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sequences = [[b"%d" % x for x in rng.integers(0, 3, rng.integers(0, 30))] for _ in range(4)]
        words = [b"%d" % x for x in rng.integers(0, 4, 40)]
        known = {tuple(s[i : i + 5]) for s in sequences for i in range(len(s) - 4)}
        want = {q for p in range(len(words) - 4) if tuple(words[p : p + 5]) in known for q in range(p, p + 5)}
        spans = automata.SuffixAutomaton(sequences).repeats(words, 5)
        assert {q for a, b in spans for q in range(a, b)} == want
        assert all(a[1] < b[0] for a, b in itertools.pairwise(spans))


def near_oracle(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    first = {g: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for g, m in members.items()}
    return sorted((str(rows[i][0]), str(first[find(i)]), links[i]) for i in range(len(rows))), len(members)


@pytest.mark.parametrize("block", [2, 2048])
def test_forest(docs, empty, block):
    want, n_groups = near_oracle(rows_of(docs))
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in forest.join(docs, block=block).collect())
    assert got == want
    if block > 2:
        kept = forest.one_per_group(docs)
        assert kept.columns == docs.columns and kept.count() == n_groups
        assert forest.join(empty).count() == 0 and forest.one_per_group(empty).count() == 0


def test_prefix_length():
    assert forest.prefix_length(0.8) == 4
    assert 1 - (1 - 0.8**4) ** forest.TREES >= forest.RECALL > 1 - (1 - 0.8**5) ** forest.TREES


def test_containment(spark, docs, empty):
    text = dict((i, t) for i, t in rows_of(docs) if i is not None)
    w = text[10].split()
    items = [(1, " ".join(w[30:60])), (2, " ".join(w[30:50] + ["odd"] + w[50:70])), (3, "one two"), (4, None), (None, " ".join(w[40:60]).upper() + " !"), (5, " ".join(f"w{i}" for i in range(40))), (6, " ".join(w[30:60])), (7, " ".join(text[4].split()[3000:3040])), (8, "Two"), (9, " ".join(w[40:44]).upper() + "."), (10, "two one"), (11, " !")]
    tests = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, dk int")
    want, bad = [], set()
    for (d, t), (i, s) in itertools.product(rows_of(docs), items):
        item, size = shingles(s), len(ALNUM.findall(s or ""))
        held = shingles(t, min(5, size)) if size else set()
        if item and len(item & held) >= 0.8 * len(item) - 1e-9:
            want.append((str(d), str(i), len(item), len(item & held)))
            if size >= contain.MIN_WORDS:
                bad.add((d, t))
    assert {"3", "8", "9"} < {i for _, i, _, _ in want} and not {"4", "10", "11"} & {i for _, i, _, _ in want}
    for bits in (64, contain.FILTER_BITS):
        got = contain.matches(docs, tests, filter_bits=bits).collect()
        assert sorted((str(r.doc_id), str(r.item_id), r.item_shingles, r.matched) for r in got) == sorted(want)
    clean = contain.clean(docs, tests)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in rows_of(docs) if r not in bad)
    assert contain.matches(empty, tests).count() == 0 and contain.clean(docs, tests.limit(0)).count() == docs.count()


def test_sketch_never_misses():
    for n in range(1, 400):
        assert contain.sketch_size(n) > min(n - 1, math.floor(0.2 * n + 1e-9))


VALUES = [
    ("email", "bosbt.42@mail8.example.com"), ("email", "x@y.org"), ("email", "Very.Long-Name.with.many.letters1234567890@mail.example.org"), ("phone", "+1 (988) 555-2485"), ("phone", "212-555-0100"), ("phone", "+44 20 7946 0958"),
    ("card", "4111 1111 1111 1111"), ("card", "378282246310005"), ("iban", "DE89370400440532013000"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "123-45-6789"), ("ip", "70.123.182.155"),
    ("date", "1999-02-28"), ("date", "2000-02-29"), ("date", "31.12.1999"), ("date", "12/31/1999"),
    (None, "4111 1111 1111 1112"), (None, "DE89370400440532013001"), (None, "666-45-6789"), (None, "300.1.1.1"), (None, "2001-02-29"), (None, "version 3.0 of 2020"),
]


def test_feistel(spark, docs, empty):
    rows = [(i, v) for i, (_, v) in enumerate(VALUES)] + [(100, f"a {VALUES[0][1]}, then {VALUES[6][1]}; {VALUES[0][1]}.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = feistel.pseudonymise(df, "k")
    got = {r.doc_id: r for r in made.collect()}
    other = {r.doc_id: r.text for r in feistel.pseudonymise(df, "another").collect()}
    for i, (kind, v) in enumerate(VALUES):
        assert got[i].kinds == ([kind] if kind else [])
        assert (got[i].text != v) == (kind is not None) and (kind is None or got[i].text != other[i] or v == "x@y.org")
        assert re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", got[i].text.split("@")[0]))) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", v.split("@")[0]))) or kind == "ip"
    assert got[100].text == f"a {got[0].text}, then {got[6].text}; {got[0].text}." and got[100].kinds == ["email", "card", "email"]
    again = made.select("doc_id", "text")
    assert {r.doc_id: r.kinds for r in feistel.pseudonymise(again, "k").collect()} == {i: r.kinds for i, r in got.items()}  # pseudonyms are valid values
    assert {r.doc_id: r.text for r in feistel.restore(again, "k").collect()} == dict(rows)
    hard = feistel.pseudonymise(docs, "k")
    assert hard.columns == [*[c for c in docs.columns if c != "kinds"], "kinds"] and sorted(map(str, rows_of(hard))) == sorted(map(str, rows_of(docs)))
    assert feistel.pseudonymise(empty, "k").count() == 0


def test_feistel_permutes(spark):
    """All values of small formats map onto the same set, one to one."""
    dates = [f"{y}-{m:02d}-{d:02d}" for y in (1904, 1999) for m in range(1, 13) for d in range(1, 32) if d <= [31, 29 if y == 1904 else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m - 1]]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "doc_id long, text string")
    out = [r.text for r in feistel.pseudonymise(df, "k").collect()]
    assert len(set(out)) == len(dates) == len(feistel.restore(df, "k").distinct().collect()) and all(1900 <= int(t[:4]) < 2100 for t in out)


def test_phone_forms_are_linked(spark):
    """One number in several forms has one pseudonym; country codes stay; restore undoes all."""
    groups = [
        ["+12125550199", "+1 212 555 0199", "+1-2125550199", "(212) 555-0199", "212.555.0199", "2125550199"], ["+442079460958", "+44 20 7946 0958", "+44-20-79460958"],
        ["+4930123456", "+49 30 123456"], ["+353 12 234 5678", "+353122345678"], ["(012) 155-0199", "012-155-0199", "+1 (012) 155-0199"], ["+7 495 123 45 67", "+74951234567"], ["+380 44 123 4567", "+380441234567"]]
    texts = [v for g in groups for v in g]
    made = feistel.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k")
    got = {texts[r.doc_id]: r for r in made.collect()}
    assert all(r.kinds == ["phone"] and r.text != v and re.sub("[0-9]", "9", r.text) == re.sub("[0-9]", "9", v) for v, r in got.items())
    for group, code in zip(groups, ("1", "44", "49", "353", "1", "7", "380")):
        forms = {re.sub("[^0-9]", "", got[v].text) if v.startswith("+") else "1" + re.sub("[^0-9]", "", got[v].text) for v in group}
        assert len(forms) == 1 and forms.pop().startswith(code)
    assert {r.doc_id: r.text for r in feistel.restore(made.select("doc_id", "text"), "k").collect()} == dict(enumerate(texts))


def test_cotraining(spark, docs, empty):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = [f"w{x}" for x in rng.integers(0, 300, 40)]
        if bad:
            words[int(rng.integers(0, 40))] = "awful"
        rows.append((i, " ".join(words), "en", "spam" if bad and i % 8 else "good", len(words)))
        if i < 400:
            labels.append((i, 1, int(bad)))
    df = spark.createDataFrame(rows, docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    known = spark.createDataFrame([*labels, (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = cotrain.fit(df, known)
    out = cotrain.score(df, model).collect()
    held = [r for r in out if r.doc_id >= 400]
    assert sum(r.keep == bool(r.doc_id % 4) for r in held) / len(held) > 0.97
    hard = cotrain.score(docs, model)
    assert hard.columns == [*[c for c in docs.columns if c != "keep"], "text_score", "page_score", "quality_score", "keep"] and hard.count() == docs.count()
    assert cotrain.score(empty, model).count() == 0
    none = cotrain.fit(df, known.limit(0))
    assert {(r.quality_score, r.keep) for r in cotrain.score(docs, none).collect()} == {(1.0, True)}
    assert cotrain.fit(df, known.where("toxic = 1")).prior == 0.0 and cotrain.fit(empty, known).views is None


def test_repository_without_the_subpackage(tmp_path):
    """The entry imports, and keeps its other queries, without these folders."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import importlib.util, sys
sys.path.insert(0, {root!r})
real = importlib.util.find_spec
importlib.util.find_spec = lambda name, package=None: None if name.startswith(("lexweave.llm", "corpus_pipeline")) else real(name, package)
import __spark_entry__ as e
assert len(e.queries()) > 200 and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)

