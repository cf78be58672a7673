"""What thresholds and patterns must not leave out."""

import numpy as np
import pyarrow as pa

from lexweave.llm import automata, cotrain, feistel, lineruns


def test_short_repeated_lines_go(spark):
    notice, trivial = "Licensed under the Apache License, Version 2.0.", ["", "Yes, indeed.", "| --- | --- |"]
    df = spark.createDataFrame([(i, "\n".join(x for t in [notice, *trivial] for x in (f"own line {i} before {t}", t))) for i in range(4)], "doc_id long, text string")
    out = {r.doc_id: r for r in lineruns.decide(df).collect()}
    assert out[0].n_deleted == 0 and notice in out[0].text
    for i in range(1, 4):
        assert out[i].n_deleted == 1 and out[i].text == "\n".join(x for t in [notice, *trivial] for x in (f"own line {i} before {t}", t) if x != notice)


def test_candidates_beside_letters_and_marks(spark):
    same = [("2024-03-05", "2024-03-05T12:34:56Z"), ("31.12.1999", "31.12.1999T08:00"), ("2024/2/29", "2024/2/29t1"), ("john@x.com", "_john@x.com"), ("j.ohn7@x.com", "+j.ohn7@x.com"), ("a@x.com", f"{'.' * 63}a@x.com"), ("212-555-0100", "2125550100")]
    other = ["1700000000", "0.2125550100", "2125550100.5", "21255501001", "2024-13-05T12:00", "2024-03-05Tea", "-@x.com", f"{'.' * 64}a@x.com"]
    texts = [f"on {t}, so" for pair in same for t in pair] + other
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = feistel.pseudonymise(df, "k")
    got = {r.doc_id: r for r in made.collect()}
    bare = lambda t: "".join(c for c in t if c.isalnum())
    for i, (plain, marked) in enumerate(same):
        a, b = got[2 * i], got[2 * i + 1]
        assert len(a.kinds) == 1 and a.kinds == b.kinds and a.text != texts[2 * i]
        rest = marked[len(plain):] if marked.startswith(plain) else ""
        assert bare(b.text) == bare(a.text.replace(", so", f"{rest}, so"))
    assert [got[2 * len(same) + i].text for i in range(len(other))] == other and not any(got[2 * len(same) + i].kinds for i in range(len(other)))
    assert {r.doc_id: r.text for r in feistel.restore(made.select("doc_id", "text"), "k").collect()} == dict(enumerate(texts))


def test_a_rare_telling_word_gets_a_weight(spark):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join([*(f"w{x}" for x in rng.integers(0, 200, 20)), *(["vile"] if i % 350 == 9 else [])]), "en", "src", 80) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 350 == 9)) for i in range(2000)], "doc_id long, quality int, toxic int")
    assert cotrain.fit(df, labels).views["text"].weights.get(b"vile", 0.0) < 0


def test_equal_ids_and_order(spark):
    """Of two texts of one id always the same one trains; pseudo-labels come
    from all unlabelled documents, the most confident first."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i % 300, " ".join(rng.choice(words, 12)) + (" awful" if i % 3 == 0 else " fine"), "en", "a" if i % 3 else "b", 80) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    fits = [cotrain.fit(spark.createDataFrame(order, kind), labels) for order in (rows, rows[::-1])]
    a, b = (m.views["text"].weights for m in fits)
    assert a.keys() == b.keys() and all(abs(a[w] - b[w]) < 1e-9 for w in a) and abs(fits[0].shift - fits[1].shift) < 1e-9
    df, known = cotrain.readable(spark.createDataFrame(rows, kind)), cotrain.judged(labels)
    views = {"text": cotrain.View({b"fine": 9.0, b"w1": 0.5}, -4.0), "page": cotrain.View({}, 0.0)}
    found = cotrain.pseudo_labels(df, known, views, {1: 10, 0: 5}, {200, 201})
    assert found["page"] == {} and sorted(found["text"].values()) == [0.0] * 5 + [1.0] * 10
    assert all(200 < i < 300 and i not in (200, 201) and y == (i % 3 != 0) for i, y in found["text"].items())
    best = {i for i, t, *_ in rows if i > 201 and "fine" in t and "w1 " in t}
    assert {i for i, y in found["text"].items() if y} <= best


def test_automata_kept_by_a_task_are_bounded_by_their_states(monkeypatch):
    alive: dict[int, int] = {}
    most = 0

    class Counted(automata.SuffixAutomaton):
        def __init__(self, sequences):
            nonlocal most
            super().__init__(sequences)
            alive[id(self)] = len(self.next)
            most = max(most, sum(alive.values()))

        def __del__(self):
            alive.pop(id(self), None)

    monkeypatch.setattr(automata, "SuffixAutomaton", Counted)
    shards = [b" ".join(b"%d-%d" % (i, j) for j in range(3000)) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([s.decode() for s in shards]), pa.array([[s] for s in shards], pa.list_(pa.binary()))], names=["doc_id", "_text", "_shards"])
    out = pa.Table.from_batches(list(automata._streamed(50, ["doc_id"])([batch])))
    assert out.column("n_removed").to_pylist() == [3000] * 60
    assert most < 110_000  # 180,000 if all are kept
