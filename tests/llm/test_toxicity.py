"""Toxicity: the kernel against its definition, held-out accuracy, and odd rows."""

import zlib
from itertools import combinations

import numpy as np
import pytest

from nearfield.llm import toxicity


def plain_kernel(a, b):
    def parts(w):
        out = {}
        w = "\x02" + w + "\x03"
        for at in combinations(range(len(w)), toxicity.ORDER):
            if at[-1] - at[0] >= toxicity.SPAN:
                continue
            key = "".join(w[i] for i in at)
            out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    x, y = parts(a), parts(b)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def test_kernel_equals_its_definition():
    marks = ["idiot", "réeux", "aa", "stst", "\U0001f600x"]
    words = ["idiot", "i.d.i.o.t", "idi0t", "x", "aaaa", "réeuxpa", "zzz", "\U0001f600\U0001f600x", "tsts"]
    got = toxicity.Landmarks([m.encode() for m in marks]).alike([w.encode() for w in words])
    assert got == pytest.approx(np.array([[plain_kernel(w, m) for m in marks] for w in words]), abs=1e-5)


def test_vectors_have_the_kernel_as_inner_product():
    words = [w.encode() for w in ("idiot", "idi-ot", "clown", "table", "tables", "the")]
    marks = toxicity.Landmarks(words)
    v = marks.vectors(words)
    assert v @ v.T == pytest.approx(marks.kernel(words), abs=0.02)


def test_words_and_sentences():
    assert toxicity.words_of(b"You  i d i o t, stupid*** (x) \xc3\xa9t\xc3\xa9") == [b"you".replace(b"y", b"Y"), b"idiot", b"stupid", b"x", b"\xc3\xa9t\xc3\xa9"]
    long = bytes(range(97, 123)) * 4
    assert b"".join(w[:16] for w in toxicity.words_of(long)[:-1]) + toxicity.words_of(long)[-1] == long
    assert [b" ".join(s) for s in toxicity.sentences("A b. Cd e.f! g\nIJ kl")] == [b"ab", b"cd e.f", b"g", b"ij kl"]
    assert list(toxicity.sentences(None)) == list(toxicity.sentences(" . \n")) == []


def made_up(n, seed):
    rng = np.random.default_rng(seed)
    plain = ["the", "weather", "of", "river", "stone", "house", "walks", "green", "market", "letter", "under", "sings", "old", "paper", "idol", "stupor", "clone"]
    forms = [lambda w: w, lambda w: ".".join(w), lambda w: w[:2] + "x" + w[2:], lambda w: " ".join(w), lambda w: w.upper() + "!!"]
    rows, labels = [], []
    for i in range(n):
        lines = [" ".join(rng.choice(plain, rng.integers(3, 12))) + "." for _ in range(rng.integers(1, 6))]
        bad = i % 3 == 0
        if bad:
            insult = forms[rng.integers(len(forms))](str(rng.choice(["idiot", "stupid", "moron", "clown"])))
            lines[rng.integers(len(lines))] += " you " + insult + " there."
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(bad)))
    return rows, labels


def test_gapped_insults_are_found_and_clean_rows_left(spark):
    rows, labels = made_up(900, 1)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.predict_toxicity(docs, marks).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.7) for i in got)
    held = [i for i in got if got[i].held_out]
    caught = [got[i].predicted for i in held if i % 3 == 0]
    left = [1 - got[i].predicted for i in held if i % 3]
    assert np.mean(caught) > 0.9 and np.mean(left) > 0.98
    again = {r.doc_id: r.score for r in toxicity.predict_toxicity(docs.repartition(7), marks).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-6 for i in got)


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = toxicity.predict_toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).where("held_out").join(labels, "doc_id").toPandas()
    bad = found.toxic == 1
    assert found.predicted[bad].mean() > 0.8 and found.predicted[~bad].mean() < 0.02  # some labels are noise


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, None), (3, 0, "y"), (4, None, "z"), (5, 1, "z"), (None, 1, "z"), (6, 0, "")], "doc_id long, toxic int, text string")
    got = toxicity.predict_toxicity(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got) and {r.doc_id for r in got} == {None, 1, 2, 3, 4, 5, 6}
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert toxicity.predict_toxicity(empty, labels).count() == 0
    none, ones = labels.limit(0), labels.where("toxic = 1")
    assert {r.score for r in toxicity.predict_toxicity(odd, none).collect()} == {0.5}
    assert all(r.score > 0.99 for r in toxicity.predict_toxicity(odd, ones).collect())


def test_a_very_long_text_is_scored_whole(spark):
    rows, labels = made_up(300, 2)
    filler = "the green river sings under the old stone house. " * 30_000
    rows += [(9001, filler + "you stupid idiot there. " + "x" * 100_000), (9002, filler)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.predict_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got[9001] > got[9002]
