"""Collocations and periodic runs against brute force."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from nearfield.llm import collocations, periodic_runs
from nearfield.llm.common import SET_BITS, map_arrow, stored


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and not any(o[:2] == (i, j - i + q) for o in out):
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out)


def test_transform_turns_back_and_multiplies():
    rng = np.random.default_rng(1)
    for n in (1, 2, 16, 256):
        x, y = (rng.integers(0, periodic_runs.P, (n, 3)).astype(np.uint64) for _ in range(2))
        assert (periodic_runs.inverse(periodic_runs.transform(x)) == x).all()
        got = periodic_runs.inverse(periodic_runs.transform(x) * periodic_runs.transform(y) % np.uint64(periodic_runs.P))
        if n <= 16:
            want = [sum(int(x[j, 0]) * int(y[(d - j) % n, 0]) for j in range(n)) % periodic_runs.P for d in range(n)]
            assert got[:, 0].tolist() == want


def test_scales_hold_each_distance_once():
    for q in range(1, 3000):
        assert sum(a <= q <= b for a, b in (periodic_runs.distances(1 << k) for k in range(1, 14))) == 1
    assert all(4 * q >= 2 * b - 1 + q or q == 1 for b in (2, 4, 64) for q in range(*periodic_runs.distances(b)))


@pytest.mark.parametrize("slab", [1 << 17, 8])
def test_runs_equal_brute_force(monkeypatch, slab):
    monkeypatch.setattr(periodic_runs, "SLAB", slab)
    rng = random.Random(slab)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.choice([0, 1, 5, 6, 7, 60, 200, 400]), rng.choice([1, 2, 3, 50])
            w = [rng.randrange(k) for _ in range(n)]
            for _ in range(rng.randint(0, 3) if n else 0):
                a = rng.randrange(n)
                p, e = rng.randint(1, max(1, (n - a) // 3)), rng.randint(a, n)
                for i in range(a, e):
                    w[i] = w[a + (i - a) % p]
            docs.append(w)
        edges = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        got = periodic_runs.find_runs(np.array(sum(docs, []), dtype=np.int64), edges)
        assert got == [(s + int(e), n, q) for d, e in zip(docs, edges) for s, n, q in brute_runs(d)]


def digest(doc_id, text):
    words = [w for w in (text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def report(docs):
    return sorted((tuple(r) for r in periodic_runs.run_digest(periodic_runs.periodic_runs(periodic_runs.planted(docs))).collect()), key=str)


def test_run_digests_equal_brute_force(spark, odd, empty):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab  é\x1c") for _ in range(rng.randint(0, 160)))) for i in range(300)]
    rows += [(i, "a b c " * 40 + "x\ty\nz\x0bw " * 9) for i in range(300, 340)]
    assert report(spark.createDataFrame(rows, "doc_id long, text string")) == sorted((digest(*r) for r in rows), key=str)
    assert report(odd) == sorted((digest(r.doc_id, r.text) for r in odd.collect()), key=str)
    assert report(empty) == []


def test_a_very_long_text_of_runs(spark):
    text = "spam " * 200_000 + " ".join(f"w{i % 777}" for i in range(100_000)) + " end" * 3
    (row,) = periodic_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.n_words == 300_003 and [tuple(r) for r in row.runs] == [(0, 200_000, 1), (200_000, 100_000, 777)]
    assert row.collapsed == "spam " + " ".join(f"w{i}" for i in range(777)) + " end" * 3


def brute_collocations(rows, least, longest, top, percent):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for mark in ".,;:!?\n\v\f\r":
            lower = lower.replace(mark, ".")
        for piece in lower.split("."):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {p: c for p, c in f.items() if c >= least}
    scored = []
    for (lang, *w), a in found.items():
        inside = any(len(o) > len(w) + 1 and o[0] == lang and 100 * c >= percent * a and any(list(o[i : i + len(w)]) == w for i in range(1, len(o))) for o, c in found.items())
        if len(w) < 2 or inside:
            continue
        s, _, left, right = min((1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
        scored.append((lang, -s, -a, " ".join(w).encode(), left, right))
    out, place = [], Counter()
    for lang, s, a, phrase, left, right in sorted(scored):
        place[lang] += 1
        if place[lang] <= top:
            out.append((lang, place[lang], phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("part,known", [(1 << 19, 1 << 17), (150, 5)])
def test_collocations_equal_brute_force(spark, monkeypatch, part, known):
    for name, value in (("KNOWN", known), ("ROW_WORDS", 50)):
        monkeypatch.setattr(collocations, name, value)
    monkeypatch.setattr(collocations.count_phrases, "__defaults__", (part,))
    rng = random.Random(part)
    words = ["a", "B", "c d", "é", "\U0001f600", "zz", "x\x1c", "q"]
    rows = [(rng.choice(["en", "fr", None, "und", ""]), "".join(rng.choice(words[:3]) * rng.randint(1, 2) + rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n", ".", "!x"]) for _ in range(rng.randint(0, 60)))) for _ in range(80)]
    rows += [("en", "new york city is big. New York City"), ("en", None), ("fr", ""), ("en", " . , ")] * 6
    docs = spark.createDataFrame(rows, "lang string, text string")
    for least, top, percent in ((5, 2000, 100),) if known > 5 else ((6, 4, 60),):
        got = sorted(tuple(r) for r in collocations.collocations(docs, least, 5, top, percent).collect())
        assert got == brute_collocations(rows, least, 5, top, percent) and got


def test_collocations_of_little_and_of_products_past_64_bits(spark, odd, empty):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(odd, least=2, longest=3).count() > 0
    assert collocations.collocations(spark.createDataFrame([("en", "a b " * 300_000)], "lang string, text string")).where("score = 2000 AND a = 300000").count() == 1
    row = spark.range(1).selectExpr("((1000 * cast(4000000000000 as decimal(19,0))) * cast(9000000000000000 as decimal(19,0))) div (cast(5000000000000 as decimal(19,0)) * cast(7000000000000 as decimal(19,0))) AS score").first()
    assert row.score == 1000 * 4000000000000 * 9000000000000000 // (5000000000000 * 7000000000000)


def test_another_seed_parts_words_that_share_a_number(spark, monkeypatch):
    real = collocations.xxhash.xxh3_64_intdigest
    docs = spark.createDataFrame([("en", "a b c " * 40)], "lang string, text string")
    seeds = []
    number = collocations.number_words

    def watched(frame, seed):
        seeds.append(seed)
        rows = number(frame, seed)
        return rows if seed else rows.withColumn("gram", collocations.F.when(collocations.F.col("gram").isNotNull(), collocations.F.lit(5)))

    monkeypatch.setattr(collocations, "number_words", watched)
    assert real(b"a", 0) != real(b"a", 1)
    got = [tuple(r) for r in collocations.collocations(docs, least=10, longest=2).collect()]
    assert seeds == [0, 1] and sorted(got) == brute_collocations([("en", "a b c " * 40)], 10, 2, 2000, 100)


def test_counts_of_many_shards_are_summed(spark):
    """Phrases of several shards, in texts of several tasks; one of them is too frequent for narrow counts."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 200, 60_000).astype(np.uint64) for _ in range(4)]
    texts[0][:1000] = 7
    want = Counter()
    for t in texts:
        want.update(zip(t[:-1].tolist(), t[1:].tolist()))
    key = lambda p: np.array(p, dtype=">u8").tobytes()
    frame = spark.createDataFrame([(t.tobytes(),) for t in texts], "ids binary").repartition(4)
    wanted = spark.createDataFrame([(key(p),) for p in want] + [(key((1, 999)),)], "key binary")
    assert len(want) > 5 * collocations.SHARD and max(want.values()) > 255
    found = collocations.count_phrases(frame, wanted, 2).collect()
    assert {bytes(r.key): r.f for r in found} == {key(p): n for p, n in want.items()} and len(found) == len(want)
    grams = collocations._grams_of(np.array([np.frombuffer(r.key, ">u8") for r in found]).astype(np.uint64)).view(np.int64)
    assert [r.gram for r in found] == grams.tolist()


def test_trie_counts_every_place():
    rng = np.random.default_rng(4)
    for k, v, n in ((1, 5, 3), (2, 30, 200), (4, 6, 300), (5, 2000, 500)):
        phrases = np.unique(rng.integers(1, v + 1, (n, k)), axis=0).astype(np.uint64)
        ids = np.concatenate([rng.integers(0, v + 3, 2000)] + [p for p in phrases[::2]]).astype(np.uint64)
        trie = collocations.Trie(phrases[rng.permutation(len(phrases))])
        total = np.zeros(len(phrases), dtype=np.int64)
        trie.count(ids, total)
        want = Counter(tuple(ids[i : i + k].tolist()) for i in range(len(ids) - k + 1))
        assert {tuple(p): c for p, c in zip(trie.phrases.tolist(), total.tolist())} == {tuple(p): want[tuple(p)] for p in phrases.tolist()}


def test_a_frequent_word_is_spelled_once(spark, monkeypatch):
    """However many tasks count a word, one row of them spells it."""
    spelled = []
    real = collocations.map_arrow

    def watched(df, function, schema):
        out = real(df, function, schema)
        if schema == "gram long, lang binary, word binary":
            spelled.append(out.count())
        return out

    monkeypatch.setattr(collocations, "map_arrow", watched)
    texts = [("en", " ".join(f"w{i}" for i in range(50)))] * 40
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(8)
    got = [tuple(r) for r in collocations.collocations(docs, least=10, longest=2).collect()]
    assert sorted(got) == brute_collocations(texts, 10, 2, 2000, 100) and spelled == [50]


def test_a_task_names_a_candidate_once(spark, monkeypatch):
    numbers = np.tile(np.random.default_rng(6).integers(1, 1 << 62, 1000).astype(np.uint64), 3 * collocations.KNOWN // 1000 + 1)
    rows = [(numbers[at : at + 60_001].tobytes(),) for at in range(0, len(numbers), 60_000)]
    texts = spark.createDataFrame(rows, "ids binary").coalesce(1)
    named = []
    monkeypatch.setattr(collocations, "map_arrow", lambda *args: named.append(map_arrow(*args)) or named[-1])
    everything = [spark.sparkContext.broadcast(np.full(bits // 8, 255, np.uint8)) for bits in (SET_BITS, collocations.CELLS)]
    assert collocations.candidates(texts, 2, *everything).count() == 1000
    assert named[0].count() == 1000


def test_one_task_names_a_frequent_phrase(spark, monkeypatch):
    """However many tasks have a phrase, the names of candidates grow with the phrases."""
    named = []
    real = collocations.map_arrow

    def watched(df, function, schema):
        out = real(df, function, schema)
        if schema.startswith("key binary") and "gram" not in schema:
            named.append(out.where("key IS NOT NULL").count())
        return out

    monkeypatch.setattr(collocations, "map_arrow", watched)
    texts = [("en", " ".join(f"w{i}" for i in range(51)))] * 40
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(8)
    monkeypatch.setattr(collocations, "stored", lambda df, name: stored(df.repartition(8), name))  # text of each task in a file of its own
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # and each file in a task of its own
    try:
        got = [tuple(r) for r in collocations.collocations(docs, least=10, longest=2).collect()]
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert sorted(got) == brute_collocations(texts, 10, 2, 2000, 100) and named == [50]


@pytest.mark.parametrize("wrong", ["nobody", "first"])
def test_phrases_that_no_teller_has_are_found(spark, monkeypatch, wrong):
    """Tellers only save work: phrases of their counters that they don't have are named by the others."""
    real = collocations.enough

    def enough(*args):
        cells, tellers = real(*args)
        return cells, np.full_like(tellers, 0 if wrong == "first" else 1 << 20)

    monkeypatch.setattr(collocations, "enough", enough)
    rng = random.Random(9)
    rows = [("en", " ".join(rng.choice(["a", "b", "c", f"x{i % 4}"]) for _ in range(60))) for i in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    assert sorted(tuple(r) for r in collocations.collocations(docs, 8).collect()) == brute_collocations(rows, 8, 5, 2000, 100)


def test_a_counter_that_two_phrases_share_hides_neither(spark):
    """Two phrases of one counter, each in a task of its own: the teller has one of them only."""
    rng = np.random.default_rng(10)
    pairs = rng.integers(1, 1 << 62, (1 << 14, 2)).astype(np.uint64)
    cells = collocations._cells(collocations._grams_of(pairs))
    order = np.argsort(cells, kind="stable")
    same = np.flatnonzero(np.diff(cells[order]) == 0)[0]
    one, two = pairs[order[same]], pairs[order[same + 1]]
    rows = [(np.concatenate([np.append(p, np.uint64(0))] * n).tobytes(),) for p, n in ((one, 30), (two, 20))]
    texts = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "ids binary")
    parts = spark.sparkContext.broadcast(np.full(SET_BITS // 8, 255, np.uint8))
    found = collocations.count_possible(texts, 2, parts, 20).collect()
    assert {bytes(r.key): r.f for r in found} == {one.astype(">u8").tobytes(): 30, two.astype(">u8").tobytes(): 20}


def test_symbols_are_places_in_the_alphabet(spark):
    rng = np.random.default_rng(8)
    trie = collocations.Trie(np.unique(rng.integers(1, 1 << 63, (3000, 2)).astype(np.uint64) | np.uint64(1), axis=0))
    ids = np.concatenate((trie.alphabet, rng.integers(0, 1 << 63, 3000).astype(np.uint64), np.array([0, 1, 2**64 - 1], np.uint64)))
    place = {int(x): i + 1 for i, x in enumerate(trie.alphabet)}
    assert trie.symbols(ids).tolist() == [place.get(int(x), 0) for x in ids]
