"""Operators on texts against brute force, and their defined results for odd rows."""

import hashlib
import math
import os
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import functions as F

from nearfield.llm import decontamination, licenses, line_dedup, ngram_join, pii
from nearfield.llm.common import ascii_words, map_arrow
from nearfield.llm.components import components
from nearfield.llm.line_dedup import near


def texts(seed, n, words, vocabulary, changes=3):
    """Random texts, half of them edited copies of others."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out).split(" ")
            for _ in range(rng.randrange(changes)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(vocabulary)}"
            if rng.random() < 0.3 and len(w) > 1:
                del w[rng.randrange(len(w))]
        else:
            w = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(1, words))]
        out.append(" ".join(w))
    return out


def near_brute(rows, n=4, percent=85):
    sets = {}
    for i, t in rows:
        w = ascii_words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    group[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("tile", [2048, 3])
def test_ngram_join(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rows = list(enumerate(texts(1, 90, 60, 40)))
    rows += [(1000 + i, "same words in a copied text " * 4 + "end") for i in range(40)] + [(2000, None), (2001, "  "), (2002, "Two words")]
    got = ngram_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == near_brute(rows)


def test_ngram_join_odd_rows(odd, empty):
    got = sorted(ngram_join.near_groups(odd).collect(), key=str)
    assert len(got) == odd.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[5].component_id == by_id[1].component_id == 1 and by_id[2][1:] == (0, 2) and by_id[None].component_id is None
    assert ngram_join.near_groups(empty).count() == 0
    kept = ngram_join.drop_near_copies(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "None"]


def test_pipeline_drops_near_copies_of_five_words(spark):
    import corpus_pipeline

    words = [f"v{i}" for i in range(104)]
    changed = [*words[:50], *(f"x{i}" for i in range(6)), *words[56:]]  # 90 of 110 shingles of five words: 0.82
    assert 0.80 <= 90 / 110 < 0.85
    rows = [*enumerate(texts(4, 60, 60, 40)), (900, " ".join(words)), (901, " ".join(changed)), (902, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {i for i, (_, c) in near_brute(rows, 5, 80).items() if i == c} and 900 in kept and 901 not in kept


def test_rows_with_one_id_link_their_classes(spark):
    a, b, c = "a b c d e f g h", "i j k l m n o p", "q r s t u v w x"
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (10, c)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.near_groups(docs).collect()) == [(3, 3), (5, 3), (5, 3), (9, 3), (10, 10)]


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "a long, b long")
    assert {r.node: r.component for r in components(links).collect()} == {i: 0 for i in range(41)} | {99: 99, 100: 99}


def lines_brute(rows, least=line_dedup.MIN_WORDS):
    seen, out = [], {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        for at, line in enumerate((text or "").split("\n")):
            w = ascii_words(line)
            if w:
                out[doc, at] = any(w == x or (len(w) >= least and len(x) >= least and near(w, x)) for x in seen)
                seen.append(w)
    return out


def test_line_dedup(spark):
    rng = random.Random(3)
    every = texts(2, 200, 14, 12, changes=2)
    rows = [(i, "\n".join(rng.choices(every, k=rng.randrange(5)))) for i in range(60)]
    got = line_dedup.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.pos): r.dropped for r in got.collect()} == lines_brute(rows)


def test_edit_distance():
    a = b"a b c d".split()
    assert near(a, a) and near(a, b"a b x d".split()) and near(a, b"a b d".split()) and near(a, b"a b c d e".split())
    assert not near(a, b"b a c d".split()) and not near(a, b"a b".split())


def test_line_dedup_odd_rows(odd, empty):
    got = {r.doc_id: r for r in line_dedup.line_report(odd).collect()}
    assert got[2][1:] == (0, 0, "") and got[6][1:] == (0, 0, "") and got[1].n_dropped == 0 and got[None].n_dropped == 0
    assert got[5].n_lines == 2 and got[5].dropped == "0,0"  # both rows of document 5 are later than document 1
    assert line_dedup.line_report(empty).count() == 0
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(odd).collect()}
    assert kept[1] and kept[5] == "" and kept[2] is None and kept[4].startswith("One\n\nTwo")


def hits_brute(words, items, window):
    hit, found = set(), set()
    for name, w in items:
        n = min(len(w), window)
        for k in range(len(w) - n + 1) if w else ():
            for p in range(len(words) - n + 1):
                if words[p : p + n] == w[k : k + n]:
                    hit |= set(range(p, p + n))
                    found.add(name)
    return len(hit), sorted(found)


@pytest.mark.parametrize("part_words", [250_000, 20])
def test_decontamination(spark, part_words):
    rng = random.Random(5)
    word = lambda n: [rng.choice("abc") for _ in range(n)]
    items = [(f"i{k}", " ".join(word(rng.choice([1, 3, 4, 5, 9, 14])) if k else ["x"])) for k in range(14)]
    docs = [(i, " ".join(word(rng.randrange(40)) + ["x"] * (i % 3 == 0))) for i in range(60)] + [(99, None)]
    found = decontamination.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), window=5, part_words=part_words)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.digest(found).collect()}
    pairs = [(n, t.split()) for n, t in items]
    for i, t in docs:
        w = (t or "").split()
        n, names = hits_brute(w, pairs, 5)
        assert got[i] == (len(w), n, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n > 0)


def test_contaminated_spans_are_cut(spark, odd, empty):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([("q", item), ("q", item), (None, "alpha beta"), ("e", None), ("f", "")], "item_id string, text string")
    tail = " and then a lot of other words that nobody has seen anywhere else before"
    docs = spark.createDataFrame([(1, "Start: " + item.upper() + "!" + tail, 1), (2, item, 2), (3, "clean", 3), (4, None, 4)], "doc_id long, text string, words int")
    got = {r.doc_id: r for r in decontamination.remove_contaminated(docs, bench).collect()}
    assert got[1].text == "Start: !" + tail and set(got) == {1, 3, 4} and got[3] == (3, "clean", 3)
    assert decontamination.remove_contaminated(odd, bench).count() == odd.count()
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.digest(decontamination.contamination(odd, bench.limit(0))).where("contaminated").count() == 0


def test_benchmark_parts_are_built_in_tasks(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda n: [rng.choice("abc") for _ in range(n)]
    items = [(f"i{k}", " ".join(word(rng.choice([3, 5, 9, 14, 60])))) for k in range(14)]
    docs = [(i % 50, " ".join([*word(rng.randrange(40)), *["z"] * rng.randrange(90)]), 7) for i in range(60)] + [(99, None, 7), (None, items[3][1] + " z" * 30, 7), (98, "", 7)]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string, d int"), spark.createDataFrame(items, "item_id string, text string")

    def refuse(self, last, c):
        raise AssertionError("built on the driver")

    monkeypatch.setattr(decontamination.Automaton, "_extend", refuse)
    parts = decontamination.benchmark_parts(bench, 5, 20)
    assert parts.where("no = 0").count() > 5
    whole, cut = (decontamination.remove_contaminated(docs, bench, window=5, part_words=n) for n in (250_000, 20))
    assert cut.columns == docs.columns and sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
    one, many = (decontamination.contamination(docs, bench, window=5, part_words=n).collect() for n in (250_000, 20))
    assert sorted(map(str, one)) == sorted(map(str, many)) and any(r.spans for r in one)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        turned = [int(c) for c in reversed(digits)]
        return 12 <= len(digits) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(turned)) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    found = sorted((m.start(), i, kind, m.end()) for i, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if holds(kind, m.group()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)


def test_pii_base_spans(spark):
    rng = random.Random(9)
    bits = ["a@b.co", "x.y+z@m-1.example.org.", "@", "a@b", "_q@r.s_t@u.v", "1.2.3.4", "256.1.1.1", "001.02.3.255.7.8.9.1", "4111 1111-1111 1111", "4111111111111112",
            "+1 (234) 555-6789", "+12", "+", "é\U0001f600", " ", "..", "-", "7", "12345678901234567890", "word"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randrange(12)))) for i in range(400)] + [(900, None), (901, "9" * 5000), (902, "a" * 20000 + "@")]
    got = {r.doc_id: r for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        said = base_spans(t)
        assert ",".join(s for s in got[i].spans.split(",") if not s.startswith("like_")) == said, t
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[i].n_email, got[i].n_card) == (said.count("email:"), said.count("card:"))


def test_pii_context_finds_unseen_identifiers(spark, odd, empty):
    rows = [(i, f"word{i} some text card number 4{i:03d}00000000") for i in range(0)]
    numbers = [n for n in range(400000000000, 400000002000) if holds("card", str(n))][:40]
    rows = [(i, f"lorem my card number {n} ipsum") for i, n in enumerate(numbers)]
    rows += [(500, "dolor my card number AB12345678 sit"), (501, "an order AB99345678 of things")]
    got = {r.doc_id: r.spans for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[500] == "like_card:21:31" and got[501] == "" and got[0] == "card:21:33"
    assert pii.pii_report(odd).where("spans = ''").count() == odd.count() and pii.pii_report(empty).count() == 0


def test_pii_discovered_identifiers_induce_patterns(spark):
    numbers = [n for n in range(400000000000, 400000002000) if holds("card", str(n))][:43]
    rows = [(i, f"lorem my card number {n} ipsum") for i, n in enumerate(numbers[:40])]
    rows += [(100 + i, f"dolor my card number AB{i}2345678 sit") for i in range(10)]
    rows += [(200 + i, f"dolor with account ref AB{i}2345678 sit") for i in range(10)]  # a context with 3 base seeds
    rows += [(300 + i, f"dolor with account ref {n} sit") for i, n in enumerate(numbers[40:])]
    rows += [(400, "amet with account ref XY99/88.77_66 sit")]
    got = {r.doc_id: r.spans for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "like_card:21:31" and got[200] == "like_card:23:33" and got[400] == "like_card:22:35"


def test_pii_candidates_are_whole_tokens(spark):
    long = "abcdefgh_" + "1a.b/c-" * 40 + "9"
    values = [long, "a.1", "7", "user_name.x/2"]
    text = " ".join(f"no digits: a.b-c ({v}), \u00e9\U0001f600" for v in values) + " " + "a." * 50_000
    df = pii._placed(pii.found_matches(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    got = {(r.value, r.start, r.end, r.left[-5:]) for r in df.where("kind = ''").collect()}
    assert got == {(v, text.index(f"({v})") + 1, text.index(f"({v})") + 1 + len(v), "b-c (") for v in values}


def test_licenses(spark, odd, empty):
    clean = [(100 + i, f"the river number {i} runs past hill and house under an open sky\nwe work in version {i} of the town") for i in range(60)]
    rows = clean + [(1, "some text\nLicensed under the Apache License, Version 2.0."), (2, "Released under the MIT License."), (3, None),
                    (4, "word " * 100 + "This work is licensed under the GNU General Public License, version 3. " + "word " * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = licenses.train(docs)
    got = {r.doc_id: (r.n_licenses, r.licenses, r.lines) for r in licenses.license_report(docs, model).collect()}
    assert got[1] == (1, "apache-2.0", "1:apache-2.0") and got[2] == (1, "mit", "0:mit") and got[4] == (1, "gpl-3.0", "0:gpl-3.0")
    assert {got[i] for i, _ in clean} | {got[3]} == {(0, "", "")}
    assert licenses.license_report(odd, model).where("n_licenses = 0").count() == odd.count()
    assert licenses.license_report(empty).count() == 0


def test_wrapped_notices_and_two_licenses_in_a_line(spark):
    gpl = """some code
//
// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU{0} General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.
//
"""
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction."""
    bsd = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are
# met:"""
    clean = [(100 + i, f"the river number {i} runs past hill and house under an open sky\nwe work in version {i} of the town") for i in range(60)]
    rows = clean + [(1, gpl.format("")), (2, mit), (3, bsd), (4, "Licensed under the MIT License or the Apache License, Version 2.0."), (5, gpl.format(" Lesser")),
                    (6, "Released under the MIT License.\n\nLicensed under the\nBSD License.")]
    got = {r.doc_id: (r.n_licenses, r.licenses, r.lines) for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i][1] for i in range(1, 7)] == ["gpl-3.0", "mit", "bsd", "apache-2.0,mit", "lgpl", "bsd,mit"]
    assert got[2] == (1, "mit", "0:mit") and got[4] == (1, "apache-2.0,mit", "0:apache-2.0,0:mit") and got[6] == (2, "bsd,mit", "0:mit,3:bsd")
    assert {got[i] for i, _ in clean} == {(0, "", "")}


def test_license_thresholds_cover_all_unknown_pieces(spark):
    rows = [(i, f"the river number {i} runs past hill and house under an open sky") for i in range(300)]
    odd_ones = ["mozilla affero lesser mit apache bsd", "gnu mozilla lesser gpl agplv gplv mpl", "affero gnu mozilla lesser license released distributed licensed apache mit bsd permission redistribution creative waived"]
    docs = spark.createDataFrame(rows + [(900 + i, t) for i, t in enumerate(odd_ones)], "doc_id long, text string")
    model = licenses.train(docs, train_docs=5)
    scored = model.scored(licenses.plain_pieces(docs)).toPandas()["probabilities"]
    most = np.max(np.stack(scored), axis=0)
    # So few pieces that the share above which a piece counts is the greatest one.
    assert max(most[:-1]) > licenses.LEAST
    assert model.thresholds == {f: pytest.approx(max(licenses.LEAST, m)) for f, m in zip(model.classes[:-1], most)}


def test_license_pieces_cost_their_own_terms(spark):
    clean = [(i, f"the river number {i} runs past hill and house under an open sky\nwe work in version {i} of the town") for i in range(60)]
    model = licenses.train(spark.createDataFrame(clean, "doc_id long, text string"))
    assert isinstance(model.model.stages[-1].coefficientMatrix, DenseMatrix)  # a sparse one is gone through whole for each piece


def test_unlikely_license_pieces_are_not_scored(spark):
    rng = np.random.default_rng(4)
    plain = "river hill house garden winter morning the of in and ship cloud stone water".split()
    near = plain + "software version public license terms general".split()
    rows = [(i, " ".join(rng.choice(plain if i % 4 else near, 8))) for i in range(1500)] + [(9000, "gnu mozilla lesser gpl agplv gplv mpl"), (9001, "affero gnu mozilla lesser license released distributed licensed")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = licenses.train(docs, train_docs=1000)
    pieces = licenses.plain_pieces(docs).withColumn("unlikely", model.unlikely())
    got = [(r.unlikely, max(r.probabilities[:-1])) for r in model.scored(pieces).collect()]
    assert all(p <= licenses.LEAST for unlikely, p in got if unlikely)
    assert sum(unlikely for unlikely, _ in got) > len(got) / 4 and max(p for _, p in got) > licenses.LEAST


def test_license_pieces_are_of_the_paragraphs_that_are_scanned(spark):
    texts = ["One two\nthree @4 don't\n--\nfive 6.0 s\u00e9ven\n \n\n# eight", "\n\nMIT\nLicense\n\nnine", "a\n\n\nb", "", None, "@1 x\n@2 y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    free = licenses.paragraphs(docs).selectExpr("doc_id", "regexp_replace(paragraph, '@[0-9]++ ', ' ') AS x").where(~F.col("x").rlike(licenses._cue_pattern(licenses.OVERLAP)))
    want = sorted((r.doc_id, tuple(r.w)) for r in free.select("doc_id", licenses._words(F.col("x")).alias("w")).collect())
    assert sorted((r.doc_id, tuple(r.words)) for r in licenses.plain_pieces(docs).collect()) == want and len(want) == 7


def test_license_calibration_is_exact(spark):
    rng = np.random.default_rng(3)
    values = np.column_stack((rng.random(30_000), np.round(rng.random(30_000), 3), rng.random(30_000) * licenses.LEAST))
    scored = spark.createDataFrame([(v.tolist(),) for v in values], "probabilities array<double>").repartition(5)
    rank = math.ceil(licenses.CALIBRATED * len(values)) - 1
    want = [max(licenses.LEAST, v) for v in np.sort(values, axis=0)[rank]]
    got = licenses._calibrated(scored, ["a", "b", "c"])
    assert [got[f] for f in "abc"] == want and want[2] == licenses.LEAST
    assert licenses._calibrated(scored.limit(0), ["a"]) == {"a": licenses.LEAST}


def near_templates(text, overlap=licenses.OVERLAP):
    """Families of which some run of words of ``text``, as long as a region, has the share of a template's pairs."""
    words = licenses._plain_words(text)
    reach, found = 2 * max(len(licenses._plain_words(t)) for ts in licenses._templates().values() for t in ts) + 2, set()
    for f, ts in licenses._templates().items():
        for pairs in (set(licenses._plain_pairs(t)) for t in ts):
            for i in range(max(1, len(words) - reach + 1)):
                part = words[i : i + reach]
                if len(pairs & {f"{a} {b}" for a, b in zip(part, part[1:])}) >= overlap * len(pairs):
                    found.add(f)
    return found


def test_license_cues_are_in_all_that_templates_confirm(spark):
    rng = random.Random(3)
    rows, filler = [], "the river of this work runs under an open license version 2 in the public house".split()
    for f, ts in licenses._templates().items():
        for t in ts:
            for _ in range(4):
                words = t.split()
                for _ in range(rng.randrange(3)):
                    words[rng.randrange(len(words))] = rng.choice(filler)
                before, after = ([rng.choice(filler) for _ in range(rng.randrange(300))] for _ in "ab")
                rows.append((len(rows), " ".join([*before, *words, *after])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cued = {r.doc_id for r in licenses.places(docs).select("doc_id").distinct().collect()}
    assert {i for i, t in rows if near_templates(t)} <= cued
    got = {}
    for r in licenses.license_pieces(docs).select("doc_id", "family").distinct().collect():
        got.setdefault(r.doc_id, set()).add(r.family)
    assert all(families <= near_templates(dict(rows)[i]) for i, families in got.items())


def test_license_tags_and_more_families(spark):
    clean = [(100 + i, f"the river number {i} runs past hill and house under an open sky\nwe work in version {i} of the town") for i in range(60)]
    want = {1: ("# SPDX-License-Identifier: MIT", "mit"), 2: ("// SPDX-License-Identifier: GPL-2.0-only", "gpl-2.0"), 3: ("Released under the Eclipse Public License, version 2.0.", "epl-2.0"),
            4: ("Licensed under the ISC License.", "isc"), 5: ("This is free and unencumbered software released into the public domain.", "unlicense"),
            6: ("x " * 600_000 + "\nReleased under the MIT License. " + "y " * 600_000, "mit"), 7: ("Distributed under the GNU Affero General Public License, version 3", "agpl-3.0")}
    docs = spark.createDataFrame(clean + [(i, t) for i, (t, _) in want.items()], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.license_report(docs).collect()}
    assert {i: got[i] for i in want} == {i: f for i, (_, f) in want.items()} and not any(got[i] for i, _ in clean)


def test_no_python_in_native_plans(odd):
    for df in (pii.pii_report(odd), licenses.license_report(odd, licenses.train(odd))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_hashed_set(spark):
    from nearfield.llm.common import bit_of, has_bits, hashed_set

    keys = spark.range(0, 1000, 7).select(F.col("id").alias("doc_id"))
    bits = hashed_set(keys)
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), bit_of("id").alias("bit")).toPandas()
    assert has_bits(bits, rows["bit"].to_numpy())[::7].all()


def test_places_of_lines_agree_in_both_forms(spark):
    from nearfield.llm.line_dedup import _line_bit, _line_bit_column

    rows = [(d, p) for d in (0, 1, 77, 2**40 + 5, -3) for p in (0, 1, 1000, 2**30)]
    got = spark.createDataFrame(rows, "doc_id long, pos int").select("doc_id", "pos", _line_bit_column().alias("bit")).collect()
    want = _line_bit(np.array([r.doc_id for r in got]), np.array([r.pos for r in got]))
    assert [r.bit for r in got] == want.tolist()


def test_workers_give_back_what_a_task_freed(spark):
    def run(batches):
        for batch in batches:
            held = [np.ones(12_500) for _ in range(3_000)]  # 300 MB in pieces that the heap serves
            sys.nearfield_test = held[-1]  # what stays at its end keeps all of the heap below
            yield pa.RecordBatch.from_pydict({"pid": pa.array([os.getpid()] * batch.num_rows)})

    [(pid,)] = map_arrow(spark.range(1).coalesce(1), run, "pid long").collect()
    with open(f"/proc/{pid}/status") as status:
        assert int(re.search(r"RssAnon:\s+(\d+)", status.read()).group(1)) < 250_000  # KB
