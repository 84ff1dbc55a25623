"""License scan: a trained paragraph classifier. DataFrame and Spark ML functions only, no Python on the executors.

A multinomial logistic regression over words and word pairs tells licence families and an unknown class apart. It
learns from places in notices made of each family's names and phrases, alone and within text, and from pieces of the corpus
itself as unknown. Each family has a threshold, calibrated on all pieces of the corpus that can't be part of a notice.
Texts fall into paragraphs, whose lines are joined. The regression names the families of every place where a notice can be:
a family's templates confirm it when the words about the place have most of a template's word pairs, unless a related
family's template has all of these and more.

Where a notice can be is exact: who has the least share of a template's pairs has one of its rarest ones (cues), of
which there are one more than may be missing.

Nulls: a null or empty text has no pieces and no licences. Rows with one doc_id, null included, are one document, and each
of them gets its licences. Empty tables give no rows. Extra columns are not looked at. Long texts are scanned whole, in
chunks that overlap by the longest template. Of equal lines of a notice the first counts; equal template matches of
two families are both reported.
"""

import math
import re
from functools import reduce
from itertools import groupby, product

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm.common import stored

#: Names of licences and phrases of their notices.
NAMES = {
    "agpl-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0", "GNU AGPLv3"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 License", "Apache-2.0"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["CC0 1.0", "CC0 1.0 Universal Public Domain Dedication"],
    "epl-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License v2.0", "EPL-2.0"],
    "gpl-2.0": ["GNU General Public License, version 2", "GPL-2.0", "GNU GPLv2"],
    "gpl-3.0": ["GNU General Public License, version 3", "GPL-3.0", "GNU GPLv3"],
    "isc": ["ISC License"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "mit": ["MIT License", "MIT license terms"],
    "mpl-2.0": ["Mozilla Public License, version 2.0", "MPL-2.0"],
    "unlicense": ["The Unlicense license", "the terms of the Unlicense"],
}
#: SPDX identifiers.
TAGS = {
    "agpl-3.0": ["AGPL-3.0"], "apache-2.0": ["Apache-2.0"], "bsd": ["BSD-2-Clause", "BSD-3-Clause"], "cc-by": ["CC-BY-4.0"],
    "cc-by-nc": ["CC-BY-NC-4.0"], "cc-by-sa": ["CC-BY-SA-4.0"], "cc0": ["CC0-1.0"], "epl-2.0": ["EPL-2.0"], "gpl-2.0": ["GPL-2.0"],
    "gpl-3.0": ["GPL-3.0"], "isc": ["ISC"], "lgpl": ["LGPL-2.1", "LGPL-3.0"], "mit": ["MIT"], "mpl-2.0": ["MPL-2.0"], "unlicense": ["Unlicense"],
}
PHRASES = {
    "apache-2.0": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org licenses LICENSE-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "gpl-3.0": ["either version 3 of the License, or (at your option) any later version"],
    "gpl-2.0": ["either version 2 of the License, or (at your option) any later version"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}
#: Licences whose notices have phrases of others.
KIN = {"agpl-3.0": ["gpl-3.0"], "lgpl": ["gpl-2.0", "gpl-3.0"]}
OPENINGS = ("Licensed under the", "Licensed under", "Released under the", "This work is licensed under the", "Distributed under the", "Available under", "License:")
UNKNOWN = "unknown"
#: Words on either side of a place; documents sampled as unknown text (about so many); pieces of them for learning; the least share of a template's word pairs.
NEAR, TRAIN_DOCS, TRAIN_PIECES, OVERLAP = 3, 400, 1_000, 0.75
#: Words of a piece (a pair and what is near it) and of a chunk.
PIECE, CHUNK = 2 * NEAR + 2, 256
#: A family needs this probability at least, and more than this share of the pieces that can't be of a notice.
LEAST, CALIBRATED = 0.2, 0.9999
#: Steps of how much a term can add to a family's lead over the unknown class.
LEADS = (0.02, 0.2, 0.5, 1.0, 1.7, 2.5, 3.5)
_TOKEN = r"[a-z]++(?:'[a-z]++)?|[0-9]++(?:\.[0-9]++)*+"
_FOREIGN = r"[^\x00-\x7F]"
#: Words that other texts have, too: their pairs come last as cues.
_COMMON = frozenset("a an and any are at by for general in is it later license may not of on or provided public software terms that the this to under use version with without you your".split())


def _words(text):
    """Column: lower-cased words and numbers of a text; letters beyond ASCII are marks within words."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), _FOREIGN, "x"), F.lit(_TOKEN), F.lit(0))


def _plain_words(text: str) -> list[str]:
    return re.findall(r"[a-z]+(?:'[a-z]+)?|[0-9]+(?:\.[0-9]+)*", text.lower())


def _plain_pairs(text: str) -> list[str]:
    words = _plain_words(text)
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def _templates() -> dict[str, list[str]]:
    return {f: [*NAMES[f], *PHRASES.get(f, []), *(f"SPDX-License-Identifier: {t}" for t in TAGS[f])] for f in NAMES}


def cues(overlap: float = OVERLAP) -> set[str]:
    """Word pairs without which no text has ``overlap`` of any template's pairs."""
    out = set()
    for text in (t for texts in _templates().values() for t in texts):
        pairs = sorted(set(_plain_pairs(text)), key=lambda p: (sum(w in _COMMON or w[0].isdigit() for w in p.split()), -len(p), p))
        out.update(pairs[: len(pairs) - math.ceil(overlap * len(pairs)) + 1])
    return out


def _cue_pattern(overlap: float) -> str:
    """A regular expression that finds each text with a cue, and perhaps others. It looks at beginnings of words only."""
    marks = sorted(p.replace(".", r"\.").replace(" ", "[^a-z0-9]*+") for p in cues(overlap))
    by_first = [(c, [p[1:] for p in g]) for c, g in groupby(marks, key=lambda p: p[0])]
    return "|".join(("(?<![a-z])(?:" if letters else "(?:") + "|".join(f"{c}(?:{'|'.join(g)})" for c, g in by_first if c.isalpha() == letters) + ")"
                    for letters in (True, False) if any(c.isalpha() == letters for c, _ in by_first))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph: lines up to one without words (which can have marks as comments do), each after @ and its number."""
    text = F.replace(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), _FOREIGN, "x"), F.lit("@"), F.lit(" "))
    marked = F.transform(F.split(text, "\n", -1), lambda x, i: F.when(x.rlike("[a-z0-9]"), F.concat(F.lit("@"), i.cast("string"), F.lit(" "), x)).otherwise(F.lit("")))
    return docs.select("doc_id", F.explode(F.split(F.array_join(marked, "\n"), "\n\n++", -1)).alias("paragraph")).where(F.instr("paragraph", "@") > 0)


def _plain(text: str = "text"):
    """Column: a text in the letters and digits that ``paragraphs`` sees."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _FOREIGN, "x")


def plain_pieces(docs: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, words: all paragraphs without cues in pieces of PIECE words."""
    # The paragraphs of ``paragraphs`` without marks: here no line needs its number.
    parts = docs.select("doc_id", F.explode(F.split(_plain(), r"\n(?:[^a-z0-9\n]*+\n)++", -1)).alias("x"))
    free = parts.where(~F.col("x").rlike(_cue_pattern(overlap)))
    piece = F.regexp_extract_all("x", F.lit(f"(?:(?:{_TOKEN})[^a-z0-9]*+){{1,{PIECE}}}+"), F.lit(0))
    return free.select("doc_id", F.explode(piece).alias("x")).select("doc_id", F.regexp_extract_all("x", F.lit(_TOKEN), F.lit(0)).alias("words"))


def places(docs: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, words, region: for each cue of a text the words near it, and all words (w, with their line n) that a notice
    there can have."""
    reach = max(len(_plain_words(t)) for texts in _templates().values() for t in texts)
    # Lines are marked in the few texts that have a cue; paragraphs without one drop out with their words below.
    cued = paragraphs(docs.where(_plain().rlike(_cue_pattern(overlap))))
    # The number is taken once for a line, not for each of its words.
    numbered = F.transform(F.split("paragraph", "\n"), lambda x: F.struct(
        F.regexp_extract(x, "^@([0-9]++)", 1).cast("int").alias("n"), F.regexp_extract_all(F.regexp_replace(x, "^@[0-9]++ ", ""), F.lit(_TOKEN), F.lit(0)).alias("ws")))
    words = cued.select("doc_id", F.flatten(F.transform(numbered, lambda x: F.transform(x["ws"], lambda w: F.struct(w.alias("w"), x["n"].alias("n"))))).alias("a"))
    # The slices come after the explosion, in generated code that reads only their words of a long paragraph.
    chunks = words.select("doc_id", "a", F.explode(F.sequence(F.lit(0), F.floor((F.size("a") - 1) / CHUNK).cast("int"))).alias("c"))
    start = F.greatest(F.lit(0), F.col("c") * CHUNK - reach)
    chunks = chunks.select("doc_id", (F.col("c") * CHUNK - start).alias("skip"), F.slice("a", start + 1, F.col("c") * CHUNK - start + CHUNK + reach).alias("a")).withColumn("w", F.col("a.w"))
    found = F.filter(F.transform(_pairs(F.col("w")), lambda p, i: F.when(p.isin(sorted(cues(overlap))), i)), lambda i: i.isNotNull() & (i >= F.col("skip")) & (i < F.col("skip") + CHUNK))
    at = chunks.withColumn("i", F.explode(found))
    around = lambda column, k: F.slice(column, F.greatest(F.lit(1), F.col("i") + 1 - k), F.least(F.col("i"), F.lit(k)) + k + 2)
    return at.select("doc_id", around("w", NEAR).alias("words"), around("a", reach).alias("region"))


def _pairs(words):
    """Column: neighbouring words."""
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(
        F.array().cast("array<string>"))


def training_rows(spark: SparkSession, unknown: list[list[str]]) -> DataFrame:
    """words, family: the words near each cue of a notice, alone and between unknown texts, and the unknown pieces."""
    notices = [(f"{o} {n}.", f) for f, names in NAMES.items() for o, n in product(OPENINGS, names)]
    notices += [(p, f) for f, texts in PHRASES.items() for p in texts for _ in OPENINGS]
    notices += [(f"SPDX-License-Identifier: {t}", f) for f, tags in TAGS.items() for t in tags for _ in OPENINGS]
    marks, rows = cues(), []
    for i, (text, family) in enumerate(notices):
        words = _plain_words(text)
        before, after = (unknown[(k * i + k) % len(unknown)] for k in (7, 11)) if unknown else ([], [])
        for whole, start in ((words, 0), ([*before, *words], len(before)), ([*words, *after], 0)):
            for j in range(start, start + len(words) - 1):
                if f"{whole[j]} {whole[j + 1]}" in marks:
                    rows.append((whole[max(0, j - NEAR) : j + NEAR + 2], family))
    rows += [(w, UNKNOWN) for w in unknown]
    # Words of notices that say nothing of a licence by themselves.
    rows += [(_plain_words(o), UNKNOWN) for o in (*OPENINGS, "Released under pressure in version 2.0 of the work.", "the general public and this work")] * 3
    return spark.createDataFrame(rows, "words array<string>, family string")


def _rivals() -> dict[str, set[str]]:
    """Families that a family is mistaken for: half of a template's pairs are in one of theirs, or one has phrases of the other."""
    pairs = {f: [set(_plain_pairs(t)) for t in texts] for f, texts in _templates().items()}
    near = lambda f, g: any(2 * len(a & b) >= len(a) for a in pairs[f] for b in pairs[g])
    return {f: {g for g in pairs if g == f or near(f, g) or g in KIN.get(f, ()) or f in KIN.get(g, ())} for f in pairs}


def _most(leads: dict[str, float], terms):
    """Column: the sum of the leads of ``terms``, each rounded up to one of LEADS."""
    rounded = {t: min((x for x in LEADS if x >= v), default=max(leads.values())) for t, v in leads.items()}
    if not rounded:
        return F.lit(0.0)
    steps = sorted(set(rounded.values()))
    lead = lambda t: reduce(lambda rest, x: F.when(t.isin(sorted(k for k, v in rounded.items() if v == x)), F.lit(x)).otherwise(rest), steps[:-1], F.lit(steps[-1]))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: F.when(t.isin(sorted(rounded)), s + lead(t)).otherwise(s))


class LicenseModel:
    """A fitted regression, its classes by number (the unknown one last), and the threshold of each family."""

    def __init__(self, model, classes: list[str], thresholds: dict[str, float], overlap: float = OVERLAP):
        self.model, self.classes, self.thresholds, self.overlap = model, classes, thresholds, overlap

    def scored(self, found: DataFrame) -> DataFrame:
        """``found`` (with words) with the probability of each class."""
        pairs = NGram(n=2, inputCol="words", outputCol="pairs").transform(found)
        scored = self.model.transform(pairs.withColumn("terms", F.concat("words", "pairs")))
        return scored.select(*found.columns, vector_to_array("probability").alias("probabilities"))

    def unlikely(self):
        """Column: no family can have a probability above LEAST for these words, so no score is needed.

        A family above LEAST leads the unknown class by log(LEAST / (1 - LEAST)) at least, and the terms of a piece add no more to its
        lead than the greatest leads of each. At first a word stands for itself and for all pairs of which it is the rarer word; only
        where that could be enough the pairs are looked at.
        """
        tf, regression = self.model.stages
        weights, base = regression.coefficientMatrix.toArray(), regression.interceptVector.toArray()
        need = math.log(LEAST / (1 - LEAST)) - float((base[:-1] - base[-1]).max()) - 1e-6
        terms = {t: v for t, v in zip(tf.vocabulary, (weights[:-1] - weights[-1]).max(axis=0).tolist()) if v > LEADS[0]}
        greatest: dict[tuple, float] = {}  # of a word by itself, or as the first or second word of pairs
        for term, lead in terms.items():
            parts = term.split(" ")
            rare = min(range(len(parts)), key=lambda i: (parts[i] in _COMMON, -len(parts[i])))
            key = parts[rare], rare if len(parts) > 1 else None
            greatest[key] = max(greatest.get(key, 0.0), lead)
        words = {w: sum(greatest.get((w, k), 0.0) for k in (None, 0, 1)) for w, _ in greatest}
        rest = F.lit(2 * LEADS[0]) * F.size("words")  # terms below the first step
        exact = _most({t: v for t, v in terms.items() if " " not in t}, F.col("words")) + _most({t: v for t, v in terms.items() if " " in t}, _pairs(F.col("words")))
        return F.when(_most(words, F.col("words")) + rest < need, True).otherwise(exact + rest < need)

    def identify(self, found: DataFrame) -> DataFrame:
        """``found`` once for each family that the regression finds likely enough, with family and probability."""
        families = F.array(*[F.struct(F.lit(f).alias("family"), F.get("probabilities", F.lit(i)).alias("p"), F.lit(self.thresholds[f]).alias("t")) for i, f in enumerate(self.classes[:-1])])
        likely = self.scored(found).withColumn("x", F.explode(F.filter(families, lambda x: x["p"] >= x["t"])))
        return likely.select(*found.columns, F.col("x.family").alias("family"), F.col("x.p").alias("probability"))

    def confirm(self, identified: DataFrame) -> DataFrame:
        """doc_id, line, family, probability, overlap of ``identified`` (with region) that one of the family's templates
        confirms and none of a related family that has all of its words and more (GPL in LGPL).

        The line is the one with most of the template's word pairs, the first of equal ones.
        """
        texts, rivals = _templates(), _rivals()
        rows = [(f, g, True, _plain_pairs(t)) for f in rivals for g in rivals[f] for t in texts[g]]
        rows += [(f, g, False, _plain_pairs(t)) for f in rivals for g in rivals[f] for k in KIN.get(g, ()) for t in PHRASES[k]]
        rows = [(f, g, own, sorted(set(pairs))) for f, g, own, pairs in rows]
        # Fixed rows, a few hundred.
        templates = F.broadcast(identified.sparkSession.createDataFrame(rows, "family string, rival string, own boolean, template array<string>"))
        met = identified.withColumn("place", F.monotonically_increasing_id()).withColumn("pairs", _pairs(F.col("region.w"))).join(templates, "family")
        met = met.withColumn("overlap", F.size(F.array_intersect("pairs", "template")) / F.size("template")).where(F.col("overlap") >= self.overlap)
        met = met.withColumn("has", F.filter(F.transform("pairs", lambda p, i: F.when(F.array_contains("template", p), i)), lambda i: i.isNotNull()))
        lines = F.transform("has", lambda i: F.get("region", i)["n"])
        most = F.array_max(F.transform(F.array_distinct("lines"), lambda n: F.struct(F.size(F.filter("lines", lambda m: m == n)).alias("k"), (-n).alias("n"))))
        met = met.withColumn("lines", lines).withColumn("line", -most["n"])
        rival = met.groupBy("doc_id", "place", "family", "rival").agg(
            F.max(F.when(F.col("own"), F.struct("overlap", F.size("has").alias("size"), "probability", (-F.col("line")).alias("line")))).alias("best"),
            F.array_distinct(F.flatten(F.collect_list("has"))).alias("has")).where(F.col("best").isNotNull())
        # At most one row for each related family.
        whole = rival.groupBy("doc_id", "place", "family").agg(F.collect_list(F.struct("rival", "best", "has")).alias("all"))
        mine = whole.withColumn("x", F.get(F.filter("all", lambda x: x["rival"] == F.col("family")), F.lit(0))).where(F.col("x").isNotNull())
        beaten = F.exists("all", lambda y: (F.size(y["has"]) > F.size(F.col("x.has"))) & (F.size(F.array_except(F.col("x.has"), y["has"])) == 0))
        return mine.where(~beaten).select("doc_id", (-F.col("x.best.line")).alias("line"), "family", F.col("x.best.probability").alias("probability"), F.col("x.best.overlap").alias("overlap"))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_pieces: int = TRAIN_PIECES, overlap: float = OVERLAP) -> LicenseModel:
    """A model learned from the notices and from pieces of about ``train_docs`` documents, chosen by a hash of doc_id."""
    spark = docs.sparkSession
    n = docs.select("doc_id").count()
    share = min(1.0, train_docs / n) if n else 0.0
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    # Bounded: train_pieces pieces of PIECE words.
    sample = plain_pieces(some, overlap).select("words").distinct().select("words", F.xxhash64("words").alias("h")).orderBy("h", "words").limit(train_pieces).collect()
    classes = [*sorted(NAMES), UNKNOWN]
    number = F.array_position(F.array(*[F.lit(f) for f in classes]), F.col("family")) - 1
    rows = training_rows(spark, [r.words for r in sample]).withColumn("label", number.cast("double"))
    rows = rows.withColumn("terms", F.concat("words", _pairs(F.col("words")))).select("terms", "label").coalesce(2)
    # Bounded by the training rows. A term that none of them has weighs nothing, so each column of the vocabulary has weights and
    # Spark keeps them dense: a piece costs its own terms. Sparse ones (of hashed terms, say) are gone through whole for each piece.
    known = sorted(r.term for r in rows.select(F.explode("terms").alias("term")).distinct().collect())
    tf = CountVectorizerModel.from_vocabulary(known, inputCol="terms", outputCol="features", minTF=1.0, binary=True)
    regression = LogisticRegression(maxIter=40, regParam=1e-3, family="multinomial", standardization=False)
    fitted = LicenseModel(Pipeline(stages=[tf, regression]).fit(rows), classes, dict.fromkeys(classes[:-1], LEAST), overlap)
    # All pieces without cues that it did not learn from, as counts: the unlikely ones together, the others each by its words.
    free = plain_pieces(docs, overlap).where(~F.xxhash64("words").isin([r.h for r in sample])).select("words")
    counted = stored(free.select(F.when(~fitted.unlikely(), F.col("words")).alias("words")).groupBy("words").agg(F.count("*").alias("k")), "pieces")
    n = counted.agg(F.sum("k")).first()[0] or 0
    fitted.thresholds = _calibrated(fitted.scored(counted.where("words IS NOT NULL")), classes[:-1], n)
    return fitted


def _calibrated(scored: DataFrame, families: list[str], n: int | None = None) -> dict[str, float]:
    """For each family the value at CALIBRATED of its probabilities in ``scored``, LEAST at least. Given ``n``, the number of all
    pieces, ``scored`` has only those that can be above LEAST, ``k`` times each.

    Only counted probabilities above LEAST leave a task, and the value is exact: it is so many places from the top, if as many
    are above LEAST. One family at a time, its last task sorts the share above CALIBRATED of all pieces and no more.
    """
    above = F.filter(F.array(*[F.struct(F.lit(f).alias("family"), F.get("probabilities", F.lit(i)).alias("p")) for i, f in enumerate(families)]), lambda x: x["p"] > LEAST)
    itself = F.struct(F.lit(None).cast("string").alias("family"), F.lit(None).cast("double").alias("p"))  # counts the piece
    each = scored.select(F.col("k") if n is not None else F.lit(1).alias("k"), F.explode(F.concat(F.array(itself), above)).alias("x"))
    tail = stored(each.groupBy("x.family", "x.p").agg(F.sum("k").alias("k")), "calibration")
    sizes = {r.family: r.n for r in tail.groupBy("family").agg(F.sum("k").alias("n")).collect()}
    n = sizes.get(None, 0) if n is None else n
    places = n - math.ceil(CALIBRATED * n) + 1
    out = {}
    for f in families:
        out[f] = LEAST
        if sizes.get(f, 0) >= places:
            top = tail.where(F.col("family") == f).orderBy(F.desc("p")).limit(places)
            out[f] = top.withColumn("n", F.sum("k").over(Window.orderBy(F.desc("p")))).where(F.col("n") >= places).agg(F.max("p")).first()[0]
    return out


def license_pieces(docs: DataFrame, model: LicenseModel | None = None, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, line, family, probability, overlap of the places that hold a licence; one for each cue of a notice."""
    model = model or train(docs, overlap=overlap)
    return model.confirm(model.identify(places(docs, model.overlap)))


def license_report(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """doc_id, n_licenses (lines with one), licenses (families, comma-joined), lines (line:family, comma-joined)."""
    lines = stored(license_pieces(docs, model), "licenses").select("doc_id", "line", "family").distinct()
    per_doc = lines.groupBy(F.col("doc_id").alias("d")).agg(
        F.count_distinct("line").alias("n"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("f"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "family"))), lambda s: F.concat_ws(":", s["line"].cast("string"), s["family"])), ",").alias("l"))
    return docs.select("doc_id").join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")), "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_licenses"), F.coalesce("f", F.lit("")).alias("licenses"), F.coalesce("l", F.lit("")).alias("lines"))
