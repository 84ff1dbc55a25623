"""The registered query of each operator, and its SQL where SQL can express it."""

from nearfield.llm import collocations, decontamination, language, licenses, line_dedup, mixing, ngram_join, periodic_runs, pii, quality, token_files, topk, toxicity
from nearfield.llm.common import table


def op1_line_dedup(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark, sf_dir):
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op3_token_files(spark, sf_dir):
    return token_files.tokens_round_trip(table(spark, sf_dir, "documents"))


def op4_exact_topk(spark, sf_dir):
    return topk.neighbours(table(spark, sf_dir, "embeddings"))


def op5_ngram_join(spark, sf_dir):
    return ngram_join.near_groups(table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return decontamination.digest(decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_license_scan(spark, sf_dir):
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op8_pii(spark, sf_dir):
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op9_language(spark, sf_dir):
    return language.predict_languages(table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    return quality.predict_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_toxicity(spark, sf_dir):
    return toxicity.predict_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark, sf_dir):
    docs = periodic_runs.planted(table(spark, sf_dir, "documents"))
    return periodic_runs.run_digest(periodic_runs.periodic_runs(docs))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_mix_sources, op3_token_files, op4_exact_topk, op5_ngram_join, op6_decontamination, op7_license_scan, op8_pii, op9_language, op10_quality,
                                   op11_collocations, op12_toxicity, op13_periodic_runs)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEST_WORDS = "coalesce(regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

_WORDS = "coalesce(regexp_extract_all(" + _LOWER.format("text") + r", '[^\x20\x09-\x0D]+'), [])"

ORACLES = {
    "op1_line_dedup": f"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
l AS (SELECT * FROM (SELECT doc_id, pos, {_WORDS} AS w FROM raw) WHERE len(w) > 0),
d AS (SELECT w, row_number() OVER (ORDER BY doc_id, pos) AS o, doc_id, pos
      FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM l) WHERE k = 1),
v AS (SELECT o, p, list_concat(w[1:p - 1], w[p + 1:]) AS k FROM (SELECT o, w, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) >= 8)),
changed AS (SELECT o FROM (SELECT o, min(o) OVER (PARTITION BY k, p) AS m FROM v) WHERE o > m),
longer AS (SELECT x.o AS a, v.o AS b FROM d x JOIN v ON x.w = v.k WHERE len(x.w) >= 8),
near AS (SELECT o FROM changed UNION SELECT greatest(a, b) FROM longer),
fate AS (SELECT l.doc_id, l.pos, (l.doc_id != d.doc_id OR l.pos != d.pos OR d.o IN (SELECT o FROM near)) AS gone FROM l JOIN d USING (w)),
sums AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (gone) AS dropped FROM fate GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped, '') AS dropped FROM documents LEFT JOIN sums USING (doc_id)
""",
    "op4_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id != c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
""",
    "op5_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id != b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id
FROM (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) LEFT JOIN n USING (doc_id)
""",
    "op6_decontamination": f"""
WITH item_words AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_TEST_WORDS} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM item_words WHERE len(w) > 0)
),
doc_words AS (SELECT doc_id, {_TEST_WORDS} AS w FROM documents),
places AS (
    SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM doc_words), (SELECT DISTINCT n FROM windows)
    WHERE p + n - 1 <= len(w)
),
found AS (SELECT doc_id, p, n, item_id FROM places JOIN windows USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op11_collocations": f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("text")}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (
    SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase, count(*) AS f
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)
    GROUP BY ALL HAVING count(*) >= 100
),
c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
held AS (
    SELECT lang, phrase, max(f) AS longer
    FROM (SELECT lang, f, array_to_string(w[p:p + m - 1], ' ') AS phrase FROM (SELECT lang, f, w, m, unnest(range(1, k - m + 2)) AS p FROM c, (SELECT unnest([2, 3, 4]) AS m) WHERE m < k))
    GROUP BY ALL
),
kept AS (SELECT c.* FROM c LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * c.f),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM kept),
scored AS (
    SELECT cuts.lang, cuts.phrase, cuts.f AS a, x.f AS l, y.f AS r, n, cut,
           CAST((CAST(1000 AS HUGEINT) * cuts.f * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM cuts JOIN totals USING (lang) JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:cut], ' ')
    JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')
),
lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM scored) WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest) WHERE rank <= 2000
""",
}
