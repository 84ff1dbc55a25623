"""Language identification as inference of a mixture of languages.

Each language is a distribution of letter trigrams, counted on labelled rows. A document is cut into windows; by
expectation-maximisation over the windows' trigram likelihoods its language proportions are estimated. The set of
languages grows one at a time as long as the likelihood gains more than a penalty for each further language; the language
with the largest proportion is the prediction.

Nulls: text null or without a letter is ``und`` with score 0. Rows without lang, and held-out rows, teach nothing.
Without any labelled row every prediction is ``und``. Ties go to the first language in code point order. Repeated rows
count as often as they occur. Empty tables give no rows. Other columns are not looked at, and lang is none of the inputs
of a prediction.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import held_out, map_arrow

#: Labelled rows of each language that teach it (about so many, chosen by a hash of doc_id), and the most languages.
TRAIN_ROWS, MAX_LANGUAGES = 4_000, 500
CELLS, WINDOW, SLAB = 1 << 16, 160, 1 << 20
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def trigrams(text: str):
    """Yields the trigram cells of slabs of the lower-cased text; what is no letter is one space."""
    known = letters()
    for at in range(0, len(text), SLAB):
        points = np.frombuffer(text[at : at + SLAB].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = known[points]
        if not letter.any():
            continue
        c = np.where(letter, points, np.uint32(32))
        c = np.concatenate(([np.uint32(32)], c[letter | np.concatenate(([True], letter[:-1]))], [np.uint32(32)]))
        h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
        yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64)


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and the log probabilities (CELLS x languages) of their trigrams, from ``docs`` (doc_id, text, lang)."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r.lang: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return [], np.zeros((CELLS, 0), dtype=np.float32)
    rate = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, rows / n)))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate[F.col("lang")] * 1_000_000)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = sums.setdefault(lang, np.zeros(CELLS, dtype=np.int64))
                for cells in trigrams(text.as_py()):
                    own += np.bincount(cells, minlength=CELLS)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "counts": pa.array([c.tobytes() for c in sums.values()], pa.binary())})

    def fold(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[lang] = sums.get(lang, 0) + np.frombuffer(c.as_buffer(), dtype=np.int64)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "counts": pa.array([c.tobytes() for c in sums.values()], pa.binary())})

    # The sampled rows lie in every split of the scan; a few tasks count them, so that few tables of counts arise.
    few = chosen.select("lang", "text").repartition(max(1, min(32, len(counts) * rows // 1000)))
    parts = map_arrow(few, count, "lang string, counts binary").repartition(min(32, len(counts)), "lang")
    found = {r.lang: np.frombuffer(r.counts, dtype=np.int64) for r in map_arrow(parts, fold, "lang string, counts binary").toLocalIterator()}
    langs = sorted(found)
    logs = [np.log((found[x] + 0.5) / (found[x].sum() + 0.5 * CELLS)) for x in langs]
    return langs, np.stack(logs, axis=1).astype(np.float32) if langs else np.zeros((CELLS, 0), dtype=np.float32)


def window_scores(text: str, logs: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Log likelihoods (windows x languages) of runs of about ``window`` trigrams."""
    out = []
    for cells in trigrams(text):
        k = max(1, round(len(cells) / window))
        edges = np.arange(k) * len(cells) // k
        out.append(np.add.reduceat(logs[cells], edges, axis=0, dtype=np.float64))
    return np.concatenate(out) if out else np.zeros((0, logs.shape[1]))


def fit_mixture(scores: np.ndarray, turns: int = 60) -> tuple[np.ndarray, float]:
    """Proportions of all columns of ``scores`` by expectation-maximisation, and the log likelihood."""
    top = scores.max(axis=1, keepdims=True)
    likely = np.exp(scores - top)
    share = np.full(scores.shape[1], 1 / scores.shape[1])
    before = -np.inf
    for _ in range(turns):
        joint = likely * share
        total = joint.sum(axis=1, keepdims=True)
        now = float(np.log(total).sum())
        share = (joint / total).mean(axis=0)
        if now - before < 1e-6:
            break
        before = now
    return share, now + float(top.sum())


def infer(scores: np.ndarray, penalty: float = 6.0) -> list[tuple[int, float]]:
    """Languages and their proportions, largest first."""
    best = np.unique(scores.argmax(axis=1))
    if len(best) == 1:  # the same language explains every window best: no mixture is likelier
        return [(int(best[0]), 1.0)]
    chosen = [int(scores.sum(axis=0).argmax())]
    share, value = np.ones(1), float(scores[:, chosen[0]].sum())
    cost = penalty + 0.5 * np.log(len(scores))
    while True:
        tries = [(fit_mixture(scores[:, [*chosen, int(x)]]), int(x)) for x in best if x not in chosen]
        if not tries:
            break
        (new, likely), x = max(tries, key=lambda t: t[0][1])
        if likely - value <= cost:
            break
        chosen, share, value = [*chosen, x], new, likely
    return sorted(((c, float(s)) for c, s in zip(chosen, share)), key=lambda x: (-x[1], x[0]))


def identify(docs: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score (share of the text in that language, by the windows' posteriors), languages
    (proportions of the selected set) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(logs)  # CELLS x at most MAX_LANGUAGES numbers

    def run(batches):
        table = shared.value
        for batch in batches:
            pred, score, sets = [], [], []
            for cell in batch.column(1):
                text = cell.as_py()
                w = window_scores(text, table) if text and len(langs) else ()
                if not len(w):
                    pred.append("und")
                    score.append(0.0)
                    sets.append("")
                    continue
                found = infer(w)
                at = found[0][0]
                posterior = 1 / np.exp((w - w[:, [at]]).clip(max=500)).sum(axis=1)
                pred.append(langs[at])
                score.append(float(min(1.0, posterior.mean())))
                sets.append(",".join(f"{langs[i]}:{s:.3f}" for i, s in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], ["doc_id", "lang_pred", "score", "languages"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double, languages string")


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages, learned from the rows that aren't held out."""
    langs, logs = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs, langs, logs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")
