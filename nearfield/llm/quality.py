"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of the text.

Words are hashed to cells and weighted by frequency within the document; each statistic (shares of upper case, digits,
marks, white space, repeated and distinct words, word and line lengths) and the metadata (numbers of characters and lines)
is one of a few levels. The score has a linear term and low-rank interactions of all pairs of features, computed in linear
time as half the square of the sum less the sum of the squares, and is a logistic probability.

Nulls: a null text counts as empty; an empty text has a score by its statistics. Labels that are null or of held-out rows
teach nothing; without labels the score is 0.5, with labels of one kind their share. Repeated rows count as often as they
occur. Empty tables give no rows. Only text, and doc_id and quality for learning, are looked at.
"""

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import LOWER, held_out, map_arrow
from nearfield.operators.bounds import bounded

#: Labelled rows that teach the model (about so many, chosen by a hash of doc_id).
TRAIN_ROWS = 6_000
WORD_CELLS, LEVELS, RANK = 1 << 15, 12, 8
THRESHOLD = 0.7
_STATS = 12
#: Length of a document's vector of words; each statistic has the value 1.
WORD_SHARE = 0.5
FEATURES = WORD_CELLS + _STATS * LEVELS
_KIND = np.zeros(256, dtype=np.int64)
for _c in range(256):
    _KIND[_c] = (1 if 65 <= _c <= 90 else 2 if 48 <= _c <= 57 else 3 if _c in (9, 10, 11, 12, 13, 32) else 0 if 97 <= _c <= 122 or _c >= 128 else 4)


class _Cells(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 17:
            self.clear()
        value = self[word] = zlib.crc32(word) & (WORD_CELLS - 1)
        return value


_cells = _Cells()


def distinct_lines(raw: bytes) -> int:
    """Number of different lines of the whole text, by 64-bit hashes; about 1 MiB of lines is split at a time."""
    seen: set[int] = set()
    at = 0
    while at <= len(raw):
        end = raw.find(b"\n", at + (1 << 20))
        end = len(raw) if end < 0 else end
        seen.update(map(xxhash.xxh3_64_intdigest, raw[at:end].split(b"\n")))
        at = end + 1
    return len(seen)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers in ascending order, and their values."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    kinds = np.zeros(5, dtype=np.int64)
    for at in range(0, len(raw), 1 << 20):
        kinds += np.bincount(_KIND[np.frombuffer(raw[at : at + (1 << 20)], dtype=np.uint8)], minlength=5)
    words = raw.translate(LOWER).split()
    ids = np.fromiter(map(_cells.__getitem__, words), dtype=np.int64, count=len(words))
    cells, counts = np.unique(ids, return_counts=True)
    n, size, lines = max(1, len(words)), max(1, len(raw)), raw.count(b"\n") + 1
    letters = max(1, size - int(kinds[2:].sum()))
    stats = (
        np.log2(1 + len(raw)) / 20, np.log2(lines) / 12, kinds[1] / letters, kinds[2] / size, kinds[4] / size, kinds[3] / size,
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0, len(cells) / n, (counts.max() / n if len(counts) else 0.0),
        min(1.0, letters / n / 16), np.log2(1 + n / lines) / 12, distinct_lines(raw) / lines if lines > 1 else 1.0,
    )
    level = np.minimum(LEVELS - 1, (np.sqrt(np.clip(stats, 0, 1)) * LEVELS).astype(np.int64))
    weight = np.log1p(counts)
    weight = WORD_SHARE * weight / max(1e-9, np.sqrt((weight**2).sum())) if len(weight) else weight
    at = np.concatenate((cells, WORD_CELLS + np.arange(_STATS) * LEVELS + level))
    return at, np.concatenate((weight, np.ones(_STATS))).astype(np.float64)


class Machine:
    """score = sigmoid(bias + w x + 1/2 sum_k ((V_k x)^2 - V_k^2 x^2))"""

    def __init__(self, bias: float = 0.0, rank: int = RANK, seed: int = 5):
        self.bias = bias
        self.w = np.zeros(FEATURES)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (FEATURES, rank))

    def raw(self, at, values, starts):
        """Scores before the logistic, of documents whose features begin at ``starts``; none is without features."""
        xv = self.v[at] * values[:, None]
        sums = np.add.reduceat(xv, starts, axis=0)
        squares = np.add.reduceat((xv**2).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.w[at] * values, starts) + 0.5 * ((sums**2).sum(axis=1) - squares), xv, sums

    def score(self, at, values, starts):
        return 1 / (1 + np.exp(-np.clip(self.raw(at, values, starts)[0], -50, 50)))

    def fit(self, rows, labels, steps: int = 1000, batch: int = 64, rate: float = 0.1, decay: float = 1e-5, seed: int = 7):
        """Learns from ``rows`` (feature numbers, values) by Adagrad over shuffled batches."""
        rng = np.random.default_rng(seed)
        seen_w, seen_v, seen_b = np.full(FEATURES, 1e-2), np.full(self.v.shape, 1e-2), 1e-2
        for _ in range(max(1, round(steps * batch / len(rows)))):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), batch):
                own = order[k : k + batch]
                sizes = np.array([len(rows[i][0]) for i in own])
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                at, values = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own])
                z, xv, sums = self.raw(at, values, starts)
                slope = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels[own]
                each = np.repeat(slope, sizes) * values
                slope_v = each[:, None] * (np.repeat(sums, sizes, axis=0) - xv)
                by = np.argsort(at, kind="stable")
                cells, first = np.unique(at[by], return_index=True)
                gw = np.add.reduceat(each[by], first) / len(own) + decay * self.w[cells]
                gv = np.add.reduceat(slope_v[by], first, axis=0) / len(own) + decay * self.v[cells]
                gb = float(slope.mean())
                seen_w[cells] += gw**2
                seen_v[cells] += gv**2
                seen_b += gb**2
                self.w[cells] -= rate * gw / np.sqrt(seen_w[cells])
                self.v[cells] -= rate * gv / np.sqrt(seen_v[cells])
                self.bias -= rate * gb / np.sqrt(seen_b)
        return self


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """A machine learned from about ``rows`` labelled rows of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality)."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y"))
    n = known.count()
    share = min(1.0, rows / n) if n else 0.0
    chosen = bounded(known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000))
    joined = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("id")).select("text", "doc_id", "y")

    def run(batches):
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())],
                ["doc_id", "y", "at", "values"])

    table = map_arrow(joined, run, f"doc_id {dict(docs.dtypes)['doc_id']}, y double, at binary, values binary")
    found = sorted(table.collect(), key=lambda r: (r.doc_id, r.y, bytes(r["at"])))  # as many as ``rows``, by the documented bound
    y = np.array([min(1.0, max(0.0, r.y)) for r in found])
    if not len(y):
        model = Machine()
        model.v[:] = 0
        return model
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Machine(bias=float(np.log(mean / (1 - mean))))
    if y.min() == y.max():
        model.v[:] = 0
        return model
    return model.fit([(np.frombuffer(r["at"], dtype=np.int32).astype(np.int64), np.frombuffer(r["values"], dtype=np.float32).astype(np.float64)) for r in found], y)


def _scores(texts, model: Machine) -> np.ndarray:
    out = []
    for t in texts:
        at, values = features(t.as_py())
        out.append(model.score(at, values, np.zeros(1, dtype=np.int64))[0])
    return np.array(out)


def score_quality(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x (RANK + 1) numbers

    def run(batches):
        for batch in batches:
            score = _scores(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")


def predict_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, learned from the labels of rows that aren't held out."""
    model = train(docs, labels.where(~held_out()))
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score at least ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels.where(~held_out())))

    def run(batches):
        for batch in batches:
            score = _scores(batch.column(batch.schema.get_field_index("text")), shared.value)
            yield batch.filter(pa.array(score >= threshold, pa.bool_()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_arrow(docs, run, schema)
