"""Toxicity: a subsequence string kernel machine over sentences, with Nyström landmarks.

The kernel of two words sums over all sequences of ``ORDER`` characters that both hold, with gaps allowed within ``SPAN``, each weighted
by DECAY to the power of the lengths it spans in both; it is normalised, and raised to a power, which leaves it a kernel. So an insult
with letters put in or gaps between them stays near its plain form. Words are framed by a mark for their start and end.
Landmarks are the words that tell toxic labelled documents from others best, none too like another, and common words of the
others. A word is its
kernel values with the landmarks, turned by the inverse root of the landmarks' own matrix; a sentence is the sum of its words.

A linear machine (squared hinge) learns from sentences: those of documents that aren't toxic are clean; of a toxic document
those that the machine finds toxic, and the likeliest one, are toxic, found in turns. A document's score is a logistic
probability over its likeliest sentence and the sum of what its sentences have above the margin of the clean ones.

A sentence ends at a line break, or at . ! ? before white space. Words lose marks at both ends; single letters in a row
count as one word; a word of more than ``LONG`` bytes is several, in windows that overlap by half.

Nulls: a null text counts as empty; an empty text scores as a sentence without words. Labels that are null or of held-out rows
teach nothing; without labels the score is 0.5, with labels of one kind their share. Very long texts are scored whole, a part
at a time. Equal values of words tie by the word. Repeated rows count as often as they occur and each give their row. Empty
tables give no rows. Only text, and doc_id and toxic for learning, are looked at, whatever other columns there are.
"""

import re
import uuid
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import LOWER, map_arrow, stored
from nearfield.operators.bounds import bounded

#: Labelled documents that teach the machine (about so many, chosen by a hash of doc_id), and sentences of each, evenly spread.
TRAIN_ROWS, TRAIN_SENTENCES = 4_000, 32
LANDMARKS = 128
ORDER, SPAN, DECAY, POWER = 3, 5, 0.6, 6
#: Landmarks are no more alike than this.
ALIKE = 0.8
THRESHOLD = 0.7
#: A longer word is several; a longer landmark isn't taken.
LONG, LONGEST_LANDMARK = 32, 12
TURNS = 6
#: Values of words that a worker remembers (twice as many at most), and sequences of letters looked up at a time.
KNOWN, BATCH = 1 << 18, 1 << 14
#: Sentences fitted and words compared with all landmarks at a time.
ROWS = 4096
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ENDS = re.compile(rb"[.!?](?=[\x20\x09-\x0D])|[\x0A-\x0D]+")


def words_of(sentence: bytes) -> list[bytes]:
    """Words as the kernel compares them."""
    out, letters = [], []
    for word in sentence.split():
        word = word.strip(_MARKS)
        if len(word) == 1:
            letters.append(word)
            continue
        if letters:
            out.append(b"".join(letters))
            letters = []
        if len(word) > LONG:
            out += [word[at : at + LONG] for at in range(0, len(word) - LONG // 2, LONG // 2)]
        elif word:
            out.append(word)
    if letters:
        joined = b"".join(letters)
        out += [joined[at : at + LONG] for at in range(0, max(1, len(joined) - LONG // 2), LONG // 2)]
    return out


def sentences(text: str | None):
    """Words of each sentence that has some, lower-cased (A-Z)."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
    at = 0
    for end in _ENDS.finditer(raw):
        words = words_of(raw[at : end.start()])
        at = end.end()
        if words:
            yield words
    words = words_of(raw[at:])
    if words:
        yield words


def _framed(words: list[bytes], fill: int) -> np.ndarray:
    texts = [w.decode("utf-8", "replace") for w in words]
    width = max(map(len, texts), default=0) + 2
    out = np.frombuffer("".join(("\x02" + t + "\x03").ljust(width, chr(fill)) for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return out.reshape(len(words), width)


@cache
def places(length: int) -> tuple[np.ndarray, np.ndarray]:
    """All rising ORDER places among ``length`` that span SPAN at most, and DECAY to the power of what they span."""
    out = np.array([at for at in combinations(range(length), ORDER) if at[-1] - at[0] < SPAN], dtype=np.int64).reshape(-1, ORDER)
    return out.T.copy(), (float(DECAY) ** (out[:, -1] - out[:, 0] + 1)).astype(np.float32)


def self_kernel(codes: np.ndarray) -> np.ndarray:
    """The kernel of each row with itself."""
    at, weight = places(codes.shape[1])
    sequence = np.zeros((len(codes), at.shape[1]), dtype=np.int64)
    for own in at:
        sequence = (sequence << 21) + codes[:, own]  # code points have 21 bits, ORDER is 3
    order = np.argsort(sequence, axis=1)
    sequence = np.take_along_axis(sequence, order, axis=1)
    head = np.ones(sequence.shape, dtype=bool)
    head[:, 1:] = sequence[:, 1:] != sequence[:, :-1]
    first = np.flatnonzero(head)
    sums = np.add.reduceat(weight[order].ravel(), first)
    return np.bincount(first // sequence.shape[1], sums**2, len(codes))


class Landmarks:
    """Maps words to vectors whose inner products are near the kernel (Nyström)."""

    def __init__(self, words: list[bytes]):
        self.words = words
        codes = _framed(words, 1)
        norms = [float(np.sqrt(self_kernel(w[None, w > 1])[0])) for w in codes]
        self.alphabet = np.unique(codes[codes > 1])
        base = len(self.alphabet) + 1
        # for each sequence of a landmark's letters the landmarks that have it, with their weights
        sums: dict[tuple[int, int], float] = {}
        for m, (w, norm) in enumerate(zip(codes, norms)):
            symbols = self._symbols(w[w > 1])
            at, weight = places(len(symbols))
            for u, x in zip(self._sequences(symbols[None], at)[0].tolist(), weight.tolist()):
                sums[u, m] = sums.get((u, m), 0.0) + x / norm
        self.landmark = np.array([m for _, m in sorted(sums)], dtype=np.int32)
        self.weight = np.array([sums[k] for k in sorted(sums)], dtype=np.float32)
        sequences, counts = np.unique([u for u, _ in sums], return_counts=True)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.table = np.full(base**ORDER, -1, dtype=np.int32)
        self.table[sequences] = np.arange(len(sequences))
        values, vectors = np.linalg.eigh(self.kernel(words).astype(np.float64))
        self.root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T

    def _symbols(self, codes: np.ndarray) -> np.ndarray:
        """Places in the alphabet, from 1; 0 for what no landmark has."""
        place = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[place] == codes, place + 1, 0)

    def _sequences(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(symbols), at.shape[1]), dtype=np.int64)
        for own in at:
            out = out * (len(self.alphabet) + 1) + symbols[:, own]
        return out

    def alike(self, words: list[bytes]) -> np.ndarray:
        """Normalised kernel values with all landmarks."""
        out = np.zeros((len(words), len(self.words)), dtype=np.float32)
        codes = _framed(words, 0)
        sizes = (codes > 1).sum(axis=1)
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            at, weight = places(size)
            step = max(1, BATCH // max(1, len(weight)))
            for k in range(0, len(own), step):
                part = own[k : k + step]
                left = codes[part, :size]
                row = self.table[self._sequences(self._symbols(left), at)]
                word, place = np.nonzero(row >= 0)
                row = row[word, place]
                counts = self.first[row + 1] - self.first[row]
                pair = np.arange(counts.sum(), dtype=np.int32) + np.repeat((self.first[row] - np.cumsum(counts) + counts).astype(np.int32), counts)
                cell = np.repeat((word * len(self.words)).astype(np.int32), counts) + self.landmark[pair]
                found = np.bincount(cell, np.repeat(weight[place], counts) * self.weight[pair], len(part) * len(self.words)).reshape(len(part), -1)
                out[part] = found / np.sqrt(self_kernel(left))[:, None]
        return out

    def kernel(self, words: list[bytes]) -> np.ndarray:
        """Normalised kernel values, to the power POWER, with all landmarks."""
        return self.alike(words) ** POWER

    def vectors(self, words: list[bytes]) -> np.ndarray:
        return self.kernel(words) @ self.root


#: Values of words by the machine that a worker used last, lately used ones and those before.
_known: dict[str, object] = {"machine": None, "new": {}, "old": {}}


class Machine:
    """Scores documents by their sentences."""

    def __init__(self, landmarks: Landmarks | None, weights: np.ndarray | None, bias: float, curve: np.ndarray):
        self.landmarks, self.weights, self.bias, self.curve = landmarks, weights, bias, curve
        self.name = uuid.uuid4().hex

    def values(self, words: set[bytes]) -> dict[bytes, float]:
        """A dictionary that has the values of ``words``."""
        if _known["machine"] != self.name:
            _known.update(machine=self.name, new={}, old={})
        elif len(_known["new"]) > KNOWN:
            _known.update(new={}, old=_known["new"])
        new, old = _known["new"], _known["old"]
        missing = []
        for w in words:
            if w not in new:
                if w in old:
                    new[w] = old[w]
                else:
                    missing.append(w)
        missing.sort(key=len)
        turned = (self.landmarks.root @ self.weights).astype(np.float32) if missing else None
        for at in range(0, len(missing), ROWS):
            own = missing[at : at + ROWS]
            new.update(zip(own, (self.landmarks.kernel(own) @ turned).tolist()))
        return new

    def scores(self, texts: list) -> np.ndarray:
        """Scores of ``texts``, by the likeliest sentence of each."""
        if self.landmarks is None:
            return np.full(len(texts), logistic(self.curve[-1]))
        best, above = np.full(len(texts), -np.inf), np.zeros(len(texts))
        waiting, size = [], 0

        def settle():
            value = self.values({w for _, words in waiting for w in words}).__getitem__
            for i, words in waiting:
                f = sum(map(value, words)) + self.bias
                best[i] = max(best[i], f)
                above[i] += max(0.0, f + 1)
            waiting.clear()

        for i, text in enumerate(texts):
            for words in sentences(text):
                waiting.append((i, words))
                size += len(words)
                if size >= KNOWN // 8:
                    settle()
                    size = 0
        settle()
        best[np.isneginf(best)] = self.bias
        return logistic(shape(best, above) @ self.curve)


def shape(best: np.ndarray, above: np.ndarray) -> np.ndarray:
    """What the logistic curve of documents looks at."""
    return np.column_stack((best, np.log1p(above), np.ones(len(best))))


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def along(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``x`` with all but the last of ``w``, and the last."""
    return np.concatenate([x[at : at + ROWS].astype(np.float64) @ w[:-1] for at in range(0, len(x), ROWS)] or [np.zeros(0)]) + w[-1]


def fit_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights (the last one the bias) of a linear machine with squared hinge loss, by Newton steps over the rows within the
    margin; rows of weight 0 don't count."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    before = None
    for _ in range(steps):
        own = (y * along(x, w) < 1) & (weight > 0)
        if before is not None and (own == before).all():
            break
        before = own
        left, right = ridge.copy(), np.zeros(len(w))
        for at in range(0, len(x), ROWS):
            pick = at + np.flatnonzero(own[at : at + ROWS])
            part = np.column_stack((x[pick].astype(np.float64), np.ones(len(pick))))
            scaled = part * (2 * weight[pick, None])
            left += scaled.T @ part
            right += scaled.T @ y[pick]
        w = np.linalg.solve(left, right)
    return w


def learn(vectors: np.ndarray, bags: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Weights and bias from sentence ``vectors``, their documents' numbers ``bags`` and ``toxic`` (0 or 1) of each document."""
    inside = toxic[bags] > 0
    positive = inside.copy()
    w = np.zeros(vectors.shape[1] + 1)
    for turn in range(TURNS):
        if turn:
            f = along(vectors, w)
            top = np.full(len(toxic), -np.inf)
            np.maximum.at(top, bags, f)
            positive = inside & ((f > 0) | ((f >= top[bags]) & (f > -0.9)))
            if not positive.any():
                break
        heavy = 3.0 if turn else (~inside).sum() / max(1, positive.sum())
        w = fit_hinge(vectors, np.where(positive, 1.0, -1.0), np.where(positive, heavy, np.where(inside, 0.0, 1.0)))
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of a logistic curve, kept from infinity by one made-up row on either side."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = logistic(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + 1e-3 * np.eye(len(w)), x.T @ (target - p) - 1e-3 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def choose_landmarks(n_toxic: int, n_clean: int, words: list[tuple[bytes, int, int]], count: int = LANDMARKS) -> list[bytes]:
    """Three quarters of ``count`` are the words (word, toxic documents, clean documents) that tell toxic documents best, by the
    likelihood ratio; the rest are the commonest of the others."""
    def gain(a, b):
        out = 0.0
        for k, n, all_ in ((a, n_toxic, a + b), (b, n_clean, a + b)):
            for own, share in ((k, all_), (n - k, n_toxic + n_clean - all_)):
                if own > 0:
                    out += own * np.log(own * (n_toxic + n_clean) / (n * share))
        return out

    fit = [w for w in words if 2 <= len(w[0]) <= LONGEST_LANDMARK]
    telling = [w for _, w in sorted((-gain(a, b), w) for w, a, b in fit if a * n_clean > b * n_toxic)]
    common = [w for _, w in sorted((-b, w) for w, a, b in fit if a * n_clean <= b * n_toxic)]
    chosen: list[bytes] = []
    for own, most in ((telling, count * 3 // 4), (common, count)):
        while own and len(chosen) < most:
            chosen.append(own[0])
            own = [w for w, like in zip(own, Landmarks(chosen[-1:]).alike(own)[:, 0]) if like <= ALIKE]
    return chosen


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """A machine learned from about ``rows`` labelled rows of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), (F.col("toxic") > 0).cast("int").alias("y"))
    n = known.count()
    share = min(1.0, rows / n) if n else 0.0
    chosen = bounded(known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000))
    sample = stored(docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("id")).select("doc_id", "y", "text"), "labelled")
    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return Machine(None, None, 0.0, np.array([0.0 if not sizes else 50.0 if 1 in sizes else -50.0]))

    def vocabulary(batches):
        for batch in batches:
            for y, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                words = list({w for s in sentences(text.as_py()) for w in s if 2 <= len(w) <= LONGEST_LANDMARK})
                yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()), "y": pa.array([y] * len(words), pa.int32())})

    tally = map_arrow(sample, vocabulary, "word binary, y int").groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where("a + b >= 3")
    telling = tally.orderBy(F.desc(F.col("a") / (F.col("b") + F.lit(sizes[0] / sizes[1]))), "word").limit(1000)
    common = tally.orderBy(F.desc("b"), "word").limit(1000)
    words = {bytes(r.word): (bytes(r.word), r.a, r.b) for r in telling.union(common).collect()}
    landmarks = Landmarks(choose_landmarks(sizes[1], sizes[0], sorted(words.values())))

    def embed(batches):
        width = len(landmarks.words)
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch, out = whole.slice(at, 128), []
                found = [list(sentences(t.as_py())) for t in batch.column(2)]
                found = [own[:: max(1, -(-len(own) // TRAIN_SENTENCES))] for own in found]
                distinct = sorted({w for own in found for words in own for w in words})
                vectors = landmarks.vectors(distinct) if distinct else np.zeros((0, width))
                place = {w: i for i, w in enumerate(distinct)}
                for own in found:
                    sums = [vectors[[place[w] for w in words]].sum(axis=0) for words in own]
                    out.append(np.array(sums or np.zeros((1, width)), dtype=np.float16).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "y", "sums"])

    table = map_arrow(sample, embed, f"doc_id {dict(docs.dtypes)['doc_id']}, y int, sums binary").collect()  # bounded by ``rows``
    table.sort(key=lambda r: (r.doc_id, r.y, bytes(r.sums)))
    toxic, width = np.array([r.y for r in table]), len(landmarks.words)
    bags = np.repeat(np.arange(len(table)), [len(r.sums) // (2 * width) for r in table])
    vectors = np.frombuffer(b"".join(r.sums for r in table), dtype=np.float16).reshape(-1, width)
    del table
    w = learn(vectors, bags, toxic)
    f = along(vectors, w)
    best = np.full(len(toxic), -np.inf)
    np.maximum.at(best, bags, f)
    above = np.bincount(bags, np.maximum(0, f + 1), minlength=len(toxic))
    return Machine(landmarks, w[:-1], float(w[-1]), fit_logistic(shape(best, above), toxic))


def held_out(doc_id: str = "doc_id"):
    """Column: crc32 of the id as text, modulo 3, is 1. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_toxicity(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # LANDMARKS words and their matrix

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                score = shared.value.scores([t.as_py() for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")


def predict_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, learned from the labels of rows that aren't held out."""
    machine = train(docs, labels.where(~held_out()))
    return score_toxicity(docs, machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")
