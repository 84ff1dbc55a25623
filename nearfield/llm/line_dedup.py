"""Line dedup over a deletion neighbourhood of words.

A line is its lower-cased words. Lines of at least MIN_WORDS words are near when one word changed, added or left out makes
them equal; shorter ones only when equal. A line goes when an earlier line (by doc_id, then position) is equal or near.

Equal lines are grouped by hash. Of the different ones, those that share half of their words with no other line can have
no near line (one edit leaves the first or the second half alone) and are left out. The rest emit the whole line and all
variants without one word as hashed keys. Equal variants meet by key: the earliest line of each key stands for all, so a
group of any size costs a partial minimum and no pairs. What meets is verified on the words.

Nulls: a null or empty text has no lines with words. Lines without words are kept. A null doc_id comes first. Rows with
the same doc_id count as one document: lines at the same position of it are not later than each other. Empty tables
give no rows. Extra columns are kept by ``dedup_lines`` and not looked at by ``dropped_lines``.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import LOWER, SET_BITS, fresh, has_bits, hashed_set, map_arrow, stored
from nearfield.llm.shingles import word_hashes

MIN_WORDS = 8
#: Words that are hashed at once.
_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_B, _INVERSE = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


def _mixed(h, salt: int):
    h = (np.asarray(h, dtype=np.uint64) ^ np.uint64(salt * 0xD6E8FEB86659FD93 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)).view(np.int64)


class Hashes:
    """Hashes of any runs of words of a sequence: a polynomial of the words' hashes, summed from the beginning."""

    _back = np.ones(1, dtype=np.uint64)
    _forth = np.ones(1, dtype=np.uint64)

    def __init__(self, h: np.ndarray):
        if len(Hashes._back) <= len(h):
            Hashes._back, Hashes._forth = _powers(_INVERSE, 2 * len(h) + 1), _powers(_B, 2 * len(h) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * self._forth[: len(h)])))

    def run(self, a, b):
        """Hash of the words from ``a`` on before ``b`` (arrays)."""
        return (self.sums[b] - self.sums[a]) * self._back[a]


_SIZE = np.uint64(0xA24BAED4963EE407)


def half_keys(hashes: Hashes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Four keys for each line (words ``a`` to ``b`` - 1), of which two near lines have one in common: first and second
    half, as the longer and as the shorter line."""
    out = []
    for less in (0, 1):  # the shorter line has so many words less than this one
        m = b - a - less
        half = m // 2
        size = m.astype(np.uint64) * _SIZE
        out += [_mixed(hashes.run(a, a + half) + size, 1), _mixed(hashes.run(b - (m - half), b) + size, 2)]
    return np.stack(out, axis=1)


def variants(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the line (place -1) and of the line without its p-th word (place p)."""
    s, n = Hashes(word_hashes(words)).sums, len(words)
    keys = np.concatenate((s[n:], s[:-1] + (s[n] - s[1:]) * _INVERSE))
    sizes = np.concatenate(([n], np.full(n, n - 1)))
    return _mixed(keys + sizes.astype(np.uint64) * _SIZE, 1), np.arange(-1, n)


def near(a: list[bytes], b: list[bytes], bound: int = 1) -> bool:
    """Is the edit distance of two word sequences 1 at most?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > bound:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def _line_words(text: str | None):
    """(position, words) of the lines with words."""
    for at, line in enumerate(text.encode("utf-8", "surrogatepass").translate(LOWER).split(b"\n") if text else ()):
        if words := line.split():
            yield at, words


def _chunks(batches):
    """Runs of lines of about _CHUNK words: doc ids, positions, lines, all their words, and where each line begins and ends."""
    def packed():
        sizes = np.array([len(w) for w in lines], dtype=np.int64)
        ends = np.cumsum(sizes)
        return docs, ats, lines, [w for line in lines for w in line], ends - sizes, ends

    docs, ats, lines, held = [], [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for at, words in _line_words(text.as_py()):
                docs.append(doc)
                ats.append(at)
                lines.append(words)
                held += len(words)
            if held > _CHUNK:
                yield packed()
                docs, ats, lines, held = [], [], [], 0
    if lines:
        yield packed()


def _digests(words, a, b):
    """Two 64-bit hashes of each line, and the hashes of the first kind."""
    sizes, h = (b - a).astype(np.uint64), word_hashes(words)
    hashes, other = Hashes(h), Hashes(_mixed(h, 77).view(np.uint64))
    return _mixed(hashes.run(a, b) + sizes, 5), _mixed(other.run(a, b) + sizes, 6), hashes


def _survey(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, pos, h1, h2, keys: one row for each line with words; keys only where it may have a near line."""
    def run(batches):
        for ids, ats, lines, words, a, b in _chunks(batches):
            h1, h2, hashes = _digests(words, a, b)
            long = (b - a) >= min_words
            offsets = np.concatenate(([0], np.cumsum(np.where(long, 4, 0)))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(half_keys(hashes, a[long], b[long]).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ats, pa.int32()), pa.array(h1), pa.array(h2), listed], ["doc_id", "pos", "h1", "h2", "keys"])

    return map_arrow(docs, run, "doc_id long, pos int, h1 long, h2 long, keys array<long>")


def _line_bit(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The place of a line in a hashed set, by its document and position; ``_line_bit_column`` is the same as a column."""
    x = doc.astype(np.uint64) ^ (at.astype(np.uint64) << np.uint64(40))
    x ^= x << np.uint64(13)
    x ^= x >> np.uint64(7)
    x ^= x << np.uint64(17)
    return (x & np.uint64(SET_BITS - 1)).astype(np.int64)


def _line_bit_column():
    x = F.coalesce("doc_id", F.lit(0).cast("long")).bitwiseXOR(F.shiftleft(F.col("pos").cast("long"), 40))
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    x = x.bitwiseXOR(F.shiftleft(x, 17))
    return x.bitwiseAND(F.lit(SET_BITS - 1))


def _candidates(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """o and line (its words) of the lines in ``wanted`` (o, doc_id, pos, h1, h2); most others are not even split."""
    bits = docs.sparkSession.sparkContext.broadcast(hashed_set(wanted.select(_line_bit_column().alias("bit"))))  # of fixed size

    def hits(batches):
        """Document, position and words of the lines that the hashed set has; at last, no words."""
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                lines = text.encode("utf-8", "surrogatepass").translate(LOWER).split(b"\n")
                place = _line_bit(np.full(len(lines), doc or 0, dtype=np.int64), np.arange(len(lines)))
                for i in np.flatnonzero(has_bits(bits.value, place)).tolist():
                    if words := lines[i].split():
                        yield doc, i, words
        yield None, -1, None

    def run(batches):
        ids, ats, lines, held = [], [], [], 0
        for doc, at, words in hits(batches):
            if words:
                ids.append(doc)
                ats.append(at)
                lines.append(words)
                held += len(words)
            if lines and (words is None or held > _CHUNK):
                ends = np.cumsum([len(w) for w in lines])
                h1, h2, _ = _digests([w for line in lines for w in line], np.concatenate(([0], ends[:-1])), ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(ats, pa.int32()), pa.array(h1), pa.array(h2), pa.array([b" ".join(w) for w in lines], pa.binary())],
                    ["doc_id", "pos", "h1", "h2", "line"])
                ids, ats, lines, held = [], [], [], 0

    lines = map_arrow(docs, run, "doc_id long, pos int, h1 long, h2 long, line binary")
    same = [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in ("h1", "h2", "doc_id", "pos")]
    return lines.join(wanted.select("o", *[F.col(c).alias(f"w_{c}") for c in ("h1", "h2", "doc_id", "pos")]), same).select("o", "line").dropDuplicates(["o"])


def _shared(keyed: DataFrame, of: str) -> DataFrame:
    """The keys that more than one value of the column ``of`` has; they bring ``bit``, their place in a hashed set."""
    ends = keyed.groupBy("key").agg(F.min(of).alias("lo"), F.max(of).alias("hi"))
    return ends.where("lo != hi").select("key", F.col("key").bitwiseAND(F.lit(SET_BITS - 1)).alias("bit"))


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, pos, dropped for every line with words of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = stored(_survey(docs, min_words), "lines")
    firsts = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("first"))

    # Different lines that share a half with another one.
    halves = stored(_shared(lines.select("h1", F.explode("keys").alias("key")), "h1"), "halves")
    half_bits = docs.sparkSession.sparkContext.broadcast(hashed_set(halves.select("bit")))  # of fixed size

    def near_halves(batches):
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(2).offsets.to_numpy()))
            own = has_bits(half_bits.value, flat & (SET_BITS - 1))
            row = pa.array(row[own])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(flat[own])], ["h1", "h2", "key"])

    together = map_arrow(lines.select("h1", "h2", "keys"), near_halves, "h1 long, h2 long, key long").join(halves.select("key"), "key").select("h1", "h2").distinct()
    # Numbered in their order: ids of sorted rows rise from one range to the next.
    wanted = firsts.join(together, ["h1", "h2"]).select("h1", "h2", "first.*").orderBy("doc_id", "pos")
    wanted = stored(wanted.select(F.monotonically_increasing_id().alias("o"), "doc_id", "pos", "h1", "h2"), "near-lines")
    found = stored(_candidates(docs, wanted), "candidates")

    def emitted(bits) -> DataFrame:
        def run(batches):
            for batch in batches:
                for o, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                    keys, places = variants(line.as_py().split())
                    if bits is not None:
                        own = has_bits(bits.value, keys & (SET_BITS - 1))
                        keys, places = keys[own], places[own]
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(places, pa.int32()), pa.array(np.full(len(keys), o))], ["key", "place", "o"])

        return map_arrow(found, run, "key long, place int, o long")

    met = stored(_shared(emitted(None), "o"), "variants")
    bits = docs.sparkSession.sparkContext.broadcast(hashed_set(met.select("bit")))  # of fixed size
    shown = stored(emitted(bits).join(met.select("key"), "key"), "shown")
    # The earliest line of each variant without a word at one place; of each variant at any place; and the line that is it.
    by_place = shown.groupBy("key", "place").agg(F.min("o").alias("least"))
    by_key = by_place.groupBy("key").agg(
        F.min(F.when(F.col("place") >= 0, F.col("least"))).alias("cut"), F.min(F.when(F.col("place") < 0, F.col("least"))).alias("whole"))
    best = by_place.join(by_key, "key").select("key", "place", F.when(F.col("place") < 0, F.col("cut")).otherwise(F.least("least", "whole")).alias("best"))
    meets = shown.join(best, ["key", "place"]).where("best < o").select("o", "best").distinct()
    both = meets.join(found, "o").join(found.toDF("best", "b_line"), "best").select("o", "line", "b_line")

    def verify(batches):
        for batch in batches:
            ok = [near(a.as_py().split(), b.as_py().split()) for a, b in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["o"]).filter(pa.array(ok, pa.bool_()))

    gone = map_arrow(both, verify, "o long").distinct().join(wanted, "o").select("h1", "h2", F.lit(True).alias("near"))
    fate = firsts.join(gone, ["h1", "h2"], "left")
    first = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.pos") == F.col("pos"))
    return lines.select("doc_id", "pos", "h1", "h2").join(fate, ["h1", "h2"]).select("doc_id", "pos", (F.col("near").isNotNull() | ~first).alias("dropped"))


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines (with words), n_dropped, dropped (positions, comma-joined) for every document."""
    lines = dropped_lines(docs, min_words).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if("dropped").alias("n_dropped"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("dropped"), F.col("pos")))).cast("array<string>"), ",").alias("dropped"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    joined = rows.join(lines.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return joined.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_lines", "n_dropped")], F.coalesce("dropped", F.lit("")).alias("dropped"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without its dropped lines; n_chars, where there is one, follows the text."""
    key, gone = fresh("id"), fresh("gone")
    drops = dropped_lines(docs, min_words).where("dropped").groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("pos").alias(gone))
    joined = docs.join(drops, F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left")
    parts = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(gone, s.i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(parts, lambda s: s.x), "\n"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
