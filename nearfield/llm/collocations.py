"""Phrase collocations: contiguous phrases that occur often, scored by how much more often than their parts suggest.

Words become 64-bit numbers once (a hash of language and word; two words under one number are noticed and another seed is
taken), and the numbered text is stored with 0 between pieces. Then, for phrases of 2, 3, ... words:

1. Apriori: a place can only begin a frequent phrase of k words where its two parts of k - 1 words are frequent. Sets of
   fixed size hold the frequent parts, and hashed counters of fixed size drop phrases that can't reach the least count. Both
   only ever let too many through, so no frequent phrase is lost. What is left are the candidates. The phrases of a counter are
   named by one task only, the one that counted most of it, so that names grow with the phrases and not with the tasks.
2. Candidates, ``PART`` at a time, become a double-array trie, built in a task and broadcast. All places of a piece of text
   advance through it side by side, one word at a time; accepting states are counted, and the counts of all tasks summed.
3. The counters, cut finer, less the counts of the phrases named show where another phrase may still reach the least count.
   Only there all tasks name what they have, and that is counted like the rest.

Scores are exact decimals of 38 digits. Languages are kept apart by the word numbers; a hot language or word costs no more,
since counts are summed before the shuffle, and look-ups of parts are salted.

Nulls: a null text is empty, a null language is ``und``; doc_id isn't needed. Empty texts have no words. Long texts are
counted whole. Ties in rank: greater count, then the phrase in byte order; ties of cuts: the first. Repeated rows count as
often as they occur. Empty tables give no rows. Only lang and text are looked at, whatever other columns there are.
"""

from collections import Counter
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import SET_BITS, hashed_set, has_bits, map_arrow, stored
from nearfield.operators.bounds import bounded

LEAST, LONGEST, TOP, PERCENT = 100, 5, 2000, 100
#: Candidates in one trie, each with a pass over the numbered text.
PART = 1 << 18
#: Counts of a trie in one row of what a task adds up.
SHARD = 1 << 12
#: Hashed counters of a level, and those sent as one row.
CELLS, CELL_CHUNK = 1 << 24, 1 << 18
#: Finer counters that each counter with the least count is cut into, as long as there are no more than CELLS of them.
FINE = 16
#: Words of text in a row of the stored table (a longer piece is one row), and words a task counts or remembers at a time.
ROW_WORDS, KNOWN = 1 << 16, 1 << 17
#: Candidates a task keeps before it hands them on, so that it seldom names one twice.
KEPT = 1 << 19
#: Copies of the table of frequent phrases for look-ups by frequent keys.
SALT = 8
_TO_PIECES = bytes(46 if c in b".,;:!?\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Numbers(dict):
    """Numbers of one language's words; the mark between pieces is 0."""

    def __init__(self, lang: bytes, seed: int):
        self.lang, self.seed = lang + b"\0", seed
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
            self[b"."] = 0
        value = self[word] = xxhash.xxh3_64_intdigest(self.lang + word, self.seed) or 1
        return value


def pieces(raw: bytes):
    """Words in order, with b"." between pieces, in lists of whole pieces of about 1 MiB."""
    raw = raw.translate(_TO_PIECES)
    at = 0
    while at < len(raw):
        end = raw.find(b".", at + (1 << 20))
        end = len(raw) if end < 0 else end
        yield raw[at:end].replace(b".", b" . ").split()
        at = end + 1


def number_words(docs: DataFrame, seed: int) -> DataFrame:
    """Rows (ids) of numbered text, and rows (gram, proof, lang, word, n, teller) of words and their counts in a task, which
    hands them on several times if there are many; ``teller`` names the task and time."""

    def run(batches):
        numbers: dict[bytes, _Numbers] = {}
        counts: dict[bytes, Counter] = {}
        ids, size, told = [], 0, 0

        def text_row():
            return pa.RecordBatch.from_arrays(
                [pa.array([np.concatenate(ids).tobytes()], pa.binary())] + [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())],
                ["ids", "gram", "proof", "lang", "word", "n", "teller"])

        def word_rows():
            nonlocal told
            told += 1
            teller = xxhash.xxh64_intdigest(b"%d %d" % (TaskContext.get().partitionId(), told)) - (1 << 63)
            for lang, own in counts.items():
                own.pop(b".", None)
                words = list(own)
                gram = np.fromiter((xxhash.xxh3_64_intdigest(lang + b"\0" + w, seed) or 1 for w in words), np.uint64, len(words))
                proof = np.fromiter((xxhash.xxh64_intdigest(lang + b"\0" + w) for w in words), np.uint64, len(words))
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(words), pa.binary()), pa.array(gram.view(np.int64)), pa.array(proof.view(np.int64)), pa.array([lang] * len(words), pa.binary()),
                     pa.array(words, pa.binary()), pa.array(list(own.values()), pa.int64()),
                     pa.array(np.full(len(words), teller, np.int64))], ["ids", "gram", "proof", "lang", "word", "n", "teller"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).cast(pa.binary()), batch.column(1).cast(pa.binary())):
                lang = lang.as_py()
                if lang not in numbers and sum(map(len, numbers.values())) >= KNOWN:
                    numbers.clear()
                known = numbers.setdefault(lang, _Numbers(lang, seed))
                for words in pieces(text.as_py() or b""):
                    counts.setdefault(lang, Counter()).update(words)
                    ids += [np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), np.zeros(1, np.uint64)]
                    size += len(words) + 1
                    if size >= ROW_WORDS:
                        yield text_row()
                        ids, size = [], 0
                        if sum(map(len, counts.values())) >= KNOWN:
                            yield from word_rows()
        if ids:
            yield text_row()
        yield from word_rows()

    named = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return map_arrow(named, run, "ids binary, gram long, proof long, lang binary, word binary, n long, teller long")


def grams(ids: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of ``k`` numbers from each place on."""
    out = ids[: max(0, len(ids) - k + 1)].copy()
    for j in range(1, k):
        out = (out ^ (out >> np.uint64(31))) * _MIX + ids[j : len(out) + j] * _TURN
    return out


def _bits(gram: np.ndarray) -> np.ndarray:
    return (gram & np.uint64(SET_BITS - 1)).astype(np.int64)


def _cells(gram: np.ndarray) -> np.ndarray:
    return ((gram * _TURN) >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _possible(ids: np.ndarray, k: int, parts: np.ndarray) -> np.ndarray:
    """Places where both parts of k - 1 numbers are in the set, and no piece ends."""
    if len(ids) < k:
        return np.empty(0, dtype=np.int64)
    part = has_bits(parts, _bits(grams(ids, k - 1)))
    zeros = np.concatenate(([0], np.cumsum(ids == 0)))
    return np.flatnonzero(part[:-1] & part[1:] & (zeros[k:] == zeros[: len(zeros) - k]))


def _texts(batches, k: int):
    """Numbered texts; a long one in parts that share k - 1 numbers, so that each place begins a phrase in one of them."""
    for batch in batches:
        for row in batch.column(0):
            ids = np.frombuffer(row.as_buffer(), dtype=np.uint64)
            for at in range(0, max(1, len(ids) - k + 1), 2 * ROW_WORDS):
                yield ids[at : at + 2 * ROW_WORDS + k - 1]


def enough(texts: DataFrame, k: int, parts, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed counters that reach ``least`` among possible phrases of ``k`` words, ascending, and for each the task that
    counted most of it."""
    kind = np.uint8 if least < 256 else np.uint64

    def count(batches):
        total = np.zeros(CELLS, dtype=kind)
        for ids in _texts(batches, k):
            cell, n = np.unique(_cells(grams(ids, k)[_possible(ids, k, parts.value)]), return_counts=True)
            total[cell] = np.minimum(total[cell] + n, least)
        total = total.reshape(-1, CELL_CHUNK)
        own = np.flatnonzero(total.any(axis=1))
        task = np.full(len(own), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(own, pa.int32()), "task": pa.array(task), "counts": pa.array([total[c].tobytes() for c in own], pa.binary())})

    def fold(batches):
        sums, most, teller = {}, {}, {}
        for batch in batches:
            for c, task, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = np.frombuffer(counts.as_buffer(), dtype=kind)
                if c not in sums:
                    sums[c], most[c], teller[c] = np.zeros(len(own), np.int64), np.zeros(len(own), kind), np.zeros(len(own), np.int32)
                sums[c] = np.minimum(least, sums[c] + own)
                teller[c][own > most[c]] = task
                most[c] = np.maximum(most[c], own)
        hot = {c: np.flatnonzero(s >= least) for c, s in sums.items()}
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array(list(hot), pa.int32()), "cells": pa.array([(h + c * CELL_CHUNK).astype(np.int32).tobytes() for c, h in hot.items()], pa.binary()),
            "tellers": pa.array([teller[c][h].tobytes() for c, h in hot.items()], pa.binary())})

    summed = map_arrow(map_arrow(texts, count, "chunk int, task int, counts binary").repartition(CELLS // CELL_CHUNK, "chunk"), fold, "chunk int, cells binary, tellers binary")
    rows = sorted(summed.collect())  # 8 bytes for each of CELLS at most
    return tuple(np.frombuffer(b"".join(r[i] for r in rows), np.int32) for i in (1, 2))


class Hot:
    """Hashed counters that reach the least count, each with the task that tells its phrases, and cut into ``fine`` counters."""

    def __init__(self, cells: np.ndarray, tellers: np.ndarray):
        self.cells, self.tellers = cells, tellers
        self.fine = max(1, min(FINE, 1 << (CELLS // max(1, len(cells))).bit_length() - 1))
        bits = np.zeros(CELLS, dtype=bool)
        bits[cells] = True
        self.bits = np.packbits(bits)

    def ranks(self, gram: np.ndarray) -> np.ndarray:
        """Places among ``cells`` of grams that have one."""
        return np.searchsorted(self.cells, _cells(gram).astype(np.int32))

    def fine_of(self, gram: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return rank * self.fine + ((gram * _MIX) >> np.uint64(40)).astype(np.int64) % self.fine


class _Names:
    """Phrases that a task names, each once as far as it keeps them."""

    def __init__(self):
        self.found, self.size, self.kept = [], 0, 0

    def _distinct(self):
        all_rows = np.concatenate(self.found)
        _, first, back = np.unique(_grams_of(all_rows), return_index=True, return_inverse=True)
        other = (all_rows != all_rows[first][back]).any(axis=1)  # another phrase under the same hash
        return np.concatenate((all_rows[first], np.unique(all_rows[other], axis=0)))

    def add(self, rows: np.ndarray):
        """Phrases to hand on, if there are too many to keep."""
        self.found.append(rows)
        self.size += len(rows)
        if self.size >= max(KNOWN, self.kept):
            self.found, self.size = [self._distinct()], 0
            self.kept = len(self.found[0])
            if self.kept >= KEPT:
                yield self.found[0]
                self.found, self.kept = [], 0

    def last(self):
        if self.found:
            yield self._distinct()


def _keys(phrases: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in phrases.astype(">u8")], pa.binary())


def candidates(texts: DataFrame, k: int, parts, cells, hot=None) -> DataFrame:
    """key: each possible phrase of ``k`` words whose hashed counter is in the set ``cells``, or, with ``hot``, whose fine
    counter is; as its numbers in big-endian bytes, once."""

    def run(batches):
        names = _Names()
        for ids in _texts(batches, k):
            at = _possible(ids, k, parts.value)
            gram = grams(ids, k)[at]
            if hot is None:
                at = at[has_bits(cells.value, _cells(gram))]
            else:
                inside = has_bits(hot.value.bits, _cells(gram))
                at, gram = at[inside], gram[inside]
                at = at[has_bits(cells.value, hot.value.fine_of(gram, hot.value.ranks(gram)))]
            for found in names.add(ids[at[:, None] + np.arange(k)]):
                yield pa.RecordBatch.from_arrays([_keys(found)], ["key"])
        for found in names.last():
            yield pa.RecordBatch.from_arrays([_keys(found)], ["key"])

    return map_arrow(texts, run, "key binary").distinct()


def tell(texts: DataFrame, k: int, parts, hot) -> DataFrame:
    """Rows (key) of possible phrases of ``k`` words, each named by the task that tells its hashed counter, if it has it; and
    rows (shard, width, counts) of all tasks' fine counters."""

    def named(found):
        return pa.RecordBatch.from_arrays([_keys(found), *(pa.nulls(len(found), t) for t in (pa.int32(), pa.int32(), pa.binary()))], ["key", "shard", "width", "counts"])

    def run(batches):
        names, own, total = _Names(), hot.value, np.zeros(len(hot.value.cells) * hot.value.fine, dtype=np.int64)
        told = own.tellers == TaskContext.get().partitionId()
        for ids in _texts(batches, k):
            at = _possible(ids, k, parts.value)
            gram = grams(ids, k)[at]
            inside = has_bits(own.bits, _cells(gram))
            at, gram = at[inside], gram[inside]
            rank = own.ranks(gram)
            np.add.at(total, own.fine_of(gram, rank), 1)
            at = at[told[rank]]
            for found in names.add(ids[at[:, None] + np.arange(k)]):
                yield named(found)
        for found in names.last():
            yield named(found)
        for batch in _shards(total):
            yield pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.binary()), *batch.columns], ["key", "shard", "width", "counts"])

    return map_arrow(texts, run, "key binary, shard int, width int, counts binary")


def unsettled(told: DataFrame, counted: list[DataFrame], hot, least: int) -> DataFrame:
    """bit: the fine counters that reach ``least`` without the phrases ``counted``, and so may hide another frequent one."""

    def add(batches):
        totals = {}
        for batch in batches:
            _sum_shards(batch.columns, totals)
        for shard, total in totals.items():
            own = np.flatnonzero(total >= least)
            yield pa.RecordBatch.from_pydict({"bit": pa.array(own + shard * SHARD, pa.int64()), "n": pa.array(total[own])})

    def taken(batches):
        for batch in batches:
            gram = batch.column(0).to_numpy().view(np.uint64)
            bit = hot.value.fine_of(gram, hot.value.ranks(gram))
            yield pa.RecordBatch.from_arrays([pa.array(bit), batch.column(1)], ["bit", "f"])

    out = map_arrow(told.where("shard IS NOT NULL").select("shard", "width", "counts").repartition("shard"), add, "bit long, n long")
    for part in counted:
        known = map_arrow(part.select("gram", "f"), taken, "bit long, f long").groupBy("bit").agg(F.sum("f").alias("f"))
        out = out.join(known, "bit", "left").select("bit", (F.col("n") - F.coalesce("f", F.lit(0))).alias("n"))
    return out.where(F.col("n") >= least).select("bit")


class Trie:
    """A double array over phrases of equal length: from state s, symbol c leads to base[s] + c where check there is s.

    State 0 is the root; symbols are places in the sorted ``alphabet``, from 1. ``phrase`` has the number of the phrase that
    a state accepts, or -1.
    """

    def __init__(self, phrases: np.ndarray):
        self.phrases = phrases = phrases[np.lexsort(phrases.T[::-1])]
        self.alphabet = np.unique(phrases)
        symbols = np.searchsorted(self.alphabet, phrases) + 1
        n, k = symbols.shape
        space = 2 * len(self.alphabet) + 2
        self.base, self.check = np.zeros(space, dtype=np.int64), np.full(space, -1, dtype=np.int64)
        self.check[0], self.free = -2, 1  # the root is nobody's child
        state = np.zeros(n, dtype=np.int64)
        for level in range(k):
            # children of each state: phrases are sorted, so equal prefixes are neighbours
            head = np.ones(n, dtype=bool)
            head[1:] = (state[1:] != state[:-1]) | (symbols[1:, level] != symbols[:-1, level])
            rows = np.flatnonzero(head)
            parent, child = state[rows], symbols[rows, level]
            first = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
            sizes = np.diff(np.append(first, len(parent)))
            slots = np.zeros(len(parent), dtype=np.int64)
            self.start = self.free
            for i in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())]:  # wide states first
                own = child[first[i] : first[i] + sizes[i]]
                base = self._place(own)
                self.base[parent[first[i]]] = base
                self.check[base + own] = parent[first[i]]
                slots[first[i] : first[i] + sizes[i]] = base + own
            single = first[sizes == 1]  # they fill the gaps, one after the other
            self._grow(self.free + len(single) + int((self.check[self.free :] != -1).sum()))
            gaps = self.free + np.flatnonzero(self.check[self.free :] == -1)[: len(single)]
            self.base[parent[single]], self.check[gaps], slots[single] = gaps - child[single], parent[single], gaps
            if len(gaps):
                self.free = int(gaps[-1]) + 1
            state = np.repeat(slots, np.diff(np.append(rows, n)))
        used = int(np.flatnonzero(self.check != -1)[-1]) + 1
        self.base, self.check = self.base[:used], self.check[:used]
        self.phrase = np.full(used, -1, dtype=np.int64)
        self.phrase[state] = np.arange(n)
        del self.free, self.start

    def _grow(self, need: int) -> None:
        if need > len(self.check):
            more = max(need, 2 * len(self.check)) - len(self.check)
            self.check = np.concatenate((self.check, np.full(more, -1, dtype=np.int64)))
            self.base = np.concatenate((self.base, np.zeros(more, dtype=np.int64)))

    def _place(self, own: np.ndarray) -> int:
        """A base at which all symbols ``own`` fall on free slots, not before the place where the last wide state was put."""
        offsets = own - own[0]
        while True:
            self._grow(self.start + 64 + int(offsets[-1]) + 1)
            slots = self.start + np.flatnonzero(self.check[self.start : self.start + 64] == -1)
            fits = np.flatnonzero((self.check[slots[:, None] + offsets] == -1).all(axis=1))
            if len(fits):
                return int(slots[fits[0]]) - int(own[0])
            self.start += 64

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        """Symbols of numbers; 0, which leads nowhere, for those not in the alphabet."""
        starts, shift, alphabet = self._starts
        place = starts.take((ids >> shift).astype(np.int64))
        behind = np.flatnonzero(alphabet.take(place) < ids)
        while len(behind):
            place[behind] += 1
            behind = behind[alphabet.take(place[behind]) < ids[behind]]
        found = (alphabet.take(place) == ids) & (place < len(self.alphabet))
        return np.where(found, place + 1, 0)

    @cached_property
    def _starts(self):
        """Where the numbers of each value of their first bits begin in the alphabet (numbers are hashes, so few share them), and the
        alphabet with an end."""
        bits = len(self.alphabet).bit_length() + 1
        shift = np.uint64(64 - bits)
        starts = np.searchsorted(self.alphabet, np.arange(1 << bits, dtype=np.uint64) << shift)
        return starts, shift, np.append(self.alphabet, np.uint64(2**64 - 1))

    def count(self, ids: np.ndarray, total: np.ndarray) -> None:
        """Adds to ``total`` how often each phrase occurs in ``ids``."""
        k = self.phrases.shape[1]
        if len(ids) < k:
            return
        symbol = self.symbols(ids)
        at = np.flatnonzero(symbol[: len(ids) - k + 1])
        state = np.zeros(len(at), dtype=np.int64)
        for level in range(k):
            c = symbol[at + level]
            to = self.base[state] + c
            ok = (c > 0) & (to >= 0) & (to < len(self.check))
            ok[ok] = self.check[to[ok]] == state[ok]
            at, state = at[ok], to[ok]
        total += np.bincount(self.phrase[state], minlength=len(total))


def _tries(batches):
    parts: dict[int, list] = {}
    for batch in batches:
        for part, key in zip(batch.column(0).to_pylist(), batch.column(1)):
            parts.setdefault(part, []).append(key.as_py())
    for part in sorted(parts):
        keys = parts.pop(part)
        t = Trie(np.frombuffer(b"".join(keys), dtype=">u8").astype(np.uint64).reshape(len(keys), -1))
        arrays = [a.astype(d).tobytes() for a, d in ((t.phrases, np.uint64), (t.alphabet, np.uint64), (t.base, np.int32), (t.check, np.int32), (t.phrase, np.int32))]
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "arrays": pa.array([arrays], pa.list_(pa.binary()))})


def _trie(arrays, k: int) -> Trie:
    t = Trie.__new__(Trie)
    phrases, t.alphabet, *rest = (np.frombuffer(a, dtype=d) for a, d in zip(arrays, (np.uint64, np.uint64, np.int32, np.int32, np.int32)))
    t.phrases = phrases.reshape(-1, k)
    t.base, t.check, t.phrase = (a.astype(np.int64) for a in rest)
    return t


def _shards(total: np.ndarray):
    """Rows (shard, width, counts) of counts by state: SHARD of them in a row, as narrow as the largest allows; none where all are 0."""
    rows = []
    for shard in range(-(-len(total) // SHARD)):
        counts = total[shard * SHARD : (shard + 1) * SHARD]
        most = int(counts.max())
        if most:
            width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
            rows.append((shard, width, counts.astype(f"<u{width}").tobytes()))
    shard, width, counts = zip(*rows) if rows else ((), (), ())
    yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int32()), "width": pa.array(width, pa.int32()), "counts": pa.array(counts, pa.binary())})


def _sum_shards(columns, totals: dict[int, np.ndarray]) -> None:
    """Adds columns (shard, width, counts) of ``_shards`` to ``totals``."""
    for shard, width, counts in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2]):
        counts = np.frombuffer(counts.as_py(), f"<u{width}").astype(np.int64)
        totals[shard] = totals[shard] + counts if shard in totals else counts


def count_phrases(texts: DataFrame, wanted: DataFrame, k: int, part_size: int = PART) -> DataFrame:
    """key, gram, f of each phrase of ``wanted`` (key) in the numbered ``texts``; one trie and one pass for each part."""
    spark = texts.sparkSession
    parts = max(1, -(-wanted.count() // part_size))
    placed = wanted.select(F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), "key")
    tries = stored(map_arrow(placed.repartition(parts, "part"), _tries, "part int, arrays array<binary>"), "tries")
    counted = []
    for part in range(parts):
        row = tries.where(F.col("part") == part).first()
        if row is None:
            continue
        shared = spark.sparkContext.broadcast([bytes(a) for a in row.arrays])  # about ``part_size`` phrases
        del row

        def run(batches, shared=shared):
            trie = _trie(shared.value, k)
            total = np.zeros(len(trie.phrases), dtype=np.int64)
            for ids in _texts(batches, k):
                trie.count(ids, total)
            yield from _shards(total)

        def add(batches, shared=shared):
            phrases, totals = np.frombuffer(shared.value[0], np.uint64).reshape(-1, k), {}
            for batch in batches:
                _sum_shards(batch.columns, totals)
            for shard, total in totals.items():
                own = np.flatnonzero(total)
                found = phrases[shard * SHARD + own]
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array([p.tobytes() for p in found.astype(">u8")], pa.binary()), "gram": pa.array(_grams_of(found).view(np.int64)), "f": pa.array(total[own])})

        shards = map_arrow(texts, run, "shard int, width int, counts binary").repartition("shard")
        counted.append(stored(map_arrow(shards, add, "key binary, gram long, f long"), "counted"))
        shared.destroy()
    out = counted[0] if counted else None
    for more in counted[1:]:
        out = out.unionByName(more)
    return out


def count_possible(texts: DataFrame, k: int, parts, least: int) -> DataFrame | None:
    """key, gram, f of phrases of ``k`` words, all those among them that occur ``least`` times or more."""
    spark = texts.sparkSession
    cells, tellers = enough(texts, k, parts, least)
    if not len(cells):
        return None
    hot = spark.sparkContext.broadcast(Hot(cells, tellers))
    told = stored(tell(texts, k, parts, hot), "told")
    named = told.where("key IS NOT NULL").select("key").distinct()
    counted = [c for c in [count_phrases(texts, named, k)] if c is not None]
    left = stored(unsettled(told, counted, hot, least), "unsettled")
    if left.limit(1).count():
        bits = spark.sparkContext.broadcast(hashed_set(left))
        rest = stored(candidates(texts, k, parts, bits, hot).join(named, "key", "left_anti"), "candidates")
        counted += [c for c in [count_phrases(texts, rest, k)] if c is not None]
        bits.destroy()
    hot.destroy()
    return counted[0].unionByName(counted[1]) if len(counted) == 2 else counted[0]


def _grams_of(phrases: np.ndarray) -> np.ndarray:
    out = phrases[:, 0].copy()
    for j in range(1, phrases.shape[1]):
        out = (out ^ (out >> np.uint64(31))) * _MIX + phrases[:, j] * _TURN
    return out


def _bit_set(frame: DataFrame):
    """The grams of ``frame`` as a broadcast set of fixed size."""
    return frame.sparkSession.sparkContext.broadcast(hashed_set(frame.select(F.col("gram").bitwiseAND(F.lit(SET_BITS - 1)).alias("bit"))))


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words that occur ``least`` times or more in a language, (key, k, f), and their words
    (key, lang, word, n) with the number of all words of the language."""
    for seed in range(1 << 16):
        numbered = stored(number_words(docs, seed), "numbered")
        rows = numbered.where("gram IS NOT NULL")
        counts = stored(rows.groupBy("gram").agg(F.sum("n").alias("f"), (F.min("proof") != F.max("proof")).alias("shared"), F.min("teller").alias("teller")).where(F.col("shared") | (F.col("f") >= least)), "words")
        if not counts.where("shared").limit(1).count():
            break
    spark = docs.sparkSession
    key = F.unhex(F.lpad(F.hex("gram"), 16, "0"))
    parts = _bit_set(counts)

    # Of the rows of a frequent word the one of its least teller spells it (a few others may slip through).
    told = spark.sparkContext.broadcast(hashed_set(counts.select(
        F.col("gram").bitwiseXOR(F.col("teller")).bitwiseAND(F.lit(SET_BITS - 1)).alias("bit"))))

    def wanted(batches):
        for batch in batches:
            gram, teller = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
            yield batch.filter(pa.array(has_bits(told.value, (gram ^ teller) & (SET_BITS - 1)))).select([0, 1, 2])

    seen = map_arrow(rows.select("gram", "lang", "word", "teller"), wanted, "gram long, lang binary, word binary").distinct()
    totals = bounded(rows.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.sum("n").alias("n")))
    words = stored(
        seen.join(counts, "gram").select(key.alias("key"), F.col("lang").cast("string").alias("lang"), F.col("word").cast("string").alias("word")).join(totals, "lang").select("key", "lang", "word", "n"), "vocabulary")
    texts = numbered.where("ids IS NOT NULL").select("ids")
    out = counts.select(key.alias("key"), F.lit(1).alias("k"), "f")
    for k in range(2, longest + 1):
        counted = count_possible(texts, k, parts, least)
        parts.destroy()
        if counted is None:
            break
        level = stored(counted.where(F.col("f") >= least), "phrases")
        out = out.unionByName(level.select("key", F.lit(k).alias("k"), "f"))
        if k < longest:
            parts = _bit_set(level)
    return out, words


def _salted(frame: DataFrame) -> DataFrame:
    return frame.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of 2 to ``longest`` words of each language of ``docs``
    (lang, text), scored floor(1000 a n / (l r)) at the cut that scores lowest; a phrase goes when a longer one with ``percent``
    of its count holds it."""
    found, words = frequent(docs, least, longest)
    long = found.where("k > 1")
    salt = F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int").alias("salt")
    # a longer phrase that holds this one has parts of one word more that do, and occur as often at least: one step is enough
    held = found.where("k > 2").select(F.explode(F.array(F.expr("substring(key, 1, 8 * (k - 1))"), F.expr("substring(key, 9)"))).alias("key"), F.col("f").alias("longer"))
    own = long.join(held.groupBy("key").agg(F.max("longer").alias("longer")), "key", "left")
    own = stored(own.where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("f"))).select("key", "k", F.col("f").alias("a")), "closed")
    spelled = (
        own.select("key", "k", "a", salt, F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("at"))
        .withColumn("part", F.expr("substring(key, 8 * at + 1, 8)"))
        .join(_salted(words.withColumnRenamed("key", "part")), ["part", "salt"])
        .groupBy("key", "a").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"), F.first("lang").alias("lang"), F.first("n").alias("n"))
        .select("key", "a", "lang", "n", F.array_join("words.word", " ").alias("phrase")))
    lookup = _salted(found.select(F.col("key").alias("part"), F.col("f").alias("part_f")))
    cuts = (
        own.select("key", "a", salt, F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
        .withColumn("part", F.expr("substring(key, 1, 8 * cut)")).join(lookup.withColumnRenamed("part_f", "l"), ["part", "salt"]).drop("part")
        .withColumn("part", F.expr("substring(key, 8 * cut + 1)")).join(lookup.withColumnRenamed("part_f", "r"), ["part", "salt"]).select("key", "cut", "l", "r"))
    whole = "decimal(19,0)"
    scored = (
        spelled.join(cuts, "key")
        .withColumn("score", F.expr(f"((1000 * cast(a as {whole})) * cast(n as {whole})) div (cast(l as {whole}) * cast(r as {whole}))"))
        .groupBy("key", "lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
