"""Periodic runs of words: stretches that repeat themselves at a distance, found by block convolution.

At each dyadic scale B the words are cut into aligned blocks of B. A number theoretic transform correlates a block with the
window that follows it, modulo a prime that no sum of squared differences reaches, so the differences are exact integers;
each distance at which they are zero is a seed. Scale B has the distances q with B <= (3q + 1) / 2 < 2B: a run of period q
and length 4q (six words where q is 1) always holds an aligned block and its copy q words on, so no run is missed. Words are
numbered exactly; blocks compare hashed numbers small enough for the prime, and every seed is then extended over the exact
ones, which drops what only the hash made equal. Many documents stand side by side in one array, parted by numbers of their own.

Nulls: a null text has no words; a null doc_id is carried along. Empty texts have no runs. Texts of any length are searched
whole: the largest block grows with the text, 32 million words at most, which is beyond the longest string. Ties for the
first run: the smallest start, then the smallest period. Repeated rows each give their row. Empty tables give no rows. Only
doc_id and text are looked at, whatever other columns there are.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import map_arrow

#: A prime of the form 7 * 2**26 + 1, below 2**29, and a generator of its group.
P, GENERATOR = 469_762_049, 3
#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Words searched side by side, and numbers transformed at a time.
GROUP_WORDS, SLAB = 1 << 17, 1 << 17
_P = np.uint64(P)
_roots: dict[tuple[int, bool], np.ndarray] = {}


def _powers(half: int, inverse: bool) -> np.ndarray:
    """The first ``half`` powers of a root of unity of order 2 * half."""
    if (half, inverse) not in _roots:
        root = pow(GENERATOR, (P - 1) // (2 * half), P)
        root = pow(root, P - 2, P) if inverse else root
        out = np.ones(half, dtype=np.uint64)
        have = 1
        while have < half:
            out[have : 2 * have] = out[:have] * np.uint64(pow(root, have, P)) % _P
            have *= 2
        if half > 1 << 16:
            return out
        _roots[half, inverse] = out
    return _roots[half, inverse]


def transform(x: np.ndarray) -> np.ndarray:
    """Number theoretic transform of each column of ``x`` (numbers below P), rows in bit-reversed order."""
    n = len(x)
    half = n // 2
    while half:
        parts = x.reshape(n // (2 * half), 2, half, -1)
        out = np.empty_like(parts)
        np.add(parts[:, 0], parts[:, 1], out=out[:, 0])
        np.minimum(out[:, 0], out[:, 0] - _P, out=out[:, 0])  # below P again: the difference wraps where the sum is below P
        out[:, 1] = (parts[:, 0] + (_P - parts[:, 1])) * _powers(half, False)[None, :, None] % _P
        x = out.reshape(n, -1)
        half //= 2
    return x


def inverse(x: np.ndarray) -> np.ndarray:
    """Undoes ``transform``."""
    n = len(x)
    half = 1
    while half < n:
        parts = x.reshape(n // (2 * half), 2, half, -1)
        turned = parts[:, 1] * _powers(half, True)[None, :, None] % _P
        out = np.empty_like(parts)
        np.add(parts[:, 0], turned, out=out[:, 0])
        np.add(parts[:, 0], _P - turned, out=out[:, 1])
        np.minimum(out, out - _P, out=out)
        x = out.reshape(n, -1)
        half *= 2
    return x * np.uint64(pow(n, P - 2, P)) % _P


def distances(block: int) -> tuple[int, int]:
    """The first and the last distance of a scale; none where the last is smaller."""
    return max(1, -(-(2 * block - 1) // 3)), (4 * block - 2) // 3


def zero_mismatches(values: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (start, distance) where the ``block`` words from ``start`` and those from start + distance have no squared
    difference. ``values`` are below the square root of P / block, with 2 * block + distance more after the last start."""
    low, high = distances(block)
    size, lags = 2 * block, high - low + 1
    squares = np.concatenate(([0], np.cumsum(values.astype(np.int64) ** 2)))
    found_at, found_q = [], []
    step = max(1, SLAB // size)
    for at in range(0, len(starts), step):
        own = starts[at : at + step]
        x = np.zeros((size, len(own)), dtype=np.uint64)
        back = np.zeros(block, dtype=np.int64)
        back[1:] = size - np.arange(1, block)
        x[back] = values[own[None, :] + np.arange(block)[:, None]]
        y = values[own[None, :] + (low + np.arange(size))[:, None]]
        cross = inverse(transform(x) * transform(y) % _P)[:lags].astype(np.int64)
        shift = own[None, :] + (low + np.arange(lags))[:, None]
        gaps = (squares[own + block] - squares[own])[None, :] + squares[shift + block] - squares[shift] - 2 * cross
        lag, column = np.nonzero(gaps == 0)
        found_at.append(own[column])
        found_q.append(lag + low)
    if not found_at:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_at), np.concatenate(found_q)


def _stretch(ids: np.ndarray, at: int, q: int, first: int, last: int) -> tuple[int, int]:
    """The widest [start, end) around ``at`` within [first, last) in which words ``q`` apart are equal, from words that are
    known to be equal to those q on at ``at``; empty where they are not."""
    end, step = at, 16
    while end < last - q:
        stop = min(last - q, end + step)
        bad = np.flatnonzero(ids[end:stop] != ids[end + q : stop + q])
        if len(bad):
            end += int(bad[0])
            break
        end, step = stop, step * 4
    if end == at:
        return at, at
    start, step = at, 16
    while start > first:
        stop = max(first, start - step)
        bad = np.flatnonzero(ids[stop:start] != ids[stop + q : start + q])
        if len(bad):
            start = stop + int(bad[-1]) + 1
            break
        start, step = stop, step * 4
    return start, end + q


def find_runs(ids: np.ndarray, edges: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of the pieces of ``ids`` between consecutive ``edges``, ascending by start and period."""
    sizes = np.diff(edges)
    longest = int(sizes.max(initial=0))
    runs: dict[tuple[int, int], int] = {}
    if longest < LEAST_WORDS:
        return []
    reach = np.zeros(len(ids) + 1, dtype=np.int64)  # for each word the end of a known run that holds it, and its period
    period = np.ones(len(ids) + 1, dtype=np.int64)
    block = 2
    while LEAST_TIMES * distances(block)[0] <= longest:
        low, high = distances(block)
        wide = sizes >= max(LEAST_WORDS, LEAST_TIMES * low)
        starts = np.arange(0, len(ids), block)
        piece = np.searchsorted(edges, starts, side="right") - 1
        starts = starts[wide[piece] & (starts + block + low <= edges[piece + 1])]
        bits = ((P // block).bit_length() - 1) // 2
        values = np.zeros(len(ids) + 4 * block + high, dtype=np.uint64)
        values[: len(ids)] = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        at, q = zero_mismatches(values, starts, block)
        piece = np.searchsorted(edges, at, side="right") - 1
        inside = at + block + q <= edges[piece + 1]
        at, q = at[inside], q[inside]
        order = np.lexsort((at, q))
        at, q = at[order], q[order]
        while len(at):
            known = (reach[at] >= at + block + q) & (q % period[at] == 0)
            at, q = at[~known], q[~known]
            if not len(at):
                break
            # the first seed of each distance that no known run explains, and those that lie in its stretch with it
            heads = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]) | (at[1:] - at[:-1] > block))))
            gone = np.zeros(len(at), dtype=bool)
            for i, j in zip(heads.tolist(), np.append(heads[1:], len(at)).tolist()):
                a, d = int(at[i]), int(q[i])
                k = int(np.searchsorted(edges, a, side="right")) - 1
                start, end = _stretch(ids, a, d, int(edges[k]), int(edges[k + 1]))
                gone[i : max(i + 1, i + int(np.searchsorted(at[i:j], end - d - block, side="right")))] = True
                if end - start >= max(LEAST_WORDS, LEAST_TIMES * d) and runs.get((start, end), d + 1) > d:
                    runs[start, end] = d
                    own = reach[start:end] < end
                    reach[start:end][own] = end
                    period[start:end][own] = d
            at, q = at[~gone], q[~gone]
        block *= 2
    return sorted((start, end - start, d) for (start, end), d in runs.items())


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words are in a run after its first period."""
    ends = np.zeros(n + 1, dtype=np.int64)
    for start, length, q in runs:
        ends[start + q] += 1
        ends[start + length] -= 1
    return np.cumsum(ends)[:n] > 0


def _groups(texts):
    """The words of each text, in lists of about GROUP_WORDS words."""
    out, size = [], 0
    for text in texts:
        words = [] if text is None else text.split()
        out.append(words)
        size += len(words) + 1
        if size >= GROUP_WORDS:
            yield out
            out, size = [], 0
    if out:
        yield out


def _search(batches):
    for batch in batches:
        starts, lengths, periods, counts, kept, sizes = [], [], [], [], [], []
        for group in _groups(t.as_buffer().to_pybytes() if t.is_valid else None for t in batch.column(1).cast(pa.binary())):
            numbers: dict[bytes, int] = {}
            edges, ids = [0], []
            for words in group:
                ids += [numbers.setdefault(w, len(numbers)) for w in words]
                edges.append(len(ids))
            runs = find_runs(np.array(ids, dtype=np.int64), np.array(edges, dtype=np.int64))
            at = 0
            for words, first, last in zip(group, edges, edges[1:]):
                own = []
                while at < len(runs) and runs[at][0] < last:
                    own.append((runs[at][0] - first, *runs[at][1:]))
                    at += 1
                if own:
                    words = [w for w, gone in zip(words, dropped(len(words), own).tolist()) if not gone]
                starts += [r[0] for r in own]
                lengths += [r[1] for r in own]
                periods += [r[2] for r in own]
                counts.append(len(own))
                sizes.append(last - first)
                kept.append(b" ".join(words))
        spans = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (starts, lengths, periods)], ["start", "length", "period"])
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, spans), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the text ``collapsed`` to words that aren't in
    a run after its first period, for every row of ``docs`` (doc_id, text). Words are split at ASCII white space."""
    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(docs.select("doc_id", "text"), _search, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text of ``docs``; in a tenth of them, chosen by the crc32 of doc_id, the words from a place on repeat."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h, n = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.size("w")
    g = F.expr("h div 10")
    a = F.expr("(h div 10) % n")
    p = F.expr("1 + (n - (h div 10) % n) div (3 + (h div 10) % 8)")
    marked = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), words))
    sized = marked.withColumn("n", F.coalesce(n, F.lit(0)).cast("long")).withColumn("g", g).withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", F.when(F.col("n") > 0, p))
    moved = F.expr("array_join(transform(sequence(0L, n - 1), i -> w[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return sized.select("doc_id", F.when(F.col("n") > 0, moved).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """One row of numbers and digests for each document of ``periodic_runs``."""
    first = F.reduce(
        "runs", F.lit(None).cast("struct<start: long, length: long, period: long>"),
        lambda m, r: F.when(m.isNull() | (r["length"].cast("decimal(19,0)") * m["period"] > m["length"].cast("decimal(19,0)") * r["period"]), r).otherwise(m))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    best = found.withColumn("best", first)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"))
