"""Exact top-k search over an impact-ordered index, score at a time.

Vectors become integers (floor of 64 times each component, by default). The index cuts them into blocks and holds, for each
block, posting segments: the vectors whose component in one dimension has one quantised impact (its magnitude, by
powers of two). A block meets all queries of a group: segments are worked off from the highest impact down, each adding
its exact contributions to the scores so far. What the remaining segments can still add is bounded by the norms of the
query and of the vector's remaining components. Work on a block stops when that bound proves nearly all vectors of the
block out of a query's k best; the possible members are then scored exactly.

Nulls: a vector that is null, holds a null or non-finite component, or has no id takes no part. Rows with one id count
once, with their smallest vector. Vectors of different lengths don't meet. Ties go to the smaller id. Fewer than k
others give fewer rows. Empty tables give no rows. Extra columns are not looked at.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import map_arrow, stored

SCALE, K = 64, 20
#: Vectors of an index block, queries of a group, and queries worked on at once.
BLOCK, GROUP, SLICE = 4096, 4096, 256
_PAIRS = 50_000


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(F.col("vec_id").isNotNull() & x.isNotNull() & fine)
    return known.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrices(batches, scale: int):
    """(key, ids, integer matrix) of runs of rows with the same key (first column) and vector length."""
    held, now = [], None
    for batch in batches:
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        flat = batch.column(2).flatten().to_numpy()
        ends = np.cumsum(sizes)
        for i, (key, vec_id) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if now != (key, int(sizes[i])):
                if held:
                    yield _matrix(now, held)
                held, now = [], (key, int(sizes[i]))
            held.append((vec_id, np.floor(flat[ends[i] - sizes[i] : ends[i]] * scale)))
    if held:
        yield _matrix(now, held)


def _matrix(now, held):
    m = np.stack([v for _, v in held]) if now[1] else np.zeros((len(held), 0))
    if m.size and np.abs(m).max() ** 2 * max(1, m.shape[1]) >= 2.0**62:
        raise ValueError("components are too large for 64-bit scores")
    return now[0], np.array([i for i, _ in held], dtype=np.int64), m.astype(np.int64)


def segments(m: np.ndarray):
    """Posting segments of a block by falling impact: level, dimension, first posting; then the postings' vectors and values."""
    row, dim = np.nonzero(m)
    value = m[row, dim]
    level = np.frexp(np.abs(value).astype(np.float64))[1]  # |value| < 2 ** level
    order = np.lexsort((row, dim, -level))
    row, dim, value, level = row[order], dim[order], value[order], level[order]
    first = np.flatnonzero(np.concatenate(([len(row) > 0], (level[1:] != level[:-1]) | (dim[1:] != dim[:-1])))) if len(row) else np.zeros(0, np.int64)
    return level[first].astype(np.int32), dim[first].astype(np.int32), first.astype(np.int64), row.astype(np.int32), value.astype(np.int64)


def build_index(vectors: DataFrame, blocks: int, scale: int = SCALE) -> DataFrame:
    """One row for each block and vector length: block, dims, ids, and its posting segments."""
    names = ["level", "dim", "first", "doc", "impact"]

    def run(batches):
        for key, ids, m in _matrices(batches, scale):
            parts = dict(zip(names, segments(m)))
            yield pa.RecordBatch.from_pydict({"block": pa.array([key], pa.int64()), "dims": pa.array([m.shape[1]], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary())}
                                             | {n: pa.array([parts[n].tobytes()], pa.binary()) for n in names})

    placed = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), "vec_id", "embedding")
    placed = placed.repartition("block").sortWithinPartitions("block", F.size("embedding"), "vec_id")
    return map_arrow(placed, run, "block long, dims int, ids binary, level binary, dim binary, first binary, doc binary, impact binary")


def _grouped(queries: DataFrame, groups: int, scale: int) -> DataFrame:
    def run(batches):
        for key, ids, m in _matrices(batches, scale):
            yield pa.RecordBatch.from_pydict({"group": pa.array([key], pa.int64()), "dims": pa.array([m.shape[1]], pa.int32()), "query_ids": pa.array([ids.tobytes()], pa.binary()), "query": pa.array([m.tobytes()], pa.binary())})

    placed = queries.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).alias("g"), "vec_id", "embedding")
    placed = placed.repartition("g").sortWithinPartitions("g", F.size("embedding"), "vec_id")
    return map_arrow(placed, run, "group long, dims int, query_ids binary, query binary")


def block_topk(ids, level, dim, first, doc, impact, query_ids, q, k: int = K):
    """(query id, id, score) of each query's ``k`` best vectors of a block, itself left out."""
    n, dims = len(ids), q.shape[1]
    ends = np.concatenate((first[1:], [len(doc)])) if len(first) else first
    # The block's vectors again, for exact scores, and the squared norms of what lies below each level.
    m = np.zeros((n, dims), np.int64)
    for d, a, b in zip(dim, first, ends):
        m[doc[a:b], d] = impact[a:b]
    levels = sorted(set(level.tolist()), reverse=True)
    rest = {x: np.zeros(n) for x in levels}
    per_level = {x: np.zeros(n) for x in levels}
    for x, a, b in zip(level.tolist(), first, ends):
        np.add.at(per_level[x], doc[a:b], impact[a:b].astype(np.float64) ** 2)
    below = np.zeros(n)
    for x in reversed(levels):
        rest[x] = np.sqrt(below)
        below = below + per_level[x]
    small = not m.size or not q.size or int(np.abs(m).max()) * int(np.abs(q).max()) * dims < 2**31
    kind = np.int32 if small else np.int64
    impact = impact.astype(kind)
    order = np.argsort(ids, kind="stable")
    for at in range(0, len(q), SLICE):
        part, part_ids = q[at : at + SLICE], query_ids[at : at + SLICE]
        by_dim = np.ascontiguousarray(part.T).astype(kind)
        norm = np.sqrt((part.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12)
        score = np.zeros((n, len(part)), kind)
        place = order[np.searchsorted(ids, part_ids, sorter=order).clip(max=n - 1)]
        own = np.flatnonzero(ids[place] == part_ids)
        possible = np.ones((n, len(part)), bool)
        s = 0
        for x in levels:
            while s < len(level) and level[s] == x:
                a, b = first[s], ends[s]
                score[doc[a:b]] += impact[a:b, None] * by_dim[dim[s]][None, :]
                s += 1
            slack = rest[x][:, None] * norm[None, :]
            slack *= 1 + 1e-9
            low = score - slack
            low[place[own], own] = -np.inf
            if n > k + 1:
                least = np.partition(low, n - k, axis=0)[n - k]  # k vectors reach this at least
                possible = score + slack >= least[None, :]
            if possible.sum() <= 4 * k * len(part):
                break
        possible[place[own], own] = False
        vector, query = np.nonzero(possible)
        exact = np.empty(len(vector), np.int64)
        for a in range(0, len(vector), _PAIRS):
            exact[a : a + _PAIRS] = np.einsum("ij,ij->i", m[vector[a : a + _PAIRS]], part[query[a : a + _PAIRS]])
        best = np.lexsort((ids[vector], -exact, query))
        query, vector, exact = query[best], vector[best], exact[best]
        begin = np.searchsorted(query, np.arange(len(part)))
        keep = np.arange(len(query)) - begin[query] < k
        yield part_ids[query[keep]], ids[vector[keep]], exact[keep]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of ``vectors`` for each of ``queries`` (both vec_id, embedding).

    Each index block meets each group of queries once, keyed by both; what comes back is k rows for a query and block.
    """
    known = stored(valid_vectors(vectors), "vectors")
    asked = stored(valid_vectors(queries), "queries")
    blocks, groups = 1 + known.count() // BLOCK, 1 + asked.count() // GROUP
    index = stored(build_index(known, blocks, scale), "impact-index").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    questions = _grouped(asked, groups, scale).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    met = index.join(questions, ["group", "block", "dims"])
    binary = ["ids", "level", "dim", "first", "doc", "impact", "query_ids", "query"]
    kinds = dict(zip(binary, (np.int64, np.int32, np.int32, np.int64, np.int32, np.int64, np.int64, np.int64)))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = {c: np.frombuffer(batch.column(j + 1)[i].as_buffer(), dtype=kinds[c]) for j, c in enumerate(binary)}
                q = x.pop("query").reshape(len(x["query_ids"]), batch.column(0)[i].as_py())
                for query_id, vec_id, score in block_topk(*(x[c] for c in binary[:-1]), q, k):
                    yield pa.RecordBatch.from_arrays([pa.array(query_id), pa.array(vec_id), pa.array(score)], ["query_id", "vec_id", "score"])

    found = map_arrow(met.select("dims", *binary), run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """The ``k`` best other vectors of every vector whose id is divisible by ``every``."""
    return search(vectors, vectors.where(F.col("vec_id") % every == 0), k)
