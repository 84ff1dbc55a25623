"""Exact nearest-neighbour join of two large sides, by pivots and the triangle inequality.

Items are placed, without a shuffle, by the nearest of a bounded set of pivots, and keep the distance to it. What is known of a
pivot's cell (its least and greatest distance, and its k least) bounds how near its items can be to a query, and how far
the k-th one is at most. Every query first meets the cell of its own pivot; the k-th distance found there then names the
few other cells that can still hold a nearer item, and only to those its vector goes. Cells of any size are cut into blocks.
Where vectors don't cluster that would be most of the cells: copies are counted first, and where there would be fewer of them in
one grid of all queries by all items, cut into a bounded number of chunks, both sides meet there.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators.blocks import BestMatches, vector_matrix
from nearfield.operators.knn import (
    BLOCK_ROWS,
    MAX_BROADCAST_BYTES,
    MAX_CHUNKS,
    VectorBlock,
    cell_grid_hits,
    flat_chunks,
    flat_grid_hits,
    top_hits,
)
from nearfield.session import cut_lineage

MAX_PIVOTS = 2048
# Bounds are taken this much wider, relative to the lengths at hand, for what rounding may cost.
SLACK = 1e-6


def choose_pivots(items: DataFrame, pivots: int | None = None) -> VectorBlock:
    """At most ``pivots`` items as pivots, the first ones by a hash of their id; by default the square root of their number.

    Only items without a missing vector can serve; pivots of equal vectors count once.
    """
    n = items.count()
    wanted = min(MAX_PIVOTS, max(1, math.isqrt(n)) if pivots is None else max(1, pivots))
    rows = items.select(F.col("embedding").alias("vector")).orderBy(F.xxhash64("image_id"), "image_id").limit(wanted).toArrow()
    vectors = vector_matrix(rows["vector"])
    if vectors.nbytes > MAX_BROADCAST_BYTES:
        vectors = vectors[: max(1, MAX_BROADCAST_BYTES // (vectors.nbytes // len(vectors)))]
    vectors = np.unique(vectors, axis=0) if len(vectors) else vectors
    return VectorBlock(np.arange(len(vectors)), vectors)


def place_items(items: DataFrame, pivots: VectorBlock) -> DataFrame:
    """image_id, embedding, cell, gap: each item by its nearest pivot and the distance to it."""
    shared = items.sparkSession.sparkContext.broadcast((pivots.ids, pivots.vectors))

    def place(batches):
        ids, vectors = shared.value
        for batch in batches:
            if batch.num_rows:
                best = BestMatches(vector_matrix(batch.column(1)), 1)
                best.update(vectors, ids)
                _, square, cell = best.result()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(np.sqrt(square))], names=["image_id", "embedding", "cell", "gap"])

    return items.select("image_id", "embedding").mapInArrow(place, f"image_id bigint, embedding {dict(items.dtypes)['embedding']}, cell bigint, gap double")


def cell_bounds(placed: DataFrame, k: int) -> dict[int, tuple[float, list[float], int]]:
    """For each cell that has items its greatest gap, its k least ones, ascending, and how many items it has: at most k + 2
    numbers for each pivot."""
    near = placed.select("cell", "gap", F.row_number().over(Window.partitionBy("cell").orderBy("gap")).alias("place")).where(F.col("place") <= k)
    least = near.groupBy("cell").agg(F.sort_array(F.collect_list("gap")).alias("least"))
    rows = placed.groupBy("cell").agg(F.max("gap").alias("most"), F.count(F.lit(1)).alias("n")).join(least, "cell").collect()
    return {r.cell: (r.most, list(r.least), r.n) for r in rows}


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all vectors to all pivots, and what they may be off by."""
    a, b = vectors.astype(np.float64), pivots.astype(np.float64)
    if a.shape[1] != b.shape[1]:
        raise ValueError("queries and items differ in dimension")
    left, right = np.square(a).sum(axis=1), np.square(b).sum(axis=1)
    far = np.sqrt(np.maximum(left[:, None] + right[None, :] - 2.0 * (a @ b.T), 0.0))
    return far, SLACK * (np.sqrt(left) + np.sqrt(right.max()))


def _share_bounds(spark, pivots: VectorBlock, bounds: dict):
    cells = np.array(sorted(bounds), dtype=np.int64)
    return spark.sparkContext.broadcast((
        cells, pivots.vectors[cells], np.array([bounds[c][1][0] for c in cells.tolist()]), np.array([bounds[c][0] for c in cells.tolist()]),
        [np.array(bounds[c][1]) for c in cells.tolist()]))


def _open_cells(far, slack, own, most, least, greatest) -> np.ndarray:
    """For each query the cells, other than its own, that can hold an item as near as ``most``."""
    nearest = np.maximum(far - greatest[None, :], least[None, :] - far) - slack[:, None]
    open_cells = nearest <= most[:, None]
    open_cells[np.arange(len(own)), own] = False
    return open_cells


def _slices(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            yield whole.slice(at, 1024)


def _visits(queries: DataFrame, pivots: VectorBlock, bounds: dict, k: int, first: bool) -> DataFrame:
    """query_id, embedding, cell (and ``most``, a bound of the k-th distance): the own cell of every query, or with its bound
    ``most`` all others that can hold an item as near as that."""
    shared = _share_bounds(queries.sparkSession, pivots, bounds)

    def visit(batches):
        names, vectors, least, greatest, gaps = shared.value
        for batch in _slices(batches):
            far, slack = _distances(vector_matrix(batch.column(1)), vectors)
            own = far.argmin(axis=1)
            if first:
                upper = np.full((len(own), 0), np.inf)
                for c in range(len(names)):  # the k least sums of a distance and a gap so far
                    upper = np.concatenate((upper, far[:, c, None] + gaps[c][None, :]), axis=1)
                    if upper.shape[1] > 4 * k or c == len(names) - 1:
                        upper = np.partition(upper, k - 1, axis=1)[:, :k] if upper.shape[1] > k else upper
                most = upper.max(axis=1) + slack if upper.shape[1] >= k else np.full(len(own), np.inf)
                row, cell = np.arange(len(own)), own
            else:
                most = batch.column(2).to_numpy(zero_copy_only=False)
                row, cell = np.nonzero(_open_cells(far, slack, own, most, least, greatest))
            out = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [out.column(0), out.column(1), pa.array(names[cell]), pa.array(most[row], pa.float64())], names=["query_id", "embedding", "cell", "most"])

    columns = ["query_id", "embedding", *([] if first else ["most"])]
    return queries.select(*columns).mapInArrow(visit, f"query_id bigint, embedding {dict(queries.dtypes)['embedding']}, cell bigint, most double")


def _copies(queries: DataFrame, pivots: VectorBlock, bounds: dict, block_rows: int) -> int:
    """How often vectors of queries (query_id, embedding, most) would be copied to visit the cells that are open to them."""
    shared = _share_bounds(queries.sparkSession, pivots, bounds)
    chunks = np.array([min(MAX_CHUNKS, -(-bounds[c][2] // block_rows)) for c in sorted(bounds)], dtype=np.int64)

    def count(batches):
        _, vectors, least, greatest, _ = shared.value
        total = 0
        for batch in _slices(batches):
            far, slack = _distances(vector_matrix(batch.column(1)), vectors)
            total += int((_open_cells(far, slack, far.argmin(axis=1), batch.column(2).to_numpy(zero_copy_only=False), least, greatest) @ chunks).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n"])

    return queries.select("query_id", "embedding", "most").mapInArrow(count, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def pivot_hits(queries: DataFrame, items: DataFrame, k: int, *, pivots: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Partial hits (query_id, image_id, distance) that hold the k nearest items of each query; queries (query_id, embedding) and
    items (image_id, embedding) of any size. A query that has fewer than k items to find meets all cells."""
    queries = queries.select(F.col("query_id").cast("long"), "embedding")
    items = items.select(F.col("image_id").cast("long"), "embedding")
    chosen = choose_pivots(items, pivots)
    if not len(chosen):
        return queries.sparkSession.createDataFrame([], "query_id bigint, image_id bigint, distance double")
    placed = cut_lineage(place_items(items, chosen))
    bounds = cell_bounds(placed, k)
    inside = placed.select("image_id", "embedding", "cell")
    start = cut_lineage(_visits(queries, chosen, bounds, k, True))
    found = cut_lineage(top_hits(cell_grid_hits(start, inside, k, block_rows), k))
    reached = found.where(F.col("rank") == k).select("query_id", F.sqrt("distance").alias("reached"))
    known = start.join(reached, "query_id", "left")
    slack = 1 + SLACK
    known = known.select("query_id", "embedding", F.least("most", F.col("reached") * slack).alias("most"))
    (n_queries, query_chunks), (n_items, item_chunks) = flat_chunks(queries, block_rows), flat_chunks(items, block_rows)
    if _copies(known, chosen, bounds, block_rows) > n_queries * item_chunks + n_items * query_chunks:
        return flat_grid_hits(queries, items, k, block_rows)
    more = _visits(known, chosen, bounds, k, False)
    others = cell_grid_hits(cut_lineage(more), inside, k, block_rows)
    return found.select("query_id", "image_id", "distance").unionAll(others.select("query_id", "image_id", "distance"))
