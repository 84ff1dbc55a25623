"""Exact nearest-neighbour joins.

Three ways to meet queries and items, chosen by the size of the query set:

* few items on the right (centroids, prototypes): items are broadcast and each
  query row is answered where it lies, without a shuffle;
* few queries on the left: queries are broadcast, items are scanned in place,
  each task emits at most k hits per query;
* both large: queries meet the items of those pivots (``pivots``) that can hold
  one of their nearest, in blocks of bounded size. A cell holding most of the
  rows is just split into more blocks.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions.vectors import SCORE_STEEPNESS, SCORE_THRESHOLD, sigmoid_score
from nearfield.operators.blocks import BestMatches, positions, vector_matrix
from nearfield.operators.bounds import bounded
from nearfield.session import cut_lineage

MAX_BROADCAST_ROWS = 8192
MAX_BROADCAST_BYTES = 64 << 20
# Rows of one side of a grid block; 16k vectors of 2048 floats are 128 MiB.
BLOCK_ROWS = 16384
# A side is cut into no more chunks than this, so that each row is copied no more often: blocks grow with
# larger sides, until a chunk holds CHUNK_FLOATS (16 MiB) of vectors.
MAX_CHUNKS = 16
CHUNK_FLOATS = 1 << 22
# A scan estimated below this many bytes per core is spread over all cores.
SPREAD_BYTES_PER_CORE = 8 << 20
# Query blocks that are worth a scan of all items each; for more of them both sides meet in a grid.
MAX_SCANS = 64

# Cells that a scan is told by name; beyond, the table of probes prunes it as it runs.
MAX_NAMED_CELLS = 10_000

# A hit in a hash table, generously.
HIT_BYTES = 64

HIT_SCHEMA = "query_id bigint, image_id bigint, distance double"


@dataclass
class VectorBlock:
    """A bounded set of keyed vectors held as one matrix."""

    ids: np.ndarray
    vectors: np.ndarray

    def __len__(self):
        return len(self.ids)


def collect_block(df: DataFrame, key: str, vector: str, max_rows: int = MAX_BROADCAST_ROWS):
    """The rows of ``df`` as one block, or None when they exceed the bound."""
    if max_rows <= 0:
        return None
    table = df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector")).limit(
        max_rows + 1
    ).toArrow()
    if table.num_rows > max_rows:
        return None
    vectors = vector_matrix(table["vector"])
    if vectors.nbytes > MAX_BROADCAST_BYTES:
        return None
    return VectorBlock(table["key"].to_numpy(), vectors)


def lay_out(df: DataFrame, key: str) -> DataFrame:
    """``df`` in as many tasks as suit a scan.

    A small input that would be read as one or two tasks is spread over all
    cores. A large one keeps the splits of its scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate < cores * SPREAD_BYTES_PER_CORE:
        return df.repartition(cores, key)
    return df


def top_hits(hits: DataFrame, k: int, group: str = "query_id", value: str = "distance",
             item: str = "image_id", descending: bool = False) -> DataFrame:
    """The k best rows of each group with their rank; ties go to the smaller item."""
    best_first = F.desc(value) if descending else F.asc(value)
    window = Window.partitionBy(group).orderBy(best_first, F.asc(item))
    return hits.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def nearest_in_block(left: DataFrame, block: VectorBlock, k: int, metric: str, *,
                     left_key: str, left_vector: str, right_name: str, value_name: str,
                     right_type: str = "bigint", keep_vector: bool = False) -> DataFrame:
    """The k best block members of every left row with their rank, without a shuffle."""
    shared = left.sparkSession.sparkContext.broadcast((block.ids, block.vectors))

    def match(batches):
        ids, vectors = shared.value
        for batch in batches:
            if batch.num_rows == 0 or len(ids) == 0:
                continue
            best = BestMatches(vector_matrix(batch.column(1)), k, metric)
            best.update(vectors, ids)
            rows, value, right = best.result()
            out = batch.take(pa.array(rows))
            columns = [out.column(0), pa.array(right), pa.array(value), pa.array(positions(rows))]
            names = ["left_key", "right_key", "value", "rank"]
            if keep_vector:
                columns.append(out.column(1))
                names.append("vector")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    vector = F.col(left_vector).cast("array<float>") if keep_vector else F.col(left_vector)
    narrow = left.select(F.col(left_key).cast("long"), vector)
    schema = "left_key bigint, right_key bigint, value double, rank int"
    schema += ", vector array<float>" if keep_vector else ""
    matched = narrow.mapInArrow(match, schema)
    return matched.select(
        F.col("left_key").alias(left_key),
        F.col("right_key").cast(right_type).alias(right_name),
        F.col("value").alias(value_name),
        "rank",
        *([F.col("vector").alias(left_vector)] if keep_vector else []),
    )


def _scan_items(block: VectorBlock, items: DataFrame, k: int, probes: dict | None) -> DataFrame:
    """Partial hits of a broadcast query block against items scanned in place."""
    shared = items.sparkSession.sparkContext.broadcast((block.ids, block.vectors, probes))

    def scan(batches):
        query_ids, queries, probe_rows = shared.value
        best = BestMatches(queries, k)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vectors = vector_matrix(batch.column(1))
            if probe_rows is None:
                best.update(vectors, ids)
                continue
            cells = batch.column(2).to_numpy(zero_copy_only=False)
            for cell in np.unique(cells):
                if cell in probe_rows:
                    inside = cells == cell
                    best.update(vectors[inside], ids[inside], probe_rows[cell])
        rows, distance, found = best.result()
        yield pa.RecordBatch.from_arrays(
            [pa.array(query_ids[rows]), pa.array(found), pa.array(distance)],
            names=["query_id", "image_id", "distance"],
        )

    return items.mapInArrow(scan, HIT_SCHEMA)


def _few(hits: DataFrame, block: VectorBlock, k: int) -> DataFrame:
    """Mark the hits of a counted query block to travel where they fit the
    bound: joining them to the items then leaves the items in place."""
    return F.broadcast(hits) if len(block) * k * HIT_BYTES <= MAX_BROADCAST_BYTES else hits


def _chunk_count(rows, block_rows: int, floats):
    """Chunks of a side of ``rows`` vectors of ``floats`` numbers."""
    floats = F.greatest(F.lit(1), F.coalesce(floats, F.lit(1)))
    most = F.greatest(F.lit(MAX_CHUNKS), F.ceil(rows * floats / CHUNK_FLOATS))
    return F.greatest(F.lit(1), F.least(F.ceil(rows / block_rows), most)).cast("int")


def _match_grid(queries: DataFrame, items: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Partial hits of rows that carry their cell's query_chunks and item_chunks."""
    left = queries.select(
        F.col("cell").alias("cell"),
        F.pmod(F.xxhash64("query_id"), "query_chunks").cast("int").alias("query_chunk"),
        F.explode(F.sequence(F.lit(0), F.col("item_chunks") - 1)).alias("item_chunk"),
        F.col("query_id").alias("query_id"), F.col("embedding").alias("query_vector"),
    )
    right = items.select(
        F.col("cell").alias("cell"),
        F.explode(F.sequence(F.lit(0), F.col("query_chunks") - 1)).alias("query_chunk"),
        F.pmod(F.xxhash64("image_id"), "item_chunks").cast("int").alias("item_chunk"),
        F.col("image_id").alias("image_id"), F.col("embedding").alias("item_vector"),
    )

    def match(query_table, item_table):
        best = BestMatches(vector_matrix(query_table["query_vector"]), k, metric)
        if query_table.num_rows and item_table.num_rows:
            best.update(vector_matrix(item_table["item_vector"]), item_table["image_id"].to_numpy())
        rows, value, found = best.result()
        ids = query_table["query_id"].to_numpy()
        return pa.table({
            "query_id": pa.array(ids[rows], pa.int64()),
            "image_id": pa.array(found, pa.int64()),
            "distance": pa.array(value, pa.float64()),
        })

    position = ["cell", "query_chunk", "item_chunk"]
    return left.groupBy(*position).cogroup(right.groupBy(*position)).applyInArrow(match, HIT_SCHEMA)


def flat_chunks(df: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[int, int]:
    """Rows of a side of a flat grid, and the chunks it is cut into."""
    return tuple(df.agg(F.count(F.lit(1)), _chunk_count(F.count(F.lit(1)), block_rows, F.max(F.size("embedding")))).first())


def flat_grid_hits(queries: DataFrame, items: DataFrame, k: int, block_rows: int = BLOCK_ROWS,
                   metric: str = "l2") -> DataFrame:
    """Partial hits of every query against every item, in blocks of bounded size."""
    sizes = {"cell": F.lit(0)}
    for name, df in (("query_chunks", queries), ("item_chunks", items)):
        sizes[name] = F.lit(flat_chunks(df, block_rows)[1])
    return _match_grid(queries.withColumns(sizes), items.withColumns(sizes), k, metric)


def nearest_on_grid(left: DataFrame, right: DataFrame, k: int, *, left_key: str, right_key: str,
                    right_vector: str, right_type: str, value_name: str, metric: str = "cosine") -> DataFrame:
    """The k right rows of largest cosine, or least squared distance, for every left row,
    both sides of any size."""
    queries = left.select(F.col(left_key).cast("long").alias("query_id"), "embedding")
    items = right.select(
        F.col(right_key).cast("long").alias("image_id"), F.col(right_vector).alias("embedding")
    )
    hits = top_hits(flat_grid_hits(queries, items, k, metric=metric), k, descending=metric == "cosine")
    return hits.select(
        F.col("query_id").alias(left_key),
        F.col("image_id").cast(right_type).alias(right_key),
        F.col("distance").alias(value_name),
        "rank",
    )


def cell_grid_hits(queries: DataFrame, items: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Partial hits of queries (query_id, embedding, cell) against items
    (image_id, embedding, cell) of the same cell.

    Each cell is cut into a grid of query chunks by item chunks of about
    ``block_rows`` rows, or more rows in MAX_CHUNKS chunks; only ids, vectors and
    the grid position are shuffled, and every block returns at most k hits per query.
    """
    def chunked(df, name):
        return df.groupBy("cell").agg(_chunk_count(F.count(F.lit(1)), block_rows, F.max(F.size("embedding"))).alias(name))

    chunks = bounded(chunked(queries, "query_chunks").join(chunked(items, "item_chunks"), "cell"))
    return _match_grid(queries.join(chunks, "cell"), items.join(chunks, "cell"), k)


def _rows_by_cell(ids: np.ndarray, queries: np.ndarray, cells: np.ndarray) -> dict[int, np.ndarray]:
    """For each probed cell the rows of the query block that probe it, all rows of a repeated id."""
    by_id = np.argsort(ids, kind="stable")
    first, last = (np.searchsorted(ids[by_id], queries, side=side) for side in ("left", "right"))
    counts = last - first
    rows = by_id[np.arange(counts.sum()) + np.repeat(first - np.cumsum(counts) + counts, counts)]
    cells = np.repeat(cells, counts)
    if counts.max(initial=1) > 1:  # an id names a cell for each of its rows
        rows, cells = np.unique(np.column_stack((rows, cells)), axis=0).T
    order = np.lexsort((rows, cells))
    found, starts = np.unique(cells[order], return_index=True)
    return dict(zip(found.tolist(), np.split(rows[order], starts[1:])))


def probe_hits(queries: DataFrame, items: DataFrame, k: int, probes: DataFrame, *,
               max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The k nearest items of each query among the cells it probes.

    queries (query_id, embedding), items (image_id, embedding, cell),
    probes (query_id, cell). Cells no query probes are pruned from the scan: by name
    where their number is bounded, else at run time by the probe table.
    """
    items = items.select(F.col("image_id").cast("long"), "embedding", "cell")
    probes = probes.select(F.col("query_id").cast("long"), F.col("cell").cast(items.schema["cell"].dataType))
    block = collect_block(queries, "query_id", "embedding", max_broadcast_rows)
    if block is not None:
        most = MAX_BROADCAST_BYTES // 16
        pairs = probes.limit(most + 1).toArrow()
        if pairs.num_rows <= most:
            rows = _rows_by_cell(block.ids, pairs["query_id"].to_numpy(), pairs["cell"].to_numpy())
            pruned = items.filter(F.col("cell").isin(sorted(rows)))
            return _few(top_hits(_scan_items(block, lay_out(pruned, "image_id"), k, rows), k), block, k)
    probes = cut_lineage(probes.distinct())
    queries = queries.select(F.col("query_id").cast("long"), "embedding").join(probes, "query_id")
    return top_hits(cell_grid_hits(queries, _probed(items, probes), k), k)


def _probed(items: DataFrame, probes: DataFrame) -> DataFrame:
    """The items of the cells that ``probes`` names."""
    wanted = probes.select("cell").distinct()
    named = wanted.limit(MAX_NAMED_CELLS + 1).toArrow()["cell"].to_pylist()
    if len(named) <= MAX_NAMED_CELLS:
        return items.filter(F.col("cell").isin(sorted(named)))
    least = wanted.agg(F.min("cell")).first()[0]
    # The comparison holds for all of them; a filtered table lets Spark prune folders as it runs.
    return items.join(wanted.filter(F.col("cell") >= least), "cell", "left_semi")


def exact_hits(queries: DataFrame, items: DataFrame, k: int, *,
               max_broadcast_rows: int = MAX_BROADCAST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest items of each query: query_id, image_id, distance, rank."""
    if k < 1:
        raise ValueError("k must be at least 1")
    items = items.select(F.col("image_id").cast("long"), "embedding")
    block = collect_block(queries, "query_id", "embedding", max_broadcast_rows)
    if block is not None:
        return _few(top_hits(_scan_items(block, lay_out(items, "image_id"), k, None), k), block, k)
    queries = queries.select(F.col("query_id").cast("long"), "embedding")
    hits = _scan_in_blocks(queries, items, k, max_broadcast_rows)
    if hits is None:
        from nearfield.operators.pivots import pivot_hits  # it builds on this module

        hits = pivot_hits(queries, items, k, block_rows=block_rows)
    return top_hits(hits, k)


def _scan_in_blocks(queries: DataFrame, items: DataFrame, k: int, block_rows: int) -> DataFrame | None:
    """Partial hits of several query blocks, each against a scan of the items in place, so that
    vectors of neither side are shuffled; None where that would take more than MAX_SCANS scans."""
    if block_rows <= 0:
        return None
    parts = -(-2 * queries.count() // block_rows)  # half full, so that uneven ones fit
    if parts > MAX_SCANS:
        return None
    laid, hits = lay_out(items, "image_id"), None
    for part in range(parts):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        block = collect_block(rows, "query_id", "embedding", block_rows)
        if block is None:
            return None
        found = _scan_items(block, laid, k, None)
        hits = found if hits is None else hits.unionAll(found)
    return hits


def with_score(hits: DataFrame, threshold: float = SCORE_THRESHOLD,
               steepness: float = SCORE_STEEPNESS) -> DataFrame:
    return hits.withColumn("similarity_score", sigmoid_score("distance", threshold, steepness))


def knn_exact(queries: DataFrame, items: DataFrame, k: int = 10, *,
              threshold: float = SCORE_THRESHOLD, steepness: float = SCORE_STEEPNESS,
              max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Flat search by squared Euclidean distance.

    queries (query_id, embedding) and items (image_id, embedding) give
    query_id, rank, image_id, distance, similarity_score. When the catalog has
    fewer than k items, fewer rows come back.
    """
    hits = exact_hits(queries, items, k, max_broadcast_rows=max_broadcast_rows)
    return with_score(hits, threshold, steepness).select(
        "query_id", "rank", "image_id", "distance", "similarity_score"
    )


def hit_statistics(hits: DataFrame) -> DataFrame:
    """Smallest, largest and mean distance and score of each query's hits."""
    return hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.min("distance").alias("min_distance"),
        F.max("distance").alias("max_distance"),
        F.avg("distance").alias("mean_distance"),
        F.min("similarity_score").alias("min_score"),
        F.max("similarity_score").alias("max_score"),
        F.avg("similarity_score").alias("mean_score"),
    )
