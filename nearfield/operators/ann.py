"""Approximate search: inverted lists of k-means cells, and hash buckets."""

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.operators.blocks import BestMatches, keep_best, vector_matrix
from nearfield.operators.bounds import bounded
from nearfield.operators.knn import (
    HIT_SCHEMA,
    MAX_BROADCAST_ROWS,
    VectorBlock,
    cell_grid_hits,
    collect_block,
    exact_hits,
    nearest_in_block,
    nearest_on_grid,
    probe_hits,
    with_score,
)
from nearfield.session import cut_lineage

INDEX_TYPES = ("flatl2", "ivfflat", "lsh")

# Centroids that travel to the vectors, if they fit the bound in bytes too.
MAX_BLOCK_CELLS = 1 << 16


@dataclass
class HashTables:
    """Projections that name one bucket of each table for a vector: ``per_table`` of them, cut at ``bucket_length``.

    More projections or shorter cuts mean fewer candidates, more tables mean more.
    """

    projections: np.ndarray
    bucket_length: float = 0.25
    per_table: int = 2

    @classmethod
    def random(cls, dim: int, bucket_length: float = 0.25, num_tables: int = 8, per_table: int = 2, seed: int = 7):
        directions = np.random.default_rng(seed).normal(size=(num_tables * per_table, dim))
        return cls(directions / np.linalg.norm(directions, axis=1, keepdims=True), bucket_length, per_table)

    def names(self, vectors: np.ndarray) -> np.ndarray:
        """For each vector and table the number of the table and the cuts."""
        tables = len(self.projections) // self.per_table
        if len(vectors) == 0:
            return np.zeros((0, tables, self.per_table + 1), dtype=np.int32)
        cuts = np.floor(vectors.astype(np.float64) @ self.projections.T / self.bucket_length)
        cuts = cuts.clip(-(2**31), 2**31 - 1).astype(np.int32).reshape(len(cuts), tables, self.per_table)
        numbers = np.broadcast_to(np.arange(tables, dtype=np.int32)[None, :, None], (*cuts.shape[:2], 1))
        return np.concatenate((numbers, cuts), axis=2)

    def postings(self, df: DataFrame, key: str, *, keep_vector: bool = False) -> DataFrame:
        """``key`` and each bucket (the table, then its cuts) of the vectors of ``df`` (key, embedding)."""
        def run(batches):
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                names = self.names(vector_matrix(batch.column(1)))
                inner = _lists(names.reshape(-1, self.per_table + 1))
                offsets = pa.array(np.arange(len(names) + 1, dtype=np.int32) * names.shape[1])
                yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + keep_vector], pa.ListArray.from_arrays(offsets, inner)],
                                                 ["key", *["embedding"] * keep_vector, "buckets"])

        vector = ["embedding"] if keep_vector else []
        narrow = df.select(F.col(key).cast("long"), F.col("embedding").cast("array<float>"))
        hashed = narrow.mapInArrow(run, f"key bigint, {'embedding array<float>, ' if keep_vector else ''}buckets array<array<int>>")
        return hashed.select(F.col("key").alias(key), *vector, F.explode("buckets").alias("bucket"))


def _lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists of ints."""
    flat = pa.array(np.ascontiguousarray(rows).ravel(), pa.int32())
    return pa.FixedSizeListArray.from_arrays(flat, rows.shape[1]).cast(pa.list_(pa.int32()))


@dataclass
class VectorIndex:
    """centroids (cell, centroid) and cells (cell, image_id, embedding); with hash buckets also their
    projections and postings (image_id, bucket), which hold no vectors."""

    index_type: str
    centroids: DataFrame | None
    cells: DataFrame
    dim: int
    hashing: HashTables | None = None
    postings: DataFrame | None = None


def _dimension(items: DataFrame) -> int:
    first = items.select(F.size("embedding").alias("dim")).first()
    if first is None:
        raise ValueError("an index needs at least one vector")
    return first["dim"]


def nearest_cells(left: DataFrame, key: str, centroids: DataFrame, k: int = 1, *,
                  keep_vector: bool = False, max_cells: int = MAX_BLOCK_CELLS) -> DataFrame:
    """key, cell, radius and rank of the ``k`` nearest centroids of each vector (key, embedding).

    Centroids that one task can hold travel to the vectors; more of them meet
    the vectors in blocks.
    """
    block = collect_block(centroids, "cell", "centroid", max_cells)
    if block is not None:
        return nearest_in_block(
            left, block, k, "l2", left_key=key, left_vector="embedding", right_name="cell",
            right_type="int", value_name="radius", keep_vector=keep_vector,
        )
    found = nearest_on_grid(
        left, centroids, k, left_key=key, right_key="cell", right_vector="centroid",
        right_type="int", value_name="radius", metric="l2",
    )
    return found.join(left.select(F.col(key).cast("long"), "embedding"), key) if keep_vector else found


def assign_cells(items: DataFrame, centroids: DataFrame, max_cells: int = MAX_BLOCK_CELLS) -> DataFrame:
    """Each item with the cell of its nearest centroid."""
    placed = nearest_cells(items, "image_id", centroids, keep_vector=True, max_cells=max_cells)
    return placed.select("cell", "image_id", "embedding")


def ivf_build(items: DataFrame, nlist: int = 100, *, seed: int = 7, iterations: int = 10,
              centroids: DataFrame | None = None, train: DataFrame | None = None) -> VectorIndex:
    """Cells around k-means centroids for items (image_id, embedding).

    Centroids are placed on all items, or on ``train`` (embedding) where the
    caller gives it; with ``centroids`` (cell, centroid) nothing is fitted.
    """
    dim = _dimension(items)
    if centroids is not None:
        centroids = centroids.select(F.col("cell").cast("int"), F.col("centroid").cast("array<double>"))
        return VectorIndex("ivfflat", centroids, assign_cells(items, centroids), dim)
    source = items if train is None else train
    vector = array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    train = source.select(vector)
    total = source.count()
    cells = min(nlist, total)
    if cells > 1:
        train = train.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            model = KMeans(k=cells, seed=seed, maxIter=iterations).fit(train)
        finally:
            train.unpersist()
        found = model.clusterCenters()
    else:
        found = [train.first()["features"].toArray()]
    spark = items.sparkSession
    centers = [(cell, [float(x) for x in center]) for cell, center in enumerate(found)]
    centroids = spark.createDataFrame(centers, "cell int, centroid array<double>")
    return VectorIndex("ivfflat", centroids, assign_cells(items, centroids), dim)


def flat_build(items: DataFrame, dim: int | None = None) -> VectorIndex:
    """The index without cells: every search scans all vectors. It may be empty when ``dim`` is given."""
    cells = items.select(F.lit(0).alias("cell"), F.col("image_id").cast("long"), "embedding")
    return VectorIndex("flatl2", None, cells, _dimension(items) if dim is None else dim)


def lsh_build(items: DataFrame, hashing: HashTables) -> VectorIndex:
    """The index of hash buckets for items (image_id, embedding)."""
    flat = flat_build(items, hashing.projections.shape[1])
    return replace(flat, index_type="lsh", hashing=hashing, postings=hashing.postings(items, "image_id"))


def build_index(items: DataFrame, index_type: str = "flatl2", *, nlist: int = 100, seed: int = 7) -> VectorIndex:
    """Build one of INDEX_TYPES; 'lsh' has the vectors in one cell and postings of their hash buckets."""
    if index_type == "ivfflat":
        return ivf_build(items, nlist, seed=seed)
    if index_type == "flatl2":
        return flat_build(items)
    if index_type == "lsh":
        return lsh_build(items, HashTables.random(_dimension(items), seed=seed))
    raise ValueError(f"index_type must be one of {INDEX_TYPES}")


def place_items(index: VectorIndex, items: DataFrame) -> DataFrame:
    """Items (image_id, embedding) with the index cell they belong to."""
    if index.centroids is None:
        return items.select(F.lit(0).alias("cell"), F.col("image_id").cast("long"), "embedding")
    return assign_cells(items, index.centroids)


def index_add(index: VectorIndex, items: DataFrame) -> VectorIndex:
    """The index with more items, each placed in an existing cell, or under its buckets."""
    grown = replace(index, cells=index.cells.unionByName(place_items(index, items)))
    if index.postings is not None:
        grown.postings = index.postings.unionByName(index.hashing.postings(items, "image_id"))
    return grown


def index_remove(index: VectorIndex, ids: DataFrame) -> VectorIndex:
    """The index without the given items (image_id)."""
    gone = ids.select("image_id")
    kept = replace(index, cells=index.cells.join(gone, "image_id", "left_anti"))
    if index.postings is not None:
        kept.postings = index.postings.join(gone, "image_id", "left_anti")
    return kept


_RESULT = ("query_id", "rank", "image_id", "distance", "similarity_score")


def cells_probed(queries: DataFrame, index: VectorIndex, nprobe: int) -> DataFrame:
    """query_id and each cell of the index that the query's search looks into."""
    if index.centroids is None:
        return queries.select("query_id", F.lit(0).alias("cell"))
    return nearest_cells(queries, "query_id", index.centroids, nprobe).select("query_id", "cell")


def _cell_hits(queries, index, k, nprobe, max_broadcast_rows):
    probes = cells_probed(queries, index, nprobe)
    return probe_hits(queries, index.cells, k, probes, max_broadcast_rows=max_broadcast_rows)


def ivf_search(queries: DataFrame, index: VectorIndex, k: int = 10, nprobe: int = 1, *,
               max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The k nearest items within the ``nprobe`` cells nearest to each query.

    With ``nprobe`` at the number of cells the result is exact.
    """
    return with_score(_cell_hits(queries, index, k, nprobe, max_broadcast_rows)).select(*_RESULT)


def _scan_buckets(block: VectorBlock, items: DataFrame, k: int, rows_of: dict[int, np.ndarray]) -> DataFrame:
    """Partial hits of a broadcast query block against items (image_id, embedding, codes) in place; ``rows_of`` has the
    queries of each code. A pair that meets under several codes counts once."""
    shared = items.sparkSession.sparkContext.broadcast((block.ids, block.vectors, rows_of))

    def scan(batches):
        query_ids, queries, probing = shared.value
        found = np.zeros(0, np.int64), np.zeros(0, np.float64), np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), vector_matrix(batch.column(1))
            codes = batch.column(2)
            place = np.repeat(np.arange(len(ids)), codes.value_lengths().to_numpy())
            flat = codes.flatten().to_numpy(zero_copy_only=False)
            order = np.argsort(flat, kind="stable")
            names, starts = np.unique(flat[order], return_index=True)
            parts = [found]
            for name, inside in zip(names.tolist(), np.split(place[order], starts[1:])):
                rows = probing[name]
                best = BestMatches(queries[rows], k)
                best.update(vectors[inside], ids[inside])
                left, distance, right = best.result()
                parts.append((rows[left], distance, right))
            left, distance, right = (np.concatenate(column) for column in zip(*parts))
            order = np.lexsort((right, distance, left))
            left, distance, right = left[order], distance[order], right[order]
            once = np.ones(len(left), dtype=bool)
            once[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
            left, distance, right = left[once], distance[once], right[once]
            best = keep_best(left, distance, right, k)
            found = left[best], distance[best], right[best]
        left, distance, right = found
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[left]), pa.array(right), pa.array(distance)], ["query_id", "image_id", "distance"])

    return items.mapInArrow(scan, HIT_SCHEMA)


def bucket_hits(queries: DataFrame, items: DataFrame, postings: DataFrame, hashing: HashTables, k: int, *,
                max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """query_id, image_id, distance and rank of the k nearest of the items (image_id, embedding) that share a bucket
    with the query; postings (image_id, bucket) name the buckets of the items.

    Candidates are found among postings, without a vector, and each once whatever number of tables it meets in. Only
    then are their vectors fetched: where they lie, when the candidates' ids may travel. A checked block of queries meets
    them there; more queries meet them in blocks of bounded size for each bucket, and no list of pairs is written.
    """
    items = items.select(F.col("image_id").cast("long"), "embedding")
    block = collect_block(queries, "query_id", "embedding", max_broadcast_rows)
    if block is not None:
        names = hashing.names(block.vectors)
        buckets, code = np.unique(names.reshape(-1, names.shape[2]), axis=0, return_inverse=True)
        code = code.ravel().astype(np.int32)
        rows = np.repeat(np.arange(len(block)), names.shape[1])
        order = np.lexsort((rows, code))
        starts = np.searchsorted(code[order], np.arange(len(buckets)))
        rows_of = dict(enumerate(np.split(rows[order], starts[1:]))) if len(buckets) else {}
        probed = pa.table({"bucket": _lists(buckets), "code": pa.array(np.arange(len(buckets)), pa.int32())})
        probed = queries.sparkSession.createDataFrame(probed, "bucket array<int>, code int")
        met = postings.join(probed, "bucket").groupBy("image_id").agg(F.collect_set("code").alias("codes"))
        partial = _scan_buckets(block, items.join(bounded(cut_lineage(met)), "image_id"), k, rows_of)
    else:
        wanted = hashing.postings(queries, "query_id", keep_vector=True).withColumnRenamed("bucket", "cell")
        probed = bounded(wanted.select(F.col("cell").alias("bucket")).distinct())
        met = postings.join(probed, "bucket", "left_semi").groupBy("image_id").agg(F.collect_set("bucket").alias("buckets"))
        offered = items.join(bounded(cut_lineage(met)), "image_id")
        partial = cell_grid_hits(wanted, offered.select("image_id", "embedding", F.explode("buckets").alias("cell")), k)
    # A pair met in several tables or tasks has one rank, so it is told apart after ranking,
    # where its copies already share a partition.
    best_first = Window.partitionBy("query_id").orderBy("distance", "image_id")
    ranked = partial.withColumn("rank", F.dense_rank().over(best_first)).filter(F.col("rank") <= k)
    return ranked.dropDuplicates(["query_id", "image_id"])


def ann_lsh(queries: DataFrame, items: DataFrame, k: int = 10, *, bucket_length: float = 0.25,
            num_tables: int = 8, hashes_per_table: int = 2, seed: int = 7,
            projections: np.ndarray | None = None, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Search among items that share a random-projection bucket with the query.

    A bucket of a table is named by ``hashes_per_table`` projections cut at
    ``bucket_length``. A query alone in its buckets has no hits. ``projections``
    (num_tables * hashes_per_table rows) takes the place of random directions.
    A stored index of type 'lsh' keeps the postings that are made here.
    """
    if projections is None:
        hashing = HashTables.random(_dimension(items), bucket_length, num_tables, hashes_per_table, seed)
    elif len(projections) == num_tables * hashes_per_table:
        hashing = HashTables(np.asarray(projections, dtype=np.float64), bucket_length, hashes_per_table)
    else:
        raise ValueError("projections must have num_tables * hashes_per_table rows")
    hits = bucket_hits(queries, items, hashing.postings(items, "image_id"), hashing, k, max_broadcast_rows=max_broadcast_rows)
    return with_score(hits).select(*_RESULT)


def index_hits(queries: DataFrame, index: VectorIndex, k: int, *, nprobe: int = 1,
               max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The k nearest items found in an index of any type."""
    if index.index_type == "ivfflat":
        return _cell_hits(queries, index, k, nprobe, max_broadcast_rows)
    if index.index_type == "lsh":
        hashing = index.hashing or HashTables.random(index.dim)
        postings = hashing.postings(index.cells, "image_id") if index.postings is None else index.postings
        return bucket_hits(queries, index.cells, postings, hashing, k, max_broadcast_rows=max_broadcast_rows)
    return exact_hits(queries, index.cells, k, max_broadcast_rows=max_broadcast_rows)


def search_index(queries: DataFrame, index: VectorIndex, k: int = 10, *, nprobe: int = 1) -> DataFrame:
    """Search an index of any type, with scores."""
    return with_score(index_hits(queries, index, k, nprobe=nprobe)).select(*_RESULT)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the true hits that were found, per query."""
    pair = ["query_id", "image_id"]
    hit = found.select(*pair).withColumn("found", F.lit(1))
    return truth.select(*pair).join(hit, pair, "left").groupBy("query_id").agg(
        (F.count("found") / F.count(F.lit(1))).alias("recall")
    )
