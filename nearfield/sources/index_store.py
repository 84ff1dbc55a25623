"""Saving and loading a vector index as plain Parquet."""

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.ann import HashTables, VectorIndex, place_items
from nearfield.operators.bounds import bounded
from nearfield.session import cut_lineage

_META = "index_type string, dim int, ntotal bigint"
_CELLS = "image_id bigint, embedding array<float>, cell int"
_CENTROIDS = "cell int, centroid array<double>"
_POSTINGS = "image_id bigint, bucket array<int>"
_HASHING = "place int, direction array<double>, bucket_length double, per_table int"


def save_index(index: VectorIndex, path: str, *, mode: str = "error") -> DataFrame:
    """Write cells (one folder per cell), centroids or postings of hash buckets, and metadata; returns the metadata row.

    Rows are rebalanced by cell first: small cells share a task, a huge one is
    split over several.
    """
    spark = index.cells.sparkSession
    cells = index.cells.select("image_id", "embedding", "cell")
    if index.centroids is not None:
        index.centroids.coalesce(1).write.mode(mode).parquet(f"{path}/centroids")
        cells = cells.hint("rebalance", F.col("cell"))
    cells.write.mode(mode).partitionBy("cell").parquet(f"{path}/cells")
    if index.postings is not None:
        h = index.hashing
        rows = [(i, [float(x) for x in d], float(h.bucket_length), h.per_table) for i, d in enumerate(h.projections)]
        spark.createDataFrame(rows, _HASHING).coalesce(1).write.mode(mode).parquet(f"{path}/hashing")
        index.postings.write.mode(mode).parquet(f"{path}/postings")
    return _write_meta(index, path, mode)


def _write_meta(index: VectorIndex, path: str, mode: str) -> DataFrame:
    spark = index.cells.sparkSession
    meta = _read_cells(spark, path).agg(F.count(F.lit(1)).alias("ntotal")).select(
        F.lit(index.index_type).alias("index_type"), F.lit(index.dim).alias("dim"), "ntotal"
    )
    meta.write.mode(mode).parquet(f"{path}/meta")
    return spark.read.schema(_META).parquet(f"{path}/meta")


def _read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_CELLS).parquet(f"{path}/cells")


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index written by ``save_index``; its cells prune by folder."""
    meta = spark.read.schema(_META).parquet(f"{path}/meta").first()
    centroids = None
    if meta["index_type"] == "ivfflat":
        centroids = spark.read.schema(_CENTROIDS).parquet(f"{path}/centroids")
    index = VectorIndex(meta["index_type"], centroids, _read_cells(spark, path), meta["dim"])
    if index.index_type == "lsh":
        rows = spark.read.schema(_HASHING).parquet(f"{path}/hashing").orderBy("place").collect()  # one for each projection
        index.hashing = HashTables(np.array([r.direction for r in rows]), rows[0].bucket_length, rows[0].per_table)
        index.postings = _read_postings(spark, path)
    return index


def _read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_POSTINGS).parquet(f"{path}/postings")


def append_to_index(index: VectorIndex, items: DataFrame, path: str) -> None:
    """Place items (image_id, embedding) in the stored index's cells and append them there.

    Items the index already has are left out; vectors of another dimension are
    refused. The metadata is written anew from a count of the cells.
    """
    fresh = items.select("image_id", "embedding").join(index.cells.select("image_id"), "image_id", "left_anti")
    fresh = cut_lineage(fresh.dropDuplicates(["image_id"]))
    if not fresh.filter(F.size("embedding") != index.dim).isEmpty():
        raise ValueError(f"the index holds vectors of dimension {index.dim}")
    cells = place_items(index, fresh).select("image_id", "embedding", "cell").hint("rebalance", F.col("cell"))
    cells.write.mode("append").partitionBy("cell").parquet(f"{path}/cells")
    if index.postings is not None:
        index.hashing.postings(fresh, "image_id").write.mode("append").parquet(f"{path}/postings")
    _write_meta(index, path, "overwrite")


def replace_in_index(index: VectorIndex, items: DataFrame, path: str) -> None:
    """Move items (image_id, embedding), each once, to the cell of their new vector in the stored index; new ones are added.

    Only the cells that held them are written anew, each as a whole before its folder is replaced; the others keep
    their files. The metadata is written anew from a count of the cells.
    """
    spark = items.sparkSession
    fresh = cut_lineage(items.select(F.col("image_id").cast("long"), "embedding"))
    if not fresh.filter(F.col("embedding").isNull() | (F.size("embedding") != index.dim)).isEmpty():
        raise ValueError(f"the index holds vectors of dimension {index.dim}")
    if not fresh.groupBy("image_id").count().filter("count > 1 OR image_id IS NULL").isEmpty():
        raise ValueError("an item occurs twice, or is null")
    stored = _read_cells(spark, path)
    placed = cut_lineage(place_items(index, fresh).select("image_id", "embedding", "cell"))
    ids = bounded(fresh.select("image_id"))
    touched = stored.join(ids, "image_id", "left_semi").select("cell").union(placed.select("cell")).distinct()
    touched = [r.cell for r in touched.collect()]  # as many as there are centroids at most
    kept = stored.filter(F.col("cell").isin(touched)).join(ids, "image_id", "left_anti").select("image_id", "embedding", "cell")
    rows = cut_lineage(kept.unionByName(placed))
    gone = sorted(set(touched) - {r.cell for r in rows.select("cell").distinct().collect()})
    rows.hint("rebalance", F.col("cell")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{path}/cells")
    for cell in gone:  # a cell that lost its last item has no rows to be replaced with
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/cells/cell={cell}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if index.postings is not None:
        others = _read_postings(spark, path).join(ids, "image_id", "left_anti")
        cut_lineage(others.unionByName(index.hashing.postings(fresh, "image_id"))).write.mode("overwrite").parquet(f"{path}/postings")
    _write_meta(index, path, "overwrite")
