"""Two-stage search: rank categories by prototype, then items by distance."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import SCORE_STEEPNESS, SCORE_THRESHOLD
from nearfield.operators.ann import VectorIndex, cells_probed, index_hits
from nearfield.operators.bounds import bounded
from nearfield.operators.knn import (
    MAX_BROADCAST_ROWS,
    exact_hits,
    probe_hits,
    with_score,
)
from nearfield.operators.prototypes import top_categories, vectors_with_category


def _check(limit: int, prototype_limit: int):
    if limit < 1 or prototype_limit < 1:
        raise ValueError("limit and prototype_limit must be at least 1")


def enrich_hits(hits: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """Add item and category data to hits; hits whose item is gone drop out."""
    items = images.select("image_id", "category_id", "metadata")
    names = bounded(categories.select("category_id", "category_name"))
    return hits.join(items, "image_id").join(names, "category_id")


def _nearest(queries, vectors, k, index, nprobe, max_broadcast_rows):
    if index is None:
        return exact_hits(queries, vectors, k, max_broadcast_rows=max_broadcast_rows)
    return index_hits(queries, index, k, nprobe=nprobe, max_broadcast_rows=max_broadcast_rows)


def public_view(items: DataFrame) -> DataFrame:
    """What a caller may see of an item: everything but its content and hash."""
    shown = [c for c in items.columns if c not in ("content", "content_hash")]
    if "similarity_score" not in shown:
        return items.select(*shown, F.lit(None).cast("double").alias("similarity_score"))
    return items.select(*shown)


def hits_in_categories(queries: DataFrame, vectors: DataFrame, images: DataFrame, chosen: DataFrame, limit: int, *,
                       index: VectorIndex | None = None, nprobe: int = 1,
                       max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The ``limit`` nearest items of each query among all items of its ``chosen`` categories
    (query_id, category_id); with an index of cells, among those that also lie in a probed cell."""
    probes = chosen.select("query_id", F.col("category_id").cast("long").alias("cell"))
    if index is None or index.centroids is None:
        items = vectors_with_category(vectors if index is None else index.cells, images)
        items = items.withColumn("cell", F.col("category_id").cast("long"))
    else:
        both = lambda: F.shiftleft(F.col("part").cast("long"), 32) + F.col("category_id")
        parts = cells_probed(queries, index, nprobe).withColumnRenamed("cell", "part")
        probes = chosen.join(parts, "query_id").select("query_id", both().alias("cell"))
        placed = index.cells.join(images.select("image_id", "category_id"), "image_id")
        items = placed.withColumnRenamed("cell", "part").withColumn("cell", both())
    return probe_hits(queries, items.select("image_id", "embedding", "cell"), limit, probes, max_broadcast_rows=max_broadcast_rows)


def search_postfilter(queries: DataFrame, vectors: DataFrame, images: DataFrame,
                      prototypes: DataFrame, limit: int = 10, prototype_limit: int = 3, *,
                      index: VectorIndex | None = None, nprobe: int = 1,
                      max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The best hits among all items of the query's top categories, with their category;
    an index, when given, is searched in place of the vectors."""
    _check(limit, prototype_limit)
    chosen = top_categories(queries, prototypes, prototype_limit)
    hits = hits_in_categories(queries, vectors, images, chosen, limit, index=index, nprobe=nprobe, max_broadcast_rows=max_broadcast_rows)
    placed = hits.join(images.select("image_id", "category_id"), "image_id")
    return placed.select("query_id", "rank", "image_id", "category_id", "distance")


def search_prefilter(queries: DataFrame, vectors: DataFrame, images: DataFrame,
                     prototypes: DataFrame, limit: int = 10, prototype_limit: int = 3, *,
                     max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Search only inside each query's top categories.

    With vectors stored by category (``write_members``) other categories are
    not even read, and no join is needed.
    """
    _check(limit, prototype_limit)
    probes = top_categories(queries, prototypes, prototype_limit).select(
        "query_id", F.col("category_id").alias("cell")
    )
    items = vectors_with_category(vectors, images).withColumnRenamed("category_id", "cell")
    hits = probe_hits(queries, items, limit, probes, max_broadcast_rows=max_broadcast_rows)
    return hits.select("query_id", "rank", "image_id", "distance")


def search(queries: DataFrame, vectors: DataFrame, images: DataFrame, categories: DataFrame,
           prototypes: DataFrame | None = None, *, limit: int = 10, use_prototypes: bool = False,
           prototype_limit: int = 3, threshold: float = SCORE_THRESHOLD,
           steepness: float = SCORE_STEEPNESS, index: VectorIndex | None = None, nprobe: int = 1,
           max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The full result: one row per hit with item, category, distance, score,
    whether categories were filtered, and which ones. ``index`` is searched in
    place of all vectors when given."""
    _check(limit, prototype_limit)
    if use_prototypes and prototypes is None:
        raise ValueError("use_prototypes needs prototypes")
    if use_prototypes:
        chosen = top_categories(queries, prototypes, prototype_limit)
        hits = hits_in_categories(queries, vectors, images, chosen, limit, index=index, nprobe=nprobe, max_broadcast_rows=max_broadcast_rows)
    else:
        hits = _nearest(queries, vectors, limit, index, nprobe, max_broadcast_rows)
    hits = enrich_hits(hits, images, categories)
    if use_prototypes:
        listed = chosen.groupBy("query_id").agg(
            F.sort_array(F.collect_list(F.struct("rank", "category_id"))).alias("ranked")
        ).select("query_id", F.col("ranked.category_id").alias("prototype_categories"))
        hits = hits.join(listed, "query_id")
    else:
        hits = hits.withColumn("prototype_categories", F.lit(None).cast("array<int>"))
    found = public_view(with_score(hits, threshold, steepness))
    return found.select(
        "query_id", "rank", "image_id", "category_id", "category_name", "metadata",
        "distance", "similarity_score",
        F.lit(use_prototypes).alias("used_prototype_filtering"), "prototype_categories",
    )
