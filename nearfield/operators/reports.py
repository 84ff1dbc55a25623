"""Counts and listings over the catalog."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.scalars import floored_count, iso_timestamp


def items_per_category(images: DataFrame) -> DataFrame:
    return images.groupBy("category_id").agg(F.count(F.lit(1)).alias("n_items"))


def category_breakdown(categories: DataFrame, images: DataFrame) -> DataFrame:
    """Items of every category, 0 for empty ones; counted before the join."""
    counts = items_per_category(images)
    return categories.select("category_id", "category_name").join(counts, "category_id", "left").select(
        "category_id", "category_name", F.coalesce("n_items", F.lit(0)).alias("image_count")
    )


def recount_items(categories: DataFrame, images: DataFrame) -> DataFrame:
    """Categories with ``image_count`` set to the true count."""
    return category_breakdown(categories, images)


def apply_count_changes(categories: DataFrame, changes: DataFrame) -> DataFrame:
    """Categories with ``image_count`` moved by item changes (category_id, op):
    +1 per INSERT, -1 per DELETE, never below 0."""
    step = F.when(F.col("op") == "INSERT", 1).when(F.col("op") == "DELETE", -1).otherwise(0)
    delta = changes.groupBy("category_id").agg(F.sum(step).alias("delta"))
    return categories.join(delta, "category_id", "left").select(
        "category_id", "category_name", floored_count("image_count", "delta").alias("image_count")
    )


def catalog_status(catalog: dict[str, DataFrame]) -> DataFrame:
    """One row: the size of each table and the latest index."""
    counted = {
        "categories": "total_categories", "images": "total_images",
        "vectors": "total_vectors", "prototypes": "categories_with_prototypes",
    }
    counts = reduce(DataFrame.unionByName, [
        catalog[table].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")
        for table, name in counted.items()
    ])
    latest = catalog["indexes"].agg(
        F.max("index_id").alias("index_id"),
        F.max_by("index_type", "index_id").alias("index_type"),
        F.max_by("path", "index_id").alias("path"),
        F.max_by("ntotal", "index_id").alias("ntotal"),
    )
    both = counts.unionByName(
        latest.withColumns({"metric": F.lit("index"), "n": F.lit(None).cast("long")}),
        allowMissingColumns=True,
    )
    return both.agg(
        *[F.max(F.when(F.col("metric") == name, F.col("n"))).alias(name) for name in counted.values()],
        F.max("index_id").alias("latest_index_id"),
        F.max("index_type").alias("latest_index_type"),
        F.max("path").alias("latest_index_path"),
        F.max("ntotal").alias("latest_index_ntotal"),
    )


def queue_heads(recompute_queue: DataFrame, deletion_queue: DataFrame, limit: int = 100) -> DataFrame:
    """The oldest entries of both queues: queue, id, queued_at (ISO text), n_shown.

    An empty queue has one row without an id, with n_shown 0."""
    if limit < 1:
        raise ValueError("limit must be at least 1")

    def head(queue, name, key, ts):
        oldest = queue.orderBy(ts, key).limit(limit)
        return oldest.select(
            F.lit(name).alias("queue"), F.col(key).cast("long").alias("id"),
            iso_timestamp(ts).alias("queued_at"),
        )

    heads = head(recompute_queue, "prototype_recompute", "category_id", "last_updated").unionByName(
        head(deletion_queue, "vector_deletion", "image_id", "queued_at")
    )
    names = heads.sparkSession.createDataFrame([("prototype_recompute",), ("vector_deletion",)], "queue string")
    shown = names.join(heads, "queue", "left").groupBy("queue").agg(F.count("id").alias("n_shown"))
    return shown.join(heads, "queue", "left").select(*heads.columns, "n_shown")


def category_items(images: DataFrame, categories: DataFrame, category_id: int, limit: int = 50) -> DataFrame:
    """The first items of a category by id, with the number shown and the true total."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    members = images.filter(F.col("category_id") == category_id)
    shown = members.select("image_id", "category_id", "metadata").orderBy("image_id").limit(limit)
    total = members.groupBy("category_id").agg(F.count(F.lit(1)).alias("total_count"))
    return (
        shown.join(total, "category_id")
        .join(categories.select("category_id", "category_name"), "category_id")
        .withColumn("shown_count", F.least(F.lit(limit).cast("long"), "total_count"))
    )
