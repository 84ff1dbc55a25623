"""Category prototypes: the element-wise mean of a category's vectors."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.scalars import category_label
from nearfield.operators.bounds import bounded
from nearfield.operators.knn import (
    MAX_BROADCAST_ROWS,
    collect_block,
    nearest_in_block,
    nearest_on_grid,
)


def vectors_with_category(vectors: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, category_id, embedding of every vector that has an item.

    Vectors stored with their category (``write_members``) need no join.
    """
    if "category_id" in vectors.columns:
        return vectors.select("image_id", "category_id", "embedding")
    return vectors.select("image_id", "embedding").join(
        images.select("image_id", "category_id"), "image_id"
    )


def category_means(members: DataFrame) -> DataFrame:
    """Prototypes (category_id, prototype, n_vectors) of members
    (category_id, embedding).

    Partial sums are kept per category and element before the shuffle, so a
    category holding most rows costs no more than the others.
    """
    element = members.select("category_id", F.posexplode("embedding").alias("pos", "x"))
    by_element = element.groupBy("category_id", "pos").agg(
        F.avg(F.col("x").cast("double")).cast("float").alias("mean"),
        F.count(F.lit(1)).alias("n"),
    )
    return (
        by_element.groupBy("category_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("pos", "mean"))).alias("means"),
            F.max("n").alias("n_vectors"),
        )
        .select("category_id", F.col("means.mean").alias("prototype"), "n_vectors")
    )


def all_prototypes(vectors: DataFrame, images: DataFrame) -> DataFrame:
    """Prototypes of every category that has vectors."""
    return category_means(vectors_with_category(vectors, images))


def with_own_prototype(vectors: DataFrame, images: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Vectors (image_id, category_id, embedding) beside their category's prototype.

    Prototypes within the bound travel to the vectors, so a large category is
    not gathered in one task.
    """
    few = bounded(prototypes.select("category_id", "prototype"), MAX_BROADCAST_ROWS)
    return vectors_with_category(vectors, images).join(few, "category_id")


def prototypes_of(categories: DataFrame, vectors: DataFrame, images: DataFrame) -> DataFrame:
    """Prototypes of the given categories (category_id) only."""
    wanted = bounded(categories.select("category_id").distinct())
    if "category_id" in vectors.columns:
        return category_means(vectors.join(wanted, "category_id", "left_semi"))
    return category_means(vectors_with_category(vectors, images.join(wanted, "category_id", "left_semi")))


def prototype_similarity(queries: DataFrame, prototypes: DataFrame, top: int | None = None, *,
                         key: str = "query_id",
                         max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Cosine of each query (key, embedding) to the prototypes: key, category_id,
    similarity, rank; all categories, or the ``top`` best of each query.

    Prototypes within the bound travel to the queries and nothing is shuffled.
    """
    block = collect_block(prototypes, "category_id", "prototype", max_broadcast_rows)
    if block is not None:
        return _similarity_to_block(queries, block, top, key)
    k = prototypes.count() if top is None else top
    return nearest_on_grid(
        queries, prototypes, k, left_key=key, right_key="category_id",
        right_vector="prototype", right_type="int", value_name="similarity",
    )


def _similarity_to_block(queries, block, top, key):
    return nearest_in_block(
        queries, block, top or max(1, len(block)), "cosine", left_key=key, left_vector="embedding",
        right_name="category_id", right_type="int", value_name="similarity",
    )


def top_categories(queries: DataFrame, prototypes: DataFrame, n: int = 3, **options) -> DataFrame:
    """The n categories nearest to each query by cosine, with their rank."""
    if n < 1:
        raise ValueError("the number of top categories must be at least 1")
    return prototype_similarity(queries, prototypes, n, **options)


def rank_prototypes(queries: DataFrame, prototypes: DataFrame, categories: DataFrame, **options) -> DataFrame:
    """Every category with its name and cosine, ranked for each query."""
    names = bounded(categories.select("category_id", "category_name"))
    named = prototype_similarity(queries, prototypes, **options).join(names, "category_id", "left")
    return named.select(
        "query_id", "rank", "category_id",
        category_label("category_name", "category_id").alias("category_name"),
        "similarity",
    )


def predict_category(items: DataFrame, prototypes: DataFrame, *, default_category: int = 1,
                     max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The category with the nearest prototype for each item (image_id, embedding);
    ``default_category`` when there are no prototypes."""
    block = collect_block(prototypes, "category_id", "prototype", max_broadcast_rows)
    if (prototypes.isEmpty() if block is None else len(block) == 0):
        return items.select(
            F.col("image_id").cast("long"), F.lit(default_category).alias("predicted_category"),
            F.lit(None).cast("double").alias("similarity"),
        )
    if block is None:
        best = prototype_similarity(items, prototypes, 1, key="image_id", max_broadcast_rows=0)
    else:
        best = _similarity_to_block(items, block, 1, "image_id")
    return best.select("image_id", F.col("category_id").alias("predicted_category"), "similarity")
