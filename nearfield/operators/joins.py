"""Joins of items, categories, vectors and prototypes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.scalars import category_label
from nearfield.operators.bounds import bounded
from nearfield.operators.reports import items_per_category


def _names(categories: DataFrame) -> DataFrame:
    return bounded(categories.select("category_id", "category_name"))


def items_with_category(images: DataFrame, categories: DataFrame) -> DataFrame:
    """Items with the name of their category."""
    return images.join(_names(categories), "category_id")


def items_of_category(images: DataFrame, categories: DataFrame, category_id: int) -> DataFrame:
    """Items of one category with its name."""
    return items_with_category(images.filter(F.col("category_id") == category_id), categories)


def vectors_of_category(vectors: DataFrame, images: DataFrame, category_id: int) -> DataFrame:
    """image_id, embedding of the vectors in one category."""
    members = bounded(images.filter(F.col("category_id") == category_id).select("image_id"))
    return vectors.select("image_id", "embedding").join(members, "image_id")


def categories_with_items(categories: DataFrame, images: DataFrame) -> DataFrame:
    """Every category beside its items; a category without items has one row.

    Written as an inner join plus the empty categories, so the categories can
    travel to the items and a large category is not gathered in one task.
    """
    names = _names(categories)
    items = images.select("image_id", "category_id")
    empty = names.join(items.select("category_id").distinct(), "category_id", "left_anti")
    return names.join(items, "category_id").unionByName(
        empty.withColumn("image_id", F.lit(None).cast("long"))
    )


def with_category_total(images: DataFrame) -> DataFrame:
    """Items beside the number of items in their category.

    The counts, once their number is checked, travel to the items.
    """
    totals = items_per_category(images).withColumnRenamed("n_items", "total_images_in_category")
    return images.join(bounded(totals), "category_id")


def without_vectors(images: DataFrame, vectors: DataFrame) -> DataFrame:
    """The items that have no vector. Ids are compared first; contents move
    only when too many items are missing for their ids to travel."""
    missing = images.select("image_id").join(vectors.select("image_id"), "image_id", "left_anti")
    return images.join(bounded(missing), "image_id", "left_semi")


def items_without_vectors(images: DataFrame, vectors: DataFrame, categories: DataFrame) -> DataFrame:
    """Items that have no vector, with category name and size."""
    totals = bounded(items_per_category(images).withColumnRenamed("n_items", "total_images_in_category"))
    missing = without_vectors(images, vectors).join(totals, "category_id")
    return items_with_category(missing, categories)


def items_with_vector(images: DataFrame, vectors: DataFrame, categories: DataFrame) -> DataFrame:
    """Items with their vector, null when there is none."""
    return items_with_category(images, categories).join(
        vectors.select("image_id", "embedding"), "image_id", "left"
    )


def prototypes_with_names(prototypes: DataFrame, categories: DataFrame) -> DataFrame:
    """Prototypes with the category's name or a stand-in for it."""
    return prototypes.join(_names(categories), "category_id", "left").withColumn(
        "category_name", category_label("category_name", "category_id")
    )
