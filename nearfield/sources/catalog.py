"""Reading the catalog tables and raw items."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.scalars import CATEGORY_NAMES, label_to_category, metadata_json
from nearfield.schemas import CATALOG, CATEGORIES


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One catalog table with its declared schema; no inference pass over the files."""
    return spark.read.schema(CATALOG[name]).parquet(f"{folder}/{name}")


def read_catalog(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All seven catalog tables, typed."""
    return {name: read_table(spark, folder, name) for name in CATALOG}


def default_categories(spark: SparkSession) -> DataFrame:
    """The ten named categories, none with items yet."""
    rows = [(i, name, 0) for i, name in enumerate(CATEGORY_NAMES, 1)]
    return spark.createDataFrame(rows, CATEGORIES)


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Raw item files below ``folder``: path, content, length, modification time."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
    )


def ingest_items(src: DataFrame, split: str, limit: int | None = None, *, source: str,
                 description: str, file_format: str = "PNG",
                 split_column: Column | None = None) -> DataFrame:
    """Items (item_index, content, category_id, metadata) of one split of labelled
    content (item_index, content, label).

    ``limit`` keeps the first n by item_index. With ``split_column`` the rows of
    ``split`` are chosen from ``src``; without it ``src`` is that split.
    """
    rows = src if split_column is None else src.filter(split_column == split)
    if limit is not None:
        rows = rows.orderBy("item_index").limit(limit)
    metadata = metadata_json(
        F.lit(source).alias("source"),
        F.col("item_index").alias("image_index"),
        F.lit(split).alias("split"),
        F.lit(description).alias("description"),
        F.lit(file_format).alias("format"),
    )
    return rows.select(
        "item_index", "content", label_to_category("label").alias("category_id"),
        metadata.alias("metadata"),
    )


def item_payload(images: DataFrame, image_id: int) -> DataFrame:
    """The content of one item."""
    return images.filter(F.col("image_id") == image_id).select("image_id", "content")
