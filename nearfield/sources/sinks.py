"""Writing and appending catalog tables."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.scalars import content_sha256
from nearfield.operators.ids import allocate_ids
from nearfield.operators.prototypes import vectors_with_category
from nearfield.operators.upsert import KeyTakenError
from nearfield.schemas import CATALOG
from nearfield.session import cut_lineage


def conform(df: DataFrame, name: str) -> DataFrame:
    """The declared columns of a catalog table, cast to their types; absent ones are null."""
    return df.select(*[
        (F.col(field.name) if field.name in df.columns else F.lit(None)).cast(field.dataType).alias(field.name)
        for field in CATALOG[name]
    ])


def write_table(df: DataFrame, folder: str, name: str) -> None:
    """Write a catalog table to a new folder."""
    conform(df, name).write.mode("error").parquet(f"{folder}/{name}")


def write_catalog(tables: dict[str, DataFrame], folder: str) -> None:
    for name in CATALOG:
        write_table(tables[name], folder, name)


@dataclass
class Appended:
    """Rows written, and rows refused with the reason (null, repeated, exists or unknown)."""

    accepted: DataFrame
    rejected: DataFrame


def append_items(new: DataFrame, folder: str, *, order_by: str = "content_hash") -> DataFrame:
    """Append items (content, metadata, category_id) under fresh ids; returns the rows written."""
    spark = new.sparkSession
    if "content_hash" not in new.columns:
        new = new.withColumn("content_hash", content_sha256("content"))
    existing = spark.read.schema(CATALOG["images"]).parquet(f"{folder}/images")
    rows = conform(allocate_ids(new, existing, "image_id", order_by=order_by), "images")
    rows.write.mode("append").parquet(f"{folder}/images")
    return rows


def judge_vectors(new: DataFrame, existing: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """``new`` (image_id, embedding, ...) with the column ``reason``: why an item can't have this vector, or null.

    An item has one vector at most, and neither may be null. Of several new vectors of an item the first by its values
    is taken. With ``images`` an item has to be there. Existing rows take part by their id only.
    """
    keys = existing.select("image_id", F.lit(True).alias("_held")).distinct()
    rest = [c for c in new.columns if c != "image_id"]
    marked = new.withColumn("_mark", F.xxhash64(*new.columns)).withColumn("_null", F.col("image_id").isNull() | F.col("embedding").isNull())
    numbered = cut_lineage(marked).withColumn("_row", F.monotonically_increasing_id())
    first = numbered.filter(~F.col("_null")).groupBy("image_id").agg(F.min(F.struct("_mark", "_row")).alias("_first"))
    judged = numbered.join(first, "image_id", "left").join(keys, "image_id", "left")
    unknown = F.lit(False)
    if images is not None:
        judged = judged.join(images.select("image_id", F.lit(True).alias("_item")).distinct(), "image_id", "left")
        unknown = F.col("_item").isNull()
    reason = (
        F.when(F.col("_null"), "null").when(F.col("_held"), "exists").when(unknown, "unknown")
        .when(F.col("_row") != F.col("_first._row"), "repeated"))
    return judged.select("image_id", *rest, reason.alias("reason"))


def append_vectors(new: DataFrame, folder: str, *, on_conflict: str = "error", images: DataFrame | None = None) -> Appended:
    """Append vectors (image_id, embedding[, index_id]) under fresh ids.

    Rows that an item can't have (``judge_vectors``) are refused: with 'error' nothing is written and KeyTakenError is
    raised, with 'skip' the others are written and the refused ones returned.
    """
    if on_conflict not in ("error", "skip"):
        raise ValueError("on_conflict must be 'error' or 'skip'")
    spark = new.sparkSession
    existing = spark.read.schema(CATALOG["vectors"]).parquet(f"{folder}/vectors")
    judged = cut_lineage(judge_vectors(new, existing, images))
    rejected = judged.filter(F.col("reason").isNotNull())
    if on_conflict == "error":
        clash = rejected.select("image_id", "reason").first()
        if clash is not None:
            raise KeyTakenError(f"vector of item {clash['image_id']}: {clash['reason']}")
    good = judged.filter(F.col("reason").isNull()).drop("reason")
    rows = cut_lineage(conform(allocate_ids(good, existing, "vector_id", order_by="image_id"), "vectors"))
    rows.write.mode("append").parquet(f"{folder}/vectors")
    return Appended(rows, rejected)


def write_members(vectors: DataFrame, images: DataFrame, folder: str) -> None:
    """Write vectors beside their category, one folder per category.

    Prototypes and category-restricted searches then read only the categories
    they need and join nothing. A large category is split over several tasks.
    """
    members = vectors_with_category(vectors, images).hint("rebalance", F.col("category_id"))
    members.write.mode("error").partitionBy("category_id").parquet(folder)


def read_members(spark: SparkSession, folder: str) -> DataFrame:
    schema = "image_id bigint, embedding array<float>, category_id int"
    return spark.read.schema(schema).parquet(folder)


def save_bucketed(table: DataFrame, name: str, buckets: int, key: str = "image_id") -> DataFrame:
    """Save as a table bucketed by ``key``; tables with equal buckets join on
    it without a shuffle."""
    table.write.mode("error").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return table.sparkSession.table(name)
