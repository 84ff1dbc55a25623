"""Filters, listings and checks of single tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.scalars import metadata_field

# Fixed values of the upload rules.
CONTENT_TYPE_PREFIX = "image/"
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
NOT_AN_IMAGE = "File must be an image"
TOO_LARGE = "File too large"


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    """The rows with one key value; the filter reaches the scan."""
    return table.filter(F.col(key) == value)


def lookup_many(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key occurs in ``wanted``."""
    return table.join(wanted.select(key), key, "left_semi")


def metadata_matches(images: DataFrame, **fields: str) -> DataFrame:
    """Items whose metadata holds all the given field values."""
    rows = images
    for name, value in fields.items():
        rows = rows.filter(metadata_field("metadata", name) == value)
    return rows


def older_than(queue: DataFrame, column: str, as_of, interval: str = "1 HOUR") -> DataFrame:
    """Queue entries from before ``as_of`` less the interval; these may be purged."""
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {interval}")
    return queue.filter(F.col(column) < limit)


def purge(queue: DataFrame, column: str, as_of, interval: str = "1 HOUR") -> DataFrame:
    """The queue without its entries from before ``as_of`` less the interval."""
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {interval}")
    return queue.filter(~(F.col(column) < limit) | F.col(column).isNull())


def not_indexed(vectors: DataFrame) -> DataFrame:
    """Vectors that no index holds yet."""
    return vectors.filter(F.col("index_id").isNull())


def check_uploads(uploads: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Uploads (content_type, size) with the reason for rejecting them, null when
    they pass; an absent size passes."""
    is_image = F.coalesce(F.col("content_type").startswith(CONTENT_TYPE_PREFIX), F.lit(False))
    return uploads.withColumn(
        "reject_reason",
        F.when(~is_image, F.lit(NOT_AN_IMAGE))
        .when(F.col("size") > max_bytes, F.lit(TOO_LARGE)),
    )


def accepted_uploads(uploads: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    return check_uploads(uploads, max_bytes).filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected_uploads(uploads: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    return check_uploads(uploads, max_bytes).filter(F.col("reject_reason").isNotNull())


def latest_index(indexes: DataFrame) -> DataFrame:
    """The registry row with the largest id."""
    return indexes.orderBy(F.desc("index_id")).limit(1)


def listing(table: DataFrame, key: str) -> DataFrame:
    """The whole table in key order."""
    return table.orderBy(key)
