"""Spark schemas of the catalog tables."""

from pyspark.sql import types as T

CATEGORIES = T.StructType([
    T.StructField("category_id", T.IntegerType()),
    T.StructField("category_name", T.StringType()),
    T.StructField("image_count", T.LongType()),
])

IMAGES = T.StructType([
    T.StructField("image_id", T.LongType()),
    T.StructField("content", T.BinaryType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("category_id", T.IntegerType()),
    T.StructField("content_hash", T.StringType()),
])

VECTORS = T.StructType([
    T.StructField("vector_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("index_id", T.IntegerType()),
    T.StructField("image_id", T.LongType()),
])

PROTOTYPES = T.StructType([
    T.StructField("category_id", T.IntegerType()),
    T.StructField("prototype", T.ArrayType(T.FloatType())),
    T.StructField("n_vectors", T.LongType()),
])

INDEXES = T.StructType([
    T.StructField("index_id", T.IntegerType()),
    T.StructField("index_type", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("dim", T.IntegerType()),
    T.StructField("ntotal", T.LongType()),
])

RECOMPUTE_QUEUE = T.StructType([
    T.StructField("category_id", T.IntegerType()),
    T.StructField("last_updated", T.TimestampType()),
])

DELETION_QUEUE = T.StructType([
    T.StructField("image_id", T.LongType()),
    T.StructField("queued_at", T.TimestampType()),
])

# One row per change of a vector; ``category_id`` is the category the item had
# when the change happened, so a deleted item still marks its category stale.
CHANGES = T.StructType([
    T.StructField("image_id", T.LongType()),
    T.StructField("category_id", T.IntegerType()),
    T.StructField("op", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

CATALOG = {
    "categories": CATEGORIES,
    "images": IMAGES,
    "vectors": VECTORS,
    "prototypes": PROTOTYPES,
    "indexes": INDEXES,
    "recompute_queue": RECOMPUTE_QUEUE,
    "deletion_queue": DELETION_QUEUE,
}
