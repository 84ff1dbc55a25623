"""What a search or upload request does, for whole batches of requests."""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.scalars import content_sha256, metadata_json
from nearfield.operators.ann import VectorIndex, index_add
from nearfield.operators.ids import allocate_ids
from nearfield.operators.lookups import accepted_uploads, rejected_uploads
from nearfield.operators.maintenance import EmbedResult, dedupe_append, embed_contents
from nearfield.operators.prototypes import predict_category
from nearfield.sources.sinks import conform

# Where uploaded items say they come from, and why one is turned away.
UPLOAD_SOURCE = "api"
DUPLICATE = "Duplicate image detected"

Embedder = Callable[[list[bytes]], np.ndarray]


def _embed(requests: DataFrame, key: str, embedder: Embedder) -> EmbedResult:
    result = embed_contents(requests.select(F.col(key).alias("image_id"), "content"), embedder)
    return EmbedResult(
        result.vectors.withColumnRenamed("image_id", key),
        result.errors.select(F.col("image_id").alias(key), F.col("error").alias("reject_reason")),
    )


def embed_queries(requests: DataFrame, embedder: Embedder) -> tuple[DataFrame, DataFrame]:
    """Queries (query_id, embedding) of requests (query_id, content, content_type,
    size), and the rejected ones with their reason."""
    rejected = rejected_uploads(requests).select("query_id", "reject_reason")
    embedded = _embed(accepted_uploads(requests), "query_id", embedder)
    return embedded.vectors, rejected.unionByName(embedded.errors)


@dataclass
class Uploaded:
    """New items and vectors, the changes they cause, the grown index, rejected
    uploads, and which item each upload became."""

    images: DataFrame
    vectors: DataFrame
    changes: DataFrame
    index: VectorIndex | None
    rejected: DataFrame
    placed: DataFrame


def upload(uploads: DataFrame, images: DataFrame, vectors: DataFrame, prototypes: DataFrame,
           embedder: Embedder, as_of, index: VectorIndex | None = None) -> Uploaded:
    """Take in uploads (upload_id, content, content_type, size, filename,
    category_id): validate, embed, place those without a category by their
    nearest prototype, give ids, and add the vectors to the index.

    An upload that is no image, too large, a duplicate or beyond the embedder
    is returned with its reason; the others go on.
    """
    valid = accepted_uploads(uploads)
    embedded = _embed(valid, "upload_id", embedder)
    usable = valid.join(embedded.vectors, "upload_id").withColumn("content_hash", content_sha256("content"))
    fresh = dedupe_append(usable, images, order_by="upload_id")

    unplaced = fresh.accepted.filter(F.col("category_id").isNull())
    predicted = predict_category(
        unplaced.select(F.col("upload_id").alias("image_id"), "embedding"), prototypes
    ).select(F.col("image_id").alias("upload_id"), "predicted_category")
    metadata = metadata_json("filename", "content_type", F.lit(UPLOAD_SOURCE).alias("upload_source"))
    placed = fresh.accepted.join(predicted, "upload_id", "left").withColumns({
        "category_id": F.coalesce("category_id", "predicted_category"), "metadata": metadata,
    })
    items = allocate_ids(placed, images, "image_id", order_by="upload_id")
    new_vectors = allocate_ids(items.select("image_id", "embedding"), vectors, "vector_id", order_by="image_id")

    duplicates = fresh.rejected.select("upload_id", F.lit(DUPLICATE).alias("reject_reason"))
    rejected = rejected_uploads(uploads).select("upload_id", "reject_reason")
    return Uploaded(
        images=conform(items, "images"),
        vectors=conform(new_vectors, "vectors"),
        changes=items.select(
            "image_id", "category_id", F.lit("INSERT").alias("op"), F.lit(as_of).cast("timestamp").alias("ts")
        ),
        index=None if index is None else index_add(index, new_vectors),
        rejected=rejected.unionByName(embedded.errors).unionByName(duplicates),
        placed=items.select("upload_id", "image_id"),
    )
