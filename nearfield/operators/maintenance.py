"""Change-driven upkeep of prototypes, indexes and the catalog itself.

Every operator returns new snapshots; nothing is written over what it reads.
"""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from nearfield.functions.scalars import content_sha256
from nearfield.operators.ann import VectorIndex, build_index, flat_build
from nearfield.operators.bounds import bounded, carried
from nearfield.operators.joins import without_vectors
from nearfield.operators.prototypes import prototypes_of
from nearfield.operators.reports import apply_count_changes
from nearfield.operators.upsert import upsert_prototypes
from nearfield.session import arrow_batches, cut_lineage


# Queues

def recompute_queue(changes: DataFrame, images: DataFrame | None = None,
                    queue: DataFrame | None = None) -> DataFrame:
    """Stale categories with the time of their latest change.

    A change (image_id, category_id, op, ts) that carries no category takes the
    one its item has in ``images``; without either it is left out.
    """
    latest = cut_lineage(
        changes.groupBy("image_id", "category_id").agg(F.max("ts").alias("last_updated"))
    )
    rows = latest.filter(F.col("category_id").isNotNull()).select(F.col("category_id").cast("int"), "last_updated")
    if images is not None:
        open_items = bounded(latest.filter(F.col("category_id").isNull()).select("image_id", "last_updated"))
        placed = open_items.join(images.select("image_id", "category_id"), "image_id")
        rows = rows.unionByName(placed.select("category_id", "last_updated"))
    if queue is not None:
        rows = rows.unionByName(queue)
    return rows.filter(F.col("category_id").isNotNull()).groupBy("category_id").agg(F.max("last_updated").alias("last_updated"))


def deletion_queue(changes: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """Items whose vector was deleted, with the time of the first deletion; an
    item queued before keeps its entry."""
    deleted = (
        changes.filter((F.col("op") == "DELETE") & F.col("image_id").isNotNull())
        .groupBy("image_id")
        .agg(F.min("ts").alias("queued_at"))
    )
    if queue is None:
        return deleted
    return queue.unionByName(deleted.join(queue, "image_id", "left_anti"))


# Draining

@dataclass
class RecomputeDrain:
    """prototypes after the drain, queue rows done, queue rows still pending."""

    prototypes: DataFrame
    done: DataFrame
    pending: DataFrame


def drain_recompute(queue: DataFrame, vectors: DataFrame, images: DataFrame,
                    prototypes: DataFrame) -> RecomputeDrain:
    """Recompute the queued categories. A category without vectors stays
    pending and keeps its old prototype."""
    fresh = cut_lineage(prototypes_of(queue, vectors, images))
    return RecomputeDrain(
        upsert_prototypes(prototypes, fresh),
        queue.join(fresh, "category_id", "left_semi"),
        queue.join(fresh, "category_id", "left_anti"),
    )


def register_index(indexes: DataFrame, vectors: DataFrame, index_type: str, path: str, *,
                   dim: int, ntotal: int) -> tuple[DataFrame, DataFrame]:
    """The registry with one more row, and the vectors with that index id
    wherever they had none; vectors of an older index keep it."""
    last = indexes.agg(F.coalesce(F.max("index_id"), F.lit(0)).alias("last")).first()["last"]
    row = (last + 1, index_type, path, dim, ntotal)
    added = indexes.sparkSession.createDataFrame([row], indexes.schema)
    filled = vectors.withColumn("index_id", F.coalesce("index_id", F.lit(last + 1).cast("int")))
    return indexes.unionByName(added), filled


@dataclass
class IndexRebuild:
    """The new index, the registry with its row, the vectors pointing at it,
    and the queue entries the rebuild has settled."""

    index: VectorIndex
    indexes: DataFrame
    vectors: DataFrame
    settled: DataFrame | None = None

    def remaining(self, queue: DataFrame) -> DataFrame:
        """The current queue less the entries settled here; later ones stay."""
        return queue.join(self.settled.select("image_id"), "image_id", "left_anti")


def _rebuild(vectors: DataFrame, kept: DataFrame, indexes: DataFrame, index_type: str, path: str,
             nlist: int) -> IndexRebuild:
    ntotal = kept.count()
    items = kept.select("image_id", "embedding")
    if ntotal:
        index = build_index(items, index_type, nlist=nlist)
    else:  # nothing is left: an empty index of the dimension known so far
        last = indexes.agg(F.max_by("dim", "index_id").alias("dim")).first()["dim"]
        index = flat_build(items, dim=last or 0)
        index_type = index.index_type
    registry, filled = register_index(
        indexes, vectors, index_type, path, dim=index.dim, ntotal=ntotal
    )
    return IndexRebuild(index, registry, filled)


def rebuild_index(vectors: DataFrame, images: DataFrame, indexes: DataFrame, path: str,
                  index_type: str = "flatl2", *, nlist: int = 100) -> IndexRebuild:
    """Index every stored vector whose item exists."""
    kept = vectors.join(images.select("image_id"), "image_id", "left_semi")
    return _rebuild(vectors, kept, indexes, index_type, path, nlist)


def drain_deletions(queue: DataFrame, vectors: DataFrame, images: DataFrame, indexes: DataFrame,
                    path: str, index_type: str = "flatl2", *, nlist: int = 100,
                    readded: DataFrame | None = None) -> IndexRebuild | None:
    """Rebuild the index from stored vectors without the queued items, save
    those added again since (``readded``); None when nothing is queued."""
    settled = cut_lineage(queue)
    if settled.isEmpty():
        return None
    doomed = settled if readded is None else settled.join(readded, "image_id", "left_anti")
    doomed = bounded(doomed.select("image_id"))
    live = vectors.join(doomed, "image_id", "left_anti")
    kept = live.join(images.select("image_id"), "image_id", "left_semi")
    result = _rebuild(live, kept, indexes, index_type, path, nlist)
    result.settled = settled
    return result


# Deleting

def delete_items(catalog: dict[str, DataFrame], ids: DataFrame, as_of) -> dict[str, DataFrame]:
    """The catalog without the given items (image_id): their vectors are queued
    and dropped, their categories marked stale and counted down."""
    images, vectors = catalog["images"], catalog["vectors"]
    now = F.lit(as_of).cast("timestamp")
    ids = bounded(ids.select("image_id").distinct())
    doomed = bounded(images.select("image_id", "category_id").join(ids, "image_id", "left_semi"))
    lost = vectors.select("image_id").join(doomed, "image_id", "left_semi")
    changes = lost.select("image_id", F.lit("DELETE").alias("op"), now.alias("ts"))
    stale = doomed.filter(F.col("category_id").isNotNull()).select("category_id", now.alias("last_updated"))
    counted = doomed.select("category_id", F.lit("DELETE").alias("op"))
    queued = catalog["recompute_queue"].unionByName(stale)
    return catalog | {
        "categories": apply_count_changes(catalog["categories"], counted),
        "images": images.join(ids, "image_id", "left_anti"),
        "vectors": vectors.join(doomed, "image_id", "left_anti"),
        "recompute_queue": queued.groupBy("category_id").agg(F.max("last_updated").alias("last_updated")),
        "deletion_queue": deletion_queue(changes, catalog["deletion_queue"]),
    }


def delete_categories(catalog: dict[str, DataFrame], ids: DataFrame, as_of) -> dict[str, DataFrame]:
    """The catalog without the given categories (category_id) and all that
    belongs to them; their vectors are queued for removal from the index."""
    gone = ids.select("category_id")
    doomed = bounded(catalog["images"].join(gone, "category_id", "left_semi").select("image_id"))
    lost = catalog["vectors"].select("image_id").join(doomed, "image_id", "left_semi")
    changes = lost.select(
        "image_id", F.lit("DELETE").alias("op"), F.lit(as_of).cast("timestamp").alias("ts")
    )
    return catalog | {
        "categories": catalog["categories"].join(gone, "category_id", "left_anti"),
        "prototypes": catalog["prototypes"].join(gone, "category_id", "left_anti"),
        "recompute_queue": catalog["recompute_queue"].join(gone, "category_id", "left_anti"),
        "images": catalog["images"].join(gone, "category_id", "left_anti"),
        "vectors": catalog["vectors"].join(doomed, "image_id", "left_anti"),
        "deletion_queue": deletion_queue(changes, catalog["deletion_queue"]),
    }


def drop_index(indexes: DataFrame, vectors: DataFrame, index_id: int) -> tuple[DataFrame, DataFrame]:
    """Registry without the index; its vectors belong to none."""
    cleared = F.when(F.col("index_id") == index_id, F.lit(None)).otherwise(F.col("index_id"))
    return indexes.filter(F.col("index_id") != index_id), vectors.withColumn("index_id", cleared)


# Adding

class DuplicateContentError(ValueError):
    """Raised by ``dedupe_append`` in 'error' mode."""


@dataclass
class DedupeResult:
    """Items to take, items whose content is there already, and items without content."""

    accepted: DataFrame
    rejected: DataFrame
    absent: DataFrame


def dedupe_append(new: DataFrame, existing: DataFrame, on_duplicate: str = "skip", *,
                  order_by: str = "image_id") -> DedupeResult:
    """New items whose content occurs neither in ``existing`` nor earlier in ``new``.

    An item without content is neither accepted nor a duplicate.
    Of equal contents the first by ``order_by`` (unique within ``new``) is
    accepted. Only hashes and keys are shuffled to find the duplicates: one
    pre-aggregated row per hash, then hash and key together, so a content
    repeated millions of times does not gather in one task.
    """
    if on_duplicate not in ("skip", "error"):
        raise ValueError("on_duplicate must be 'skip' or 'error'")
    computed = content_sha256("content")
    if "content_hash" in new.columns:
        computed = F.coalesce("content_hash", computed)
    every = new.withColumn("content_hash", computed)
    hashed = every.filter(F.col("content_hash").isNotNull())
    keys = cut_lineage(hashed.select("content_hash", order_by))
    first = (
        keys.groupBy("content_hash")
        .agg(F.min(order_by).alias(order_by))
        .join(existing.select("content_hash"), "content_hash", "left_anti")
    )
    surplus = cut_lineage(keys.join(first, ["content_hash", order_by], "left_anti").select(order_by))
    surplus = carried(surplus) if isinstance(surplus.schema[order_by].dataType, NumericType) else bounded(surplus)
    accepted = hashed.join(surplus, order_by, "left_anti")
    rejected = hashed.join(surplus, order_by, "left_semi")
    if on_duplicate == "error":
        clash = rejected.select("content_hash").first()
        if clash is not None:
            raise DuplicateContentError(f"duplicate content (hash: {clash['content_hash']})")
    return DedupeResult(accepted, rejected, every.filter(F.col("content_hash").isNull()))


@dataclass
class EmbedResult:
    vectors: DataFrame
    errors: DataFrame


def embed_missing(images: DataFrame, vectors: DataFrame,
                  embedder: Callable[[list[bytes]], np.ndarray], *, batch_size: int = 64) -> EmbedResult:
    """Vectors (image_id, embedding) for the items that have none."""
    missing = without_vectors(images.select("image_id", "content"), vectors)
    return embed_contents(missing, embedder, batch_size=batch_size)


def embed_contents(items: DataFrame, embedder: Callable[[list[bytes]], np.ndarray], *,
                   batch_size: int = 64) -> EmbedResult:
    """Vectors (image_id, embedding) of items (image_id, content).

    ``embedder`` turns a list of contents into a matrix. When it fails on a
    batch the items are tried one by one, and those that fail alone are
    returned as errors (image_id, error). Embeddings are computed once and kept
    in the shared folder.
    """
    def attempt(contents):
        matrix = np.asarray(embedder(contents), dtype=np.float32)
        if matrix.ndim != 2 or len(matrix) != len(contents):
            raise ValueError(f"embedder returned shape {matrix.shape} for {len(contents)} items")
        return list(matrix)

    def embed(contents):
        try:
            return attempt(contents), [None] * len(contents)
        except Exception:
            embedded, errors = [], []
            for content in contents:
                try:
                    embedded.append(attempt([content])[0])
                    errors.append(None)
                except Exception as failure:
                    embedded.append(None)
                    errors.append(f"{type(failure).__name__}: {failure}")
            return embedded, errors

    def run(batches):
        for batch in batches:
            embedded, errors = embed(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(embedded, pa.list_(pa.float32())), pa.array(errors, pa.string())],
                names=["image_id", "embedding", "error"],
            )

    with arrow_batches(items.sparkSession, batch_size):
        done = cut_lineage(items.select("image_id", "content").mapInArrow(run, "image_id bigint, embedding array<float>, error string"))
    return EmbedResult(
        done.filter(F.col("error").isNull()).select("image_id", "embedding"),
        done.filter(F.col("error").isNotNull()).select("image_id", "error"),
    )
