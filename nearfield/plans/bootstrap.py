"""Bringing a catalog from raw items to a searchable index."""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.ann import VectorIndex, search_index
from nearfield.operators.ids import allocate_ids
from nearfield.operators.maintenance import embed_missing, rebuild_index
from nearfield.operators.prototypes import all_prototypes
from nearfield.operators.reports import catalog_status
from nearfield.sources.index_store import load_index, save_index
from nearfield.sources.sinks import conform
from nearfield.session import cut_lineage


@dataclass
class Bootstrapped:
    catalog: dict[str, DataFrame]
    index: VectorIndex
    errors: DataFrame
    status: DataFrame


def bootstrap(catalog: dict[str, DataFrame], embedder: Callable[[list[bytes]], np.ndarray],
              index_path: str, index_type: str = "flatl2", *, nlist: int = 100) -> Bootstrapped:
    """Embed what lacks a vector, compute all prototypes, build and store the
    index, and report the catalog's status."""
    images, vectors = catalog["images"], catalog["vectors"]
    embedded = embed_missing(images, vectors, embedder)
    fresh = conform(allocate_ids(embedded.vectors, vectors, "vector_id", order_by="image_id"), "vectors")
    vectors = vectors.unionByName(fresh)
    prototypes = cut_lineage(all_prototypes(vectors, images))
    rebuilt = rebuild_index(vectors, images, catalog["indexes"], index_path, index_type, nlist=nlist)
    save_index(rebuilt.index, index_path)
    done = catalog | {
        "vectors": rebuilt.vectors, "prototypes": prototypes, "indexes": rebuilt.indexes,
    }
    index = load_index(images.sparkSession, index_path)
    return Bootstrapped(done, index, embedded.errors, catalog_status(done))


def system_check(catalog: dict[str, DataFrame], index: VectorIndex, k: int = 5) -> DataFrame:
    """The catalog's status with the outcome of a trial search: the vector of
    the first item is looked up in the index, and should find itself."""
    first = catalog["vectors"].select(F.col("image_id").alias("query_id"), "embedding").orderBy("query_id").limit(1)
    found = search_index(first, index, k).agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.coalesce(F.bool_or((F.col("image_id") == F.col("query_id")) & (F.col("rank") == 1)), F.lit(False)).alias("self"),
    ).first()
    return catalog_status(catalog).withColumns({
        "trial_hits": F.lit(found["n_hits"]).cast("long"), "trial_found_itself": F.lit(found["self"]),
    })
