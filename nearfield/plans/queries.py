"""Every operator as a query over the sample tables."""

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import scalars as S
from nearfield.functions import vectors as V
from nearfield.operators import ann, integrity, joins, knn, lookups, maintenance, pivots, reports, upsert
from nearfield.operators import prototypes as P
from nearfield.operators import search as two_stage
from nearfield.operators.bounds import bounded
from nearfield.operators.ids import allocate_ids
from nearfield.plans import requests
from nearfield.plans.bootstrap import bootstrap, system_check
from nearfield.session import cut_lineage, scratch_path, ship_package
from nearfield.sources import sinks
from nearfield.sources.catalog import ingest_items, item_payload, read_catalog
from nearfield.sources.index_store import append_to_index, load_index, replace_in_index, save_index
from nearfield.sources.sample import SampleCatalog
from nearfield.streaming import queues
from nearfield.streaming.upkeep import Upkeep, drain_now, run_maintenance

QUERIES = {}

# Looked-up keys and instants of the point queries.
ITEM, CATEGORY, INDEX = 42, 3, 2
AS_OF = "2024-01-03 00:00:00"
# Cells of the sample indexes; well below the number of vectors.
NLIST = 16


def query(fn):
    """Register ``fn(sample) -> DataFrame`` under its own name."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return fn(SampleCatalog(spark, folder))

    QUERIES[fn.__name__] = run
    return fn


def r6(column):
    """A double as the oracle prints it: six decimals, no negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, 6) + F.lit(0.0)


def long_prototypes(prototypes: DataFrame) -> DataFrame:
    return V.to_long(prototypes, "category_id", "prototype", "x").select(
        "category_id", "pos", r6("x").alias("value")
    )


def shown_hits(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", F.col("rank").cast("int").alias("rank"), "image_id",
        r6("distance").alias("distance"),
    )


def plain_time(column):
    return F.col(column).cast("timestamp_ntz").alias(column)


def items_to_own_prototype(c: SampleCatalog) -> DataFrame:
    return P.with_own_prototype(c.vectors(), c.images(), c.prototypes())


# A. Sources and sinks

@query
def a1_read_catalog(c):
    folder = scratch_path(c.spark, "catalog")
    sinks.write_catalog(c.all(), folder)
    keys = {
        "categories": "category_id", "images": "image_id", "vectors": "vector_id",
        "prototypes": "category_id", "indexes": "index_id",
        "recompute_queue": "category_id", "deletion_queue": "image_id",
    }
    return reduce(DataFrame.unionByName, [
        table.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(keys[name]).cast("long").alias("key_sum"))
        .withColumn("table_name", F.lit(name))
        for name, table in read_catalog(c.spark, folder).items()
    ])


@query
def a2_ingest_items(c):
    src = c.table("documents").select(
        F.col("doc_id").alias("item_index"), F.encode("text", "UTF-8").alias("content"),
        F.pmod("doc_id", F.lit(10)).alias("label"), "lang",
    )
    items = ingest_items(
        src, "en", source="sample", description="text item", file_format="TXT", split_column=F.col("lang")
    )
    return items.select("item_index", "category_id", "metadata", S.content_sha256("content").alias("content_hash"))


@query
def a3_append_items(c):
    folder = scratch_path(c.spark, "items")
    sinks.write_table(c.images(), folder, "images")
    new = c.table("benchmark").select(
        F.encode("text", "UTF-8").alias("content"), F.lit("{}").alias("metadata"), F.lit(1).alias("category_id")
    )
    sinks.append_items(new, folder)
    return c.spark.read.parquet(f"{folder}/images").select("image_id", "category_id", "content_hash")


@query
def a3_append_vectors(c):
    folder = scratch_path(c.spark, "vectors")
    sinks.write_table(c.vectors(), folder, "vectors")
    missing = joins.items_without_vectors(c.images(), c.vectors(), c.categories())
    new = missing.join(bounded(c.prototypes(), knn.MAX_BROADCAST_ROWS), "category_id").select("image_id", F.col("prototype").alias("embedding"))
    sinks.append_vectors(new, folder)
    return c.spark.read.parquet(f"{folder}/vectors").select("vector_id", "image_id", "index_id")


@query
def a3_append_vectors_refused(c):
    """Vectors of items that have one, that aren't there, or that come twice, beside some that are taken."""
    folder = scratch_path(c.spark, "vectors")
    held, new = c.vectors().filter("image_id % 3 = 0"), c.vectors().filter("image_id % 3 < 2").select("image_id", "embedding")
    sinks.write_table(held, folder, "vectors")
    twice = new.filter("image_id % 3 = 1 AND image_id % 5 = 0")
    absent = new.filter("image_id % 3 = 1").select((F.col("image_id") + 10_000_000).alias("image_id"), "embedding")
    done = sinks.append_vectors(new.unionByName(twice).unionByName(absent), folder, on_conflict="skip", images=c.images())
    refused = done.rejected.select("image_id", F.col("reason").alias("outcome"))
    return done.accepted.select("image_id", F.lit("written").alias("outcome")).unionByName(refused)


@query
def a4_allocate_ids(c):
    new = c.table("events").select("event_id", "event_type")
    return allocate_ids(new, c.vectors(), "vector_id", order_by="event_id")


def _nation_categories(c):
    return c.table("nation").select(
        (F.col("n_nationkey") + 6).cast("int").alias("category_id"), F.col("n_name").alias("category_name")
    )


@query
def a5_upsert_categories_ignore(c):
    return upsert.upsert_categories(c.categories(), _nation_categories(c), "ignore")


@query
def a5_upsert_categories_update(c):
    return upsert.upsert_categories(c.categories(), _nation_categories(c), "update")


@query
def a5_insert_categories(c):
    return upsert.insert_categories(c.categories(), c.table("nation").select(F.col("n_name").alias("category_name")))


@query
def a5_rekey_categories(c):
    moved = c.spark.createDataFrame([(1, 101), (2, 102)], "old int, new int")
    tables = upsert.rekey({"categories": c.categories(), "images": c.images(), "recompute_queue": c.recompute_queue()}, "category_id", moved)
    return reduce(DataFrame.unionByName, [
        rows.groupBy("category_id").agg(F.count("*").alias("n_rows")).withColumn("table_name", F.lit(name)) for name, rows in tables.items()
    ])


@query
def a5_rekey_swapped(c):
    """Two keys change places; nothing else takes them meanwhile."""
    moved = c.spark.createDataFrame([(1, 2), (2, 1)], "old int, new int")
    return upsert.rekey({"categories": c.categories()}, "category_id", moved)["categories"].select("category_id", "category_name")


@query
def a5_upsert_vectors(c):
    """Every second item gets the vector of the item before it; some items get their first one."""
    held = c.vectors().filter("image_id % 7 > 0")
    new = c.vectors().select((F.col("image_id") + 1).alias("image_id"), "embedding").filter("image_id % 2 = 0")
    merged = upsert.upsert_vectors(held, new)
    return merged.select("vector_id", "image_id", "index_id", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("x"))


@query
def a6_upsert_prototypes(c):
    german = lookups.metadata_matches(c.images(), lang="de")
    newer = P.all_prototypes(c.vectors(), german)
    return long_prototypes(upsert.upsert_prototypes(c.prototypes(), newer))


@query
def a7_index_round_trip(c):
    path = scratch_path(c.spark, "index")
    save_index(ann.ivf_build(c.vectors().select("image_id", "embedding"), NLIST), path)
    index = load_index(c.spark, path)
    return index.cells.select(
        "image_id", F.size("embedding").alias("dim"), F.lit(index.index_type).alias("index_type")
    )


@query
def a8_parse_vector_text(c):
    text = F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<string>"), ","), F.lit("]"))
    as_text = c.vectors().select("image_id", text.alias("embedding"))
    parsed = V.parse_vector_text(as_text, "embedding")
    return V.to_long(parsed, "image_id", "embedding", "x").select("image_id", "pos", r6("x").alias("value"))


@query
def a9_item_payload(c):
    return item_payload(c.images(), ITEM).select("image_id", F.decode("content", "UTF-8").alias("text"))


# B. Projections, filters, predicates

@query
def b1_lookup_item(c):
    found = joins.items_with_category(lookups.lookup(c.images(), "image_id", ITEM), c.categories())
    return found.select("image_id", "category_id", "category_name", "metadata", "content_hash")


@query
def b1_lookup_category(c):
    return lookups.lookup(c.categories(), "category_id", CATEGORY)


@query
def b1_lookup_prototype(c):
    return long_prototypes(lookups.lookup(c.prototypes(), "category_id", CATEGORY))


@query
def b1_lookup_vector(c):
    found = lookups.lookup(c.vectors(), "image_id", ITEM)
    return V.to_long(found, "image_id", "embedding", "x").select("image_id", "pos", r6("x").alias("value"))


@query
def b1_lookup_index(c):
    return lookups.lookup(c.indexes(), "index_id", INDEX)


@query
def b2_items_of_category(c):
    return joins.items_of_category(c.images(), c.categories(), CATEGORY).select(
        "image_id", "category_id", "category_name", "metadata"
    )


@query
def b3_metadata_count(c):
    found = lookups.metadata_matches(c.images(), source="src3", lang="en")
    return found.agg(F.count(F.lit(1)).alias("n_items"))


@query
def b3_metadata_events(c):
    tagged = c.table("events").withColumnRenamed("props", "metadata")
    return lookups.metadata_matches(tagged, k="9").select("event_id", "user_id")


@query
def b4_stale_queue_entries(c):
    return lookups.older_than(c.deletion_queue(), "queued_at", AS_OF).select("image_id", plain_time("queued_at"))


@query
def b4_purge_queue(c):
    return lookups.purge(c.deletion_queue(), "queued_at", AS_OF).select("image_id", plain_time("queued_at"))


@query
def b5_not_indexed(c):
    return lookups.not_indexed(c.vectors()).select("vector_id", "image_id")


def _uploads(c):
    kind = (
        F.when(F.col("lang") == "en", "image/png").when(F.col("lang") == "de", "image/jpeg")
        .when(F.col("lang") == "fr", "text/html")
    )
    size = F.when(F.col("n_chars") % 7 != 0, F.col("n_chars") * 4000)
    return c.table("documents").select("doc_id", kind.alias("content_type"), size.alias("size"))


@query
def b6_check_uploads(c):
    return lookups.check_uploads(_uploads(c))


@query
def b6_accepted_uploads(c):
    return lookups.accepted_uploads(_uploads(c))


@query
def b6_rejected_uploads(c):
    return lookups.rejected_uploads(_uploads(c))


@query
def b7_public_view(c):
    return two_stage.public_view(joins.items_with_category(c.images(), c.categories()))


# C. Joins

@query
def c1_items_with_category(c):
    return joins.items_with_category(c.images(), c.categories()).select("image_id", "category_id", "category_name")


@query
def c2_vectors_of_category(c):
    found = joins.vectors_of_category(c.vectors(), c.images(), CATEGORY)
    return V.to_long(found, "image_id", "embedding", "x").select("image_id", "pos", r6("x").alias("value"))


@query
def c3_categories_with_items(c):
    return joins.categories_with_items(c.categories(), c.images())


@query
def c4_items_without_vectors(c):
    return joins.items_without_vectors(c.images(), c.vectors(), c.categories()).select(
        "image_id", "category_id", "category_name", "metadata", "total_images_in_category"
    )


@query
def c5_items_with_vector(c):
    found = joins.items_with_vector(c.images(), c.vectors(), c.categories())
    return found.select(
        "image_id", "category_name", F.col("embedding").isNotNull().alias("has_vector"),
        r6(V.l2_norm("embedding")).alias("length"),
    )


@query
def c6_enrich_hits(c):
    hits = knn.exact_hits(c.queries(), c.vectors(), 5)
    return two_stage.enrich_hits(hits, c.images(), c.categories()).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "image_id", "category_id", "category_name", "metadata"
    )


@query
def c7_with_category_total(c):
    return joins.with_category_total(c.images()).select("image_id", "category_id", "total_images_in_category")


@query
def c8_prototypes_with_names(c):
    some = lookups.lookup_many(c.categories(), "category_id", _nation_categories(c))
    return joins.prototypes_with_names(c.prototypes(), some).select("category_id", "category_name", "n_vectors")


@query
def c9_integrity_report(c):
    return integrity.integrity_report(c.all())


@query
def c10_block_join(c):
    """The distance join by blocks, as taken when both sides are large."""
    return shown_hits(knn.exact_hits(c.queries(), c.vectors(), 10, max_broadcast_rows=0, block_rows=200))


@query
def c11_prototype_similarity(c):
    return P.prototype_similarity(c.queries(), c.prototypes()).select(
        "query_id", "category_id", r6("similarity").alias("similarity")
    )


# D. Aggregations

@query
def d1_catalog_status(c):
    return reports.catalog_status(c.all())


@query
def d2_items_per_category(c):
    return reports.items_per_category(c.images())


@query
def d3_category_breakdown(c):
    more = upsert.upsert_categories(c.categories(), _nation_categories(c), "ignore")
    return reports.category_breakdown(more, c.images())


@query
def d4_all_prototypes(c):
    return long_prototypes(c.prototypes())


@query
def d5_prototypes_of(c):
    wanted = _nation_categories(c)
    return long_prototypes(P.prototypes_of(wanted, c.vectors(), c.images()))


@query
def d6_hit_statistics(c):
    stats = knn.hit_statistics(knn.knn_exact(c.queries(), c.vectors(), 10))
    return stats.select("query_id", "n_hits", *[r6(x).alias(x) for x in stats.columns[2:]])


def _item_changes(c):
    """Item changes per category, more deletions than items in some."""
    return c.changes().withColumn("category_id", (F.col("image_id") % 10 + 1).cast("int"))


@query
def d7_apply_count_changes(c):
    return reports.apply_count_changes(c.categories(), _item_changes(c))


@query
def d8_latest_change(c):
    return c.recompute_queue().select("category_id", plain_time("last_updated"))


@query
def d8_first_deletion(c):
    return c.deletion_queue().select("image_id", plain_time("queued_at"))


# E. Ranking, sorting, limits

@query
def e1_nearest_to_prototype(c):
    placed = items_to_own_prototype(c).select(
        "category_id", "image_id", V.squared_l2("embedding", "prototype").alias("distance")
    )
    best = knn.top_hits(placed, 10, group="category_id")
    return best.select(
        "category_id", F.col("rank").cast("int").alias("rank"), "image_id", r6("distance").alias("distance")
    )


@query
def e2_top_categories(c):
    return P.top_categories(c.queries(), c.prototypes(), 3).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "category_id", r6("similarity").alias("similarity")
    )


@query
def e3_best_category(c):
    return P.top_categories(c.queries(), c.prototypes(), 1).select(
        "query_id", "category_id", r6("similarity").alias("similarity")
    )


@query
def e4_latest_index(c):
    return lookups.latest_index(c.indexes())


@query
def e5_item_listing(c):
    return lookups.listing(joins.items_with_category(c.images(), c.categories()), "image_id").select(
        "image_id", "category_name", "content_hash"
    )


@query
def e5_vector_listing(c):
    return lookups.listing(c.vectors(), "image_id").select("image_id", "vector_id", r6(V.l2_norm("embedding")).alias("length"))


@query
def e5_category_listing(c):
    return lookups.listing(c.categories(), "category_id")


@query
def e6_queue_heads(c):
    return reports.queue_heads(c.recompute_queue(), c.deletion_queue(), 20)


@query
def e7_category_items(c):
    return reports.category_items(c.images(), c.categories(), CATEGORY, 50)


# F. Scalar functions

@query
def f1_f4_vector_functions(c):
    return items_to_own_prototype(c).select(
        "image_id", "category_id",
        r6(V.dot("embedding", "prototype")).alias("dot"),
        r6(V.l2_norm("embedding")).alias("length"),
        r6(V.cosine("embedding", "prototype")).alias("cosine"),
        r6(V.squared_l2("embedding", "prototype")).alias("squared_l2"),
    )


@query
def f5_sigmoid_score(c):
    distance = V.squared_l2("embedding", "prototype")
    return items_to_own_prototype(c).select(
        "image_id", r6(V.sigmoid_score(distance)).alias("score"),
        r6(V.sigmoid_score(distance, 1.0, 4.0)).alias("steep_score"),
    )


@query
def f6_percent_text(c):
    events = c.table("events").select("event_id", (F.col("value") / 100).alias("score"))
    return events.select("event_id", S.percent_text("score").alias("percent"))


@query
def f7_content_sha256(c):
    return c.table("pages").select("page_id", S.content_sha256(F.encode("html", "UTF-8")).alias("content_hash"))


@query
def f8_metadata_json(c):
    rows = c.table("documents").select(
        "doc_id", S.metadata_json("source", "lang", "n_chars").alias("metadata")
    )
    return rows.select(
        "doc_id", "metadata", S.metadata_field("metadata", "lang").alias("lang"),
        S.metadata_field("metadata", "n_chars").alias("n_chars"),
        S.metadata_field("metadata", "absent").alias("absent"),
    )


@query
def f9_iso_timestamp(c):
    return c.table("events").select("event_id", S.iso_timestamp("ts").alias("ts_text"))


@query
def f10_coalesce_greatest(c):
    balance = c.table("customer").select(
        F.col("c_custkey").alias("category_id"), F.col("c_acctbal").cast("long").alias("delta"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"),
    )
    return balance.select(
        "category_id", S.floored_count(F.lit(100), "delta").alias("moved"),
        S.category_label("name", "category_id").alias("category_name"),
    )


@query
def f11_label_to_category(c):
    shifted = c.table("embeddings").select("vec_id", S.label_to_category("label").alias("category_id"))
    names = c.categories().select("category_id", "category_name")
    return shifted.join(names, "category_id").select("vec_id", "category_id", "category_name")


# I. Vector search

@query
def i1_knn_exact(c):
    hits = knn.knn_exact(c.queries(), c.vectors(), 10)
    return hits.select(
        "query_id", F.col("rank").cast("int").alias("rank"), "image_id",
        r6("distance").alias("distance"), r6("similarity_score").alias("similarity_score"),
    )


@query
def i1_knn_in_blocks(c):
    """More queries than one block: every block of them scans the items in place."""
    return shown_hits(knn.knn_exact(c.queries(), c.vectors(), 10, max_broadcast_rows=200))


@query
def i1_knn_by_pivots(c):
    """Both sides large: queries go to the items of those pivots only that can hold a near one."""
    return shown_hits(knn.top_hits(pivots.pivot_hits(c.queries(), c.vectors(), 10), 10))


@query
def i1_knn_of_prototypes(c):
    queries = c.prototypes().select(F.col("category_id").cast("long").alias("query_id"), F.col("prototype").alias("embedding"))
    return shown_hits(knn.exact_hits(queries, c.vectors(), 50))


@query
def i2_ivf_search_all_cells(c):
    index = ann.ivf_build(c.vectors().select("image_id", "embedding"), NLIST)
    return shown_hits(ann.ivf_search(c.queries(), index, 10, nprobe=NLIST))


@query
def i2_ivf_search(c):
    centroids = cut_lineage(c.prototypes()).select(F.col("category_id").alias("cell"), F.col("prototype").alias("centroid"))
    index = ann.ivf_build(c.vectors().select("image_id", "embedding"), centroids=centroids)
    return shown_hits(ann.ivf_search(c.queries(), index, 10, nprobe=4))


@query
def i3_ann_lsh(c):
    """Buckets along the axes of the space, so that SQL can name them."""
    return shown_hits(ann.ann_lsh(c.queries(), c.vectors(), 10, projections=np.eye(16, 64)))


@query
def i3_ann_lsh_stored(c):
    """The same search in a stored index: half of the items fitted, the rest appended to its postings."""
    items, path = c.vectors().select("image_id", "embedding"), scratch_path(c.spark, "index")
    save_index(ann.lsh_build(items.filter("image_id % 2 = 0"), ann.HashTables(np.eye(16, 64))), path)
    append_to_index(load_index(c.spark, path), items.filter("image_id % 2 = 1"), path)
    hits = ann.search_index(c.queries(), load_index(c.spark, path), 10)
    return shown_hits(hits)


@query
def i4_search_postfilter(c):
    found = two_stage.search_postfilter(c.queries(), c.vectors(), c.images(), cut_lineage(c.prototypes()), 10, 3)
    return shown_hits(found)


@query
def i5_search_prefilter(c):
    found = two_stage.search_prefilter(c.queries(), c.vectors(), c.images(), cut_lineage(c.prototypes()), 10, 3)
    return shown_hits(found)


@query
def i5_search_prefilter_stored(c):
    folder = scratch_path(c.spark, "members")
    sinks.write_members(c.vectors(), c.images(), folder)
    members = sinks.read_members(c.spark, folder)
    prototypes = cut_lineage(P.all_prototypes(members, c.images()))
    return shown_hits(two_stage.search_prefilter(c.queries(), members, c.images(), prototypes, 10, 3))


@query
def i6_rank_prototypes(c):
    ranked = P.rank_prototypes(c.queries(), c.prototypes(), c.categories())
    return ranked.select(
        "query_id", F.col("rank").cast("int").alias("rank"), "category_id", "category_name",
        r6("similarity").alias("similarity"),
    )


@query
def i7_predict_category(c):
    items = c.vectors().select("image_id", "embedding")
    return P.predict_category(items, c.prototypes()).select(
        "image_id", "predicted_category", r6("similarity").alias("similarity")
    )


def _shown_search(found):
    return found.select(
        "query_id", F.col("rank").cast("int").alias("rank"), "image_id", "category_id", "category_name",
        "metadata", r6("distance").alias("distance"), r6("similarity_score").alias("similarity_score"),
        "used_prototype_filtering",
        F.array_join(F.col("prototype_categories").cast("array<string>"), ",").alias("prototype_categories"),
    )


@query
def i8_search(c):
    return _shown_search(two_stage.search(c.queries(), c.vectors(), c.images(), c.categories()))


@query
def i8_search_with_prototypes(c):
    return _shown_search(two_stage.search(
        c.queries(), c.vectors(), c.images(), c.categories(), cut_lineage(c.prototypes()), use_prototypes=True
    ))


@query
def i8_search_index(c):
    index = ann.ivf_build(c.vectors().select("image_id", "embedding"), NLIST)
    return _shown_search(two_stage.search(
        c.queries(), c.vectors(), c.images(), c.categories(), cut_lineage(c.prototypes()),
        use_prototypes=True, index=index, nprobe=NLIST,
    ))


def _indexed(c):
    return c.vectors().filter(F.col("index_id").isNotNull()).select("image_id", "embedding")


@query
def i9_index_add(c):
    new = lookups.not_indexed(c.vectors()).select("image_id", "embedding")
    index = ann.index_add(ann.ivf_build(_indexed(c), NLIST), new)
    return shown_hits(ann.ivf_search(c.queries(), index, 10, nprobe=NLIST))


@query
def i9_index_append_stored(c):
    path = scratch_path(c.spark, "index")
    save_index(ann.ivf_build(_indexed(c), NLIST), path)
    append_to_index(load_index(c.spark, path), lookups.not_indexed(c.vectors()), path)
    total = c.spark.read.parquet(f"{path}/meta").select("ntotal")
    hits = shown_hits(ann.ivf_search(c.queries(), load_index(c.spark, path), 10, nprobe=NLIST))
    return hits.withColumn("ntotal", F.lit(total.first()[0]).cast("long"))


@query
def i9_replace_in_index(c):
    """Items whose vector changed move to the cell of the new one in the stored index."""
    centroids = cut_lineage(c.prototypes()).select(F.col("category_id").alias("cell"), F.col("prototype").alias("centroid"))
    path = scratch_path(c.spark, "index")
    save_index(ann.ivf_build(c.vectors().select("image_id", "embedding"), centroids=centroids), path)
    changed = c.vectors().filter("image_id % 50 = 0").select("image_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    replace_in_index(load_index(c.spark, path), changed, path)
    index = load_index(c.spark, path)
    return shown_hits(ann.ivf_search(c.queries(), index, 10, nprobe=10))


@query
def i10_register_index(c):
    registry, filled = maintenance.register_index(
        c.indexes(), c.vectors(), "ivfflat", "index/new", dim=64, ntotal=0
    )
    counted = filled.groupBy("index_id").agg(F.count(F.lit(1)).alias("n_vectors"))
    return registry.select("index_id", "index_type", "path").join(counted, "index_id", "left")


# J. Catalog maintenance

@query
def j1_recompute_queue(c):
    queued = c.categories().select("category_id", F.lit(AS_OF).cast("timestamp").alias("last_updated"))
    return maintenance.recompute_queue(c.changes(), c.images(), queued).select("category_id", plain_time("last_updated"))


@query
def j2_deletion_queue(c):
    toxic = c.table("labels").filter("toxic = 1")
    queued = toxic.select(F.col("doc_id").alias("image_id"), F.lit(AS_OF).cast("timestamp").alias("queued_at"))
    return maintenance.deletion_queue(c.changes(), queued).select("image_id", plain_time("queued_at"))


def _stale(c):
    """Categories of deleted items, and one without any vector."""
    stale = maintenance.recompute_queue(c.changes().filter("op = 'DELETE'"), c.images())
    empty = stale.agg((F.max("category_id") + 1).cast("int").alias("category_id"), F.max("last_updated").alias("last_updated"))
    return stale.unionByName(empty)


@query
def j3_drain_recompute(c):
    german = P.all_prototypes(c.vectors(), lookups.metadata_matches(c.images(), lang="de"))
    drained = maintenance.drain_recompute(_stale(c), c.vectors(), c.images(), german)
    return long_prototypes(drained.prototypes)


@query
def j3_drain_recompute_queue(c):
    drained = maintenance.drain_recompute(_stale(c), c.vectors(), c.images(), c.prototypes())
    done = drained.done.select("category_id", F.lit("done").alias("state"))
    return done.unionByName(drained.pending.select("category_id", F.lit("pending").alias("state")))


@query
def j4_drain_deletions(c):
    rebuilt = maintenance.drain_deletions(
        c.deletion_queue(), c.vectors(), c.images(), c.indexes(), "index/new", "ivfflat", nlist=NLIST
    )
    indexed = rebuilt.index.cells.select("image_id", F.lit("indexed").alias("state"))
    left = rebuilt.remaining(c.deletion_queue()).select("image_id", F.lit("queued").alias("state"))
    return indexed.unionByName(left)


@query
def j4_drain_all_vectors(c):
    """Every vector is deleted: the index that is left is empty."""
    every = c.vectors().select("image_id", F.lit(AS_OF).cast("timestamp").alias("queued_at"))
    rebuilt = maintenance.drain_deletions(every, c.vectors(), c.images(), c.indexes(), "index/new", "ivfflat", nlist=NLIST)
    return rebuilt.indexes.withColumn("n_left", F.lit(rebuilt.index.cells.count()).cast("long"))


@query
def j4_drain_deletions_registry(c):
    rebuilt = maintenance.drain_deletions(
        c.deletion_queue(), c.vectors(), c.images(), c.indexes(), "index/new"
    )
    return rebuilt.indexes


def _toxic_ids(c):
    return c.table("labels").filter("toxic = 1").select(F.col("doc_id").alias("image_id"))


def _snapshot_summary(tables):
    keys = {
        "categories": "category_id", "images": "image_id", "vectors": "image_id",
        "prototypes": "category_id", "recompute_queue": "category_id", "deletion_queue": "image_id",
    }
    return reduce(DataFrame.unionByName, [
        tables[name].select(F.lit(name).alias("table_name"), F.col(key).cast("long").alias("key_value"))
        for name, key in keys.items()
    ])


@query
def j5_delete_items(c):
    catalog = c.all() | {"recompute_queue": c.recompute_queue().limit(0)}
    return _snapshot_summary(maintenance.delete_items(catalog, _toxic_ids(c), AS_OF))


@query
def j5_delete_items_counts(c):
    return maintenance.delete_items(c.all(), _toxic_ids(c), AS_OF)["categories"]


@query
def j6_delete_categories(c):
    doomed = c.spark.createDataFrame([(CATEGORY,), (CATEGORY + 4,)], "category_id int")
    return _snapshot_summary(maintenance.delete_categories(c.all(), doomed, AS_OF))


@query
def j6_drop_index(c):
    registry, cleared = maintenance.drop_index(c.indexes(), c.vectors(), INDEX)
    return cleared.select("vector_id", "index_id").join(registry.select("index_id", "path"), "index_id", "left")


@query
def j7_dedupe_append(c):
    existing = c.table("benchmark").select(S.content_sha256(F.encode("text", "UTF-8")).alias("content_hash"))
    result = maintenance.dedupe_append(c.images().drop("content_hash"), existing)
    accepted = result.accepted.select("image_id", "content_hash", F.lit(True).alias("accepted"))
    return accepted.unionByName(result.rejected.select("image_id", "content_hash", F.lit(False).alias("accepted")))


def text_shape(contents: list[bytes]) -> np.ndarray:
    """Bytes, spaces, line ends and full stops of each whole text."""
    return np.array([[len(t), t.count(b" "), t.count(b"\n"), t.count(b".")] for t in contents], dtype=np.float32)


def byte_histogram(contents: list[bytes]) -> np.ndarray:
    """A unit vector of 64 byte-class counts of each whole text."""
    rows = np.stack([np.bincount(np.frombuffer(t, np.uint8) % 64, minlength=64) for t in contents])
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1.0)


@query
def j8_embed_missing(c):
    result = maintenance.embed_missing(c.images(), c.vectors(), text_shape)
    return V.to_long(result.vectors, "image_id", "embedding").select("image_id", "pos", "value")


@query
def j9_rebuild_index(c):
    rebuilt = maintenance.rebuild_index(
        c.vectors(), c.images(), c.indexes(), "index/new", "ivfflat", nlist=NLIST
    )
    return shown_hits(ann.ivf_search(c.queries(), rebuilt.index, 10, nprobe=NLIST))


@query
def j10_bootstrap(c):
    return bootstrap(c.all(), byte_histogram, scratch_path(c.spark, "index")).status.drop("latest_index_path")


@query
def j10_system_check(c):
    catalog = c.all()
    index = ann.flat_build(catalog["vectors"].select("image_id", "embedding"))
    return system_check(catalog, index).select("total_images", "total_vectors", "trial_hits", "trial_found_itself")


def _page_uploads(c):
    kind = F.when(F.col("page_id") % 5 == 0, "text/html").otherwise("image/png")
    return c.table("pages").select(
        F.col("page_id").alias("upload_id"), F.encode("html", "UTF-8").alias("content"), kind.alias("content_type"),
        F.length("html").cast("long").alias("size"), F.col("url").alias("filename"),
        F.when(F.col("page_id") % 2 == 0, (F.col("page_id") % 10 + 1).cast("int")).alias("category_id"),
    )


@query
def j11_upload(c):
    done = requests.upload(
        _page_uploads(c), c.images(), c.vectors(), cut_lineage(c.prototypes()), byte_histogram, AS_OF
    )
    chosen = F.when(F.col("upload_id") % 2 == 0, F.col("category_id"))
    stored = done.placed.join(done.images, "image_id").join(
        done.vectors.select("image_id", "vector_id"), "image_id"
    )
    taken = stored.select(
        "upload_id", "image_id", "vector_id", "content_hash", "metadata", chosen.alias("given_category"),
        F.col("category_id").isNotNull().alias("placed"), F.lit(None).cast("string").alias("reject_reason"),
    )
    return taken.unionByName(done.rejected, allowMissingColumns=True)


@query
def j12_search_by_content(c):
    pages = _page_uploads(c).withColumnRenamed("upload_id", "query_id")
    queries, rejected = requests.embed_queries(pages, byte_histogram)
    found = knn.exact_hits(queries, c.vectors(), 10).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    return found.unionByName(rejected, allowMissingColumns=True)


# K. Streaming

def _run_queue(c, queue, read):
    folder = scratch_path(c.spark, "queue")
    queues.write_queue(queue, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return read(c.spark, f"{folder}/rows")


@query
def k1_stream_recompute_queue(c):
    queue = queues.stream_recompute_queue(c.change_stream(), c.images())
    return _run_queue(c, queue, queues.read_recompute_queue).select("category_id", plain_time("last_updated"))


@query
def k2_stream_deletion_queue(c):
    queue = queues.stream_deletion_queue(c.change_stream())
    return _run_queue(c, queue, queues.read_deletion_queue).select("image_id", plain_time("queued_at"))


def _upkeep(c):
    folder = scratch_path(c.spark, "upkeep")
    catalog = c.all()
    empty = {name: table.limit(0) for name, table in catalog.items() if name.endswith("_queue")}
    sinks.write_catalog(catalog | empty, f"{folder}/catalog")
    return Upkeep(f"{folder}/catalog", f"{folder}/state", rebuild=True), f"{folder}/checkpoint"


def _upkeep_summary(state):
    shown = [
        state["prototypes"].select(F.lit("prototype").alias("kind"), F.col("category_id").cast("long").alias("id"), F.col("n_vectors").alias("n")),
        state["recompute_queue"].select(F.lit("pending").alias("kind"), F.col("category_id").cast("long").alias("id"), F.lit(1).cast("long").alias("n")),
        state["deletion_queue"].select(F.lit("queued").alias("kind"), F.col("image_id").alias("id"), F.lit(1).cast("long").alias("n")),
        state["indexes"].select(F.lit("index").alias("kind"), F.col("index_id").cast("long").alias("id"), F.col("ntotal").alias("n")),
        state["removed"].select(F.lit("removed").alias("kind"), F.col("image_id").alias("id"), F.lit(1).cast("long").alias("n")),
    ]
    return reduce(DataFrame.unionByName, shown)


@query
def k3_run_maintenance(c):
    upkeep, checkpoint = _upkeep(c)
    running = run_maintenance(c.change_stream(), upkeep, checkpoint, "1 second")
    running.processAllAvailable()
    running.stop()
    last = upkeep.last_batch(c.spark)
    state = {t: upkeep.read(c.spark, t, last) for t in ("prototypes", "recompute_queue", "deletion_queue", "indexes", "removed")}
    return _upkeep_summary(state)


@query
def k4_drain_now(c):
    upkeep, checkpoint = _upkeep(c)
    return _upkeep_summary(drain_now(c.change_stream(), upkeep, checkpoint))
