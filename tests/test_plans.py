"""The plans behind the operators: what is shuffled, joined and read."""

import pytest
from pyspark.sql import functions as F

from nearfield.operators import joins, knn, lookups, maintenance, reports
from nearfield.operators import prototypes as P
from nearfield.operators import search as two_stage
from nearfield.session import scratch_path
from nearfield.sources import sinks
from nearfield.sources.catalog import read_catalog


@pytest.fixture
def stored(spark, catalog, monkeypatch):
    """The catalog read back from files, with broadcasting by table size off,
    as if every table were large."""
    folder = scratch_path(spark, "catalog")
    sinks.write_catalog(catalog, folder)
    monkeypatch.setattr(knn, "SPREAD_BYTES_PER_CORE", 0)
    return read_catalog(spark, folder)


@pytest.fixture
def queries(make):
    return make([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "query_id long, embedding array<float>")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flat_search_shuffles_hits_only(stored, queries):
    text = plan(knn.knn_exact(queries, stored["vectors"], 3))
    assert text.count("Exchange") == 1 and "hashpartitioning(query_id" in text
    assert "WindowGroupLimit" in text
    assert "ReadSchema: struct<embedding:array<float>,image_id:bigint>" in text


def test_classification_and_ranking_shuffle_nothing(stored, queries):
    items = stored["vectors"].select("image_id", "embedding")
    assert "Exchange" not in plan(P.predict_category(items, stored["prototypes"]))
    assert "Exchange" not in plan(P.top_categories(queries, stored["prototypes"], 2))


def test_no_search_joins_by_pairs(stored, queries):
    for df in (
        knn.exact_hits(queries, stored["vectors"], 3),
        knn.exact_hits(queries, stored["vectors"], 3, max_broadcast_rows=0),
        two_stage.search_prefilter(queries, stored["vectors"], stored["images"], stored["prototypes"], max_broadcast_rows=0),
        two_stage.search(queries, stored["vectors"], stored["images"], stored["categories"], stored["prototypes"], use_prototypes=True),
    ):
        assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df)


def test_items_are_not_shuffled_to_meet_hits(spark, stored, queries):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        text = plan(two_stage.search(
            queries, stored["vectors"], stored["images"], stored["categories"], stored["prototypes"], use_prototypes=True
        ))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(image_id" not in text
    assert "content" not in text


def test_lookup_is_pushed_to_the_files(stored):
    text = plan(lookups.lookup(stored["images"], "image_id", 42))
    assert "EqualTo(image_id,42)" in text


def test_counts_read_no_payload(stored):
    text = plan(reports.catalog_status(stored))
    assert "content" not in text and "embedding" not in text


def test_stored_members_are_pruned_and_not_joined(spark, stored, queries):
    folder = scratch_path(spark, "members")
    sinks.write_members(stored["vectors"], stored["images"], folder)
    members = sinks.read_members(spark, folder)
    text = plan(two_stage.search_prefilter(queries, members, stored["images"], stored["prototypes"], 3, 1))
    assert "PartitionFilters: [isnotnull(category_id" in text
    assert "Join" not in text
    assert "Join" not in plan(P.all_prototypes(members, stored["images"]))


def test_bucketed_tables_join_in_place(spark, stored):
    names = [scratch_path(spark, "t").rsplit("/", 1)[1].replace("-", "_") for _ in range(2)]
    vectors = sinks.save_bucketed(stored["vectors"], names[0], 4)
    images = sinks.save_bucketed(stored["images"], names[1], 4)
    joined = vectors.hint("merge").join(images, "image_id")
    text = plan(joined)
    spark.sql(f"DROP TABLE {names[0]}")
    spark.sql(f"DROP TABLE {names[1]}")
    assert "SortMergeJoin" in text and "Exchange" not in text


def test_duplicates_are_found_without_their_content(stored):
    new = stored["images"].withColumn("image_id", F.col("image_id") + 100)
    result = maintenance.dedupe_append(new, stored["images"])
    assert result.accepted.count() == 0
    assert "Exchange hashpartitioning" not in plan(result.rejected)


def test_missing_items_are_found_by_id(stored):
    text = plan(joins.without_vectors(stored["images"], stored["vectors"]))
    assert "Exchange hashpartitioning" not in text


def test_hash_search_ranks_and_dedupes_in_one_shuffle(stored, queries):
    from nearfield.operators import ann

    text = plan(ann.ann_lsh(queries, stored["vectors"], 3, bucket_length=4.0, max_broadcast_rows=0))
    after_grid = text.split("FlatMapCoGroupsInArrow")[0]
    assert after_grid.count("Exchange") == 1


@pytest.mark.parametrize("bound", [8192, 0])
def test_hash_search_moves_no_vector_before_the_fetch(stored, queries, bound, monkeypatch):
    """Postings, probed buckets and candidates meet without vectors; a block of queries moves none at all."""
    from nearfield.operators import ann

    met = []
    cut = ann.cut_lineage
    monkeypatch.setattr(ann, "cut_lineage", lambda df: met.append(plan(df)) or cut(df))
    text = plan(ann.ann_lsh(queries, stored["vectors"], 3, bucket_length=4.0, max_broadcast_rows=bound))
    assert len(met) == 1
    moved = [line for line in met[0].splitlines() if "Exchange" in line]
    assert moved and "embedding" not in met[0][: met[0].index("MapInArrow")]
    if bound:
        assert text.count("Exchange hashpartitioning") == 1  # hits, by query


def test_ids_move_no_content(stored, make):
    from nearfield.operators import ids

    made, cut = [], ids.cut_lineage
    new = stored["images"].drop("image_id")
    ids.cut_lineage = lambda df: made.append(plan(df)) or cut(df)
    try:
        text = plan(ids.allocate_ids(new, stored["images"], "image_id", order_by="content_hash"))
    finally:
        ids.cut_lineage = cut
    assert "Exchange" not in made[0] and "Sort" not in made[0]  # the rows, where they are
    assert "Exchange rangepartitioning" in made[1] and "content#" not in made[1].split("Scan")[0]
    assert "Exchange hashpartitioning" not in text and "Sort" not in text


def test_large_sides_give_the_same_results(catalog, make, monkeypatch):
    """With no side small enough to travel, joins shuffle and agree."""
    from nearfield.operators import bounds, integrity

    ids = make([(1,), (4,)], "image_id long")
    content = make([(7, b"img9"), (8, b"img9"), (9, b"x")], "image_id long, content binary")

    def results():
        yield joins.items_without_vectors(catalog["images"], catalog["vectors"], catalog["categories"])
        yield joins.categories_with_items(catalog["categories"], catalog["images"])
        yield integrity.integrity_report(catalog)
        yield from maintenance.delete_items(catalog, ids, "2024-01-03").values()
        yield maintenance.dedupe_append(content, catalog["images"]).accepted
        yield P.prototypes_of(catalog["categories"], catalog["vectors"], catalog["images"])

    small = [sorted(map(str, df.collect())) for df in results()]
    monkeypatch.setattr(bounds, "MAX_SMALL_ROWS", 0)
    assert [sorted(map(str, df.collect())) for df in results()] == small


def test_contents_stay_where_they_are_beside_many_labels(spark, tmp_path, monkeypatch):
    """More labels and copies than a local table holds travel to the items; neither shuffles contents."""
    from nearfield.operators import bounds
    from nearfield.sources.sample import SampleCatalog

    spark.range(40).selectExpr("id AS doc_id", "concat('text ', id % 10) AS text", "'en' AS lang", "'a' AS source", "6L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(20).selectExpr("id AS vec_id", "array(1.0f, 2.0f) AS embedding", "cast(id % 10 AS int) AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(bounds, "MAX_SMALL_ROWS", 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        images = SampleCatalog(spark, str(tmp_path)).images()
        result = maintenance.dedupe_append(images, images.select("content_hash").limit(0))
        text = plan(images) + plan(result.accepted) + plan(result.rejected)
        assert result.accepted.count() == 10 and result.rejected.count() == 30
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text
