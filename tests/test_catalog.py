from datetime import datetime

import pytest

from nearfield.operators import integrity, joins, lookups, reports, upsert
from nearfield.operators.ids import allocate_ids
from nearfield.session import scratch_path
from nearfield.sources import catalog as reading
from nearfield.sources import sinks


def test_catalog_round_trip(spark, catalog):
    folder = scratch_path(spark, "catalog")
    sinks.write_catalog(catalog, folder)
    for name, table in reading.read_catalog(spark, folder).items():
        assert table.schema == catalog[name].schema
        assert sorted(table.collect(), key=str) == sorted(catalog[name].collect(), key=str)


def test_appends_count_ids_on(spark, catalog, make):
    folder = scratch_path(spark, "catalog")
    sinks.write_catalog(catalog, folder)
    new = make([(b"x", "{}", 1), (b"y", "{}", 2)], "content binary, metadata string, category_id int")
    written = sinks.append_items(new, folder)
    assert sorted(r.image_id for r in written.collect()) == [5, 6]
    assert reading.read_table(spark, folder, "images").count() == 6
    sinks.append_vectors(make([(5, [1.0, 1.0])], "image_id long, embedding array<float>"), folder)
    row = reading.read_table(spark, folder, "vectors").filter("image_id = 5").first()
    assert (row.vector_id, row.index_id) == (10, None)


def test_ids_are_dense_and_ordered(spark, make):
    new = spark.range(1000).selectExpr("id * 7 % 1000 as key").repartition(7)
    existing = make([(41,)], "image_id long")
    rows = allocate_ids(new, existing, "image_id", order_by="key").collect()
    assert sorted((r.key, r.image_id) for r in rows) == [(i, 42 + i) for i in range(1000)]
    empty = make([], "image_id long")
    assert allocate_ids(new, empty, "image_id", order_by="key").agg({"image_id": "min"}).first()[0] == 1


def test_ids_of_equal_order_keys_and_large_inputs(spark, make, monkeypatch):
    """Equal keys are numbered as they come, nulls first; numbers too large to travel give the same ids."""
    from nearfield.operators import ids

    new = make([("b", 1), (None, 2), ("a", 3), ("b", 4), ("a", 5)], "key string, n long").coalesce(1)
    existing = make([(9,)], "image_id long")
    want = [(10, None, 2), (11, "a", 3), (12, "a", 5), (13, "b", 1), (14, "b", 4)]
    assert sorted(map(tuple, allocate_ids(new, existing, "image_id", order_by="key").collect())) == want
    monkeypatch.setattr(ids, "MAX_SMALL_BYTES", 0)
    rows = allocate_ids(new, existing, "image_id", order_by=["key"])
    assert sorted(map(tuple, rows.collect())) == want and rows.columns == ["image_id", "key", "n"]
    assert allocate_ids(new.limit(0), existing, "image_id", order_by="key").count() == 0


def test_upsert_modes(catalog, make):
    new = make([(2, "wolf"), (9, "bee")], "category_id int, category_name string")
    kept = upsert.upsert_categories(catalog["categories"], new, "ignore")
    renamed = upsert.upsert_categories(catalog["categories"], new, "update")
    assert {tuple(r) for r in kept.collect()} == {(1, "cat", 2), (2, "dog", 2), (3, "owl", 0), (9, "bee", 0)}
    assert {tuple(r) for r in renamed.collect()} == {(1, "cat", 2), (2, "wolf", 2), (3, "owl", 0), (9, "bee", 0)}
    with pytest.raises(ValueError):
        upsert.upsert_categories(catalog["categories"], new, "replace")


def test_ingest_takes_the_first_of_a_split(make):
    src = make([(i, b"%d" % i, i % 3, "train" if i < 8 else "test") for i in range(10)],
               "item_index long, content binary, label int, split string")
    rows = reading.ingest_items(
        src, "train", 3, source="toys", description="d", split_column=src.split
    ).orderBy("item_index").collect()
    assert [(r.item_index, r.category_id) for r in rows] == [(0, 1), (1, 2), (2, 3)]
    assert rows[1].metadata == (
        '{"source":"toys","image_index":1,"split":"train","description":"d","format":"PNG"}'
    )


def test_reads_raw_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"no")
    rows = reading.read_files(spark, str(tmp_path), "*.bin").collect()
    assert [(bytes(r.content), r.length) for r in rows] == [(b"abc", 3)]


def test_upload_rules(make):
    rows = make([
        (1, "image/png", 5), (2, "text/html", 5), (3, None, 5), (4, "image/png", 10 * 1024 * 1024),
        (5, "image/png", 10 * 1024 * 1024 + 1), (6, "image/gif", None),
    ], "id int, content_type string, size long")
    assert [r.id for r in lookups.accepted_uploads(rows).orderBy("id").collect()] == [1, 4, 6]
    reasons = {r.id: r.reject_reason for r in lookups.rejected_uploads(rows).collect()}
    assert reasons == {2: "File must be an image", 3: "File must be an image", 5: "File too large"}


def test_purge_keeps_the_last_hour(make):
    queue = make([(1, datetime(2024, 1, 1, 10)), (2, datetime(2024, 1, 1, 11)), (3, datetime(2024, 1, 1, 11, 30))],
                 "deletion_queue")
    old = lookups.older_than(queue, "queued_at", "2024-01-01 12:00:00")
    assert [r.image_id for r in old.collect()] == [1]
    kept = lookups.purge(queue, "queued_at", "2024-01-01 12:00:00")
    assert sorted(r.image_id for r in kept.collect()) == [2, 3]


def test_items_without_vectors(catalog):
    rows = joins.items_without_vectors(catalog["images"], catalog["vectors"], catalog["categories"]).collect()
    assert [(r.image_id, r.category_name, r.total_images_in_category) for r in rows] == [(4, "dog", 2)]


def test_breakdown_and_status(catalog):
    rows = reports.category_breakdown(catalog["categories"], catalog["images"]).orderBy("category_id").collect()
    assert [tuple(r) for r in rows] == [(1, "cat", 2), (2, "dog", 2), (3, "owl", 0)]
    row = reports.catalog_status(catalog).first()
    assert tuple(row) == (3, 4, 4, 2, 1, "flatl2", "index/1", 3)


def test_status_of_an_empty_catalog(catalog):
    empty = {name: table.limit(0) for name, table in catalog.items()}
    assert tuple(reports.catalog_status(empty).first()) == (0, 0, 0, 0, None, None, None, None)


def test_category_items_report_both_counts(catalog):
    rows = reports.category_items(catalog["images"], catalog["categories"], 1, 1).collect()
    assert [(r.image_id, r.shown_count, r.total_count) for r in rows] == [(1, 1, 2)]
    with pytest.raises(ValueError):
        reports.category_items(catalog["images"], catalog["categories"], 1, 0)


def test_counts_never_fall_below_zero(catalog, make):
    changes = make([(1, "DELETE")] * 5 + [(3, "INSERT"), (3, "UPDATE")], "category_id int, op string")
    rows = reports.apply_count_changes(catalog["categories"], changes).orderBy("category_id").collect()
    assert [r.image_count for r in rows] == [0, 2, 1]


def test_integrity_report(catalog, make):
    broken = catalog | {"images": catalog["images"].union(make([(3, b"", "{}", 8, "h1")], "images"))}
    rows = {tuple(r) for r in integrity.integrity_report(broken).collect()}
    assert rows == {
        ("orphan", "images", "category_id", "8", 1),
        ("orphan", "vectors", "image_id", "9", 1),
        ("orphan", "vectors", "index_id", "7", 1),
        ("duplicate", "images", "image_id", "3", 2),
        ("duplicate", "images", "content_hash", "h1", 2),
    }
