from datetime import datetime

import numpy as np
import pytest

from nearfield.operators import maintenance as M
from nearfield.plans.bootstrap import bootstrap
from nearfield.session import scratch_path

T1, T2, T3 = (datetime(2024, 1, day) for day in (1, 2, 3))
CHANGE = "image_id long, category_id int, op string, ts timestamp"


def ids(df, column="image_id"):
    return sorted(r[column] for r in df.collect())


def test_recompute_queue_keeps_the_latest_change(make, catalog):
    changes = make([
        (1, None, "UPDATE", T1), (2, None, "INSERT", T2), (77, 2, "DELETE", T3), (78, None, "DELETE", T3),
    ], CHANGE)
    queued = make([(2, T1), (3, T1)], "recompute_queue")
    rows = M.recompute_queue(changes, catalog["images"], queued).orderBy("category_id").collect()
    assert [tuple(r) for r in rows] == [(1, T2), (2, T3), (3, T1)]


def test_deletion_queue_keeps_the_first_time(make):
    changes = make([(5, 1, "DELETE", T3), (5, 1, "DELETE", T2), (6, 1, "UPDATE", T1), (8, 1, "DELETE", T1)], CHANGE)
    queued = make([(8, T2)], "deletion_queue")
    rows = M.deletion_queue(changes, queued).orderBy("image_id").collect()
    assert [tuple(r) for r in rows] == [(5, T2), (8, T2)]


def test_recomputed_category_leaves_the_queue(make, catalog):
    drained = M.drain_recompute(
        make([(1, T1)], "recompute_queue"), catalog["vectors"], catalog["images"], catalog["prototypes"]
    )
    assert ids(drained.done, "category_id") == [1]
    assert drained.pending.count() == 0
    assert {r.category_id: r.prototype for r in drained.prototypes.collect()}[1] == [0.5, 0.5]


def test_category_without_vectors_stays_pending(make, catalog):
    drained = M.drain_recompute(
        make([(2, T1), (3, T1)], "recompute_queue"), catalog["vectors"], catalog["images"], catalog["prototypes"]
    )
    assert ids(drained.done, "category_id") == [2]
    assert ids(drained.pending, "category_id") == [3]
    kept = {r.category_id: r.prototype for r in drained.prototypes.collect()}
    assert kept == {1: [0.5, 0.5], 2: [4.0, 0.0], 3: [7.0, 7.0]}


def test_deletions_rebuild_the_index(make):
    images = make([(2, b"img2", "{}", 1, "a"), (3, b"img3", "{}", 1, "b")], "images")
    vectors = make([(2, [1.0], None, 2), (3, [2.0], 4, 3), (10, [3.0], None, 10)], "vectors")
    queue = make([(10, T1)], "deletion_queue")
    rebuilt = M.drain_deletions(queue, vectors, images, make([], "indexes"), "p")
    assert ids(rebuilt.index.cells) == [2, 3]
    assert [tuple(r) for r in rebuilt.indexes.collect()] == [(1, "flatl2", "p", 1, 2)]
    assert sorted((r.image_id, r.index_id) for r in rebuilt.vectors.collect()) == [(2, 1), (3, 4)]
    later = make([(10, T1), (11, T2)], "deletion_queue")
    assert ids(rebuilt.remaining(later)) == [11]


def test_nothing_queued_rebuilds_nothing(make, catalog):
    none = make([], "deletion_queue")
    assert M.drain_deletions(none, catalog["vectors"], catalog["images"], catalog["indexes"], "p") is None


def test_delete_items(make, catalog):
    after = M.delete_items(catalog, make([(1,), (4,), (99,)], "image_id long"), T3)
    assert ids(after["images"]) == [2, 3]
    assert ids(after["vectors"]) == [2, 3, 9]
    assert sorted(map(tuple, after["deletion_queue"].collect())) == [(1, T3), (9, T1)]
    assert sorted(map(tuple, after["recompute_queue"].collect())) == [(1, T3), (2, T3)]
    assert [r.image_count for r in after["categories"].orderBy("category_id").collect()] == [1, 1, 0]


def test_deleting_a_queued_item_again_is_no_error(make, catalog):
    queued = catalog | {"deletion_queue": make([(1, T1)], "deletion_queue")}
    after = M.delete_items(queued, make([(1,)], "image_id long"), T3)
    assert [tuple(r) for r in after["deletion_queue"].collect()] == [(1, T1)]


def test_delete_categories_cascades(make, catalog):
    after = M.delete_categories(catalog, make([(1,)], "category_id int"), T3)
    assert ids(after["categories"], "category_id") == [2, 3]
    assert ids(after["prototypes"], "category_id") == [3]
    assert ids(after["images"]) == [3, 4]
    assert ids(after["vectors"]) == [3, 9]
    assert ids(after["deletion_queue"]) == [1, 2, 9]


def test_drop_index_clears_its_vectors(catalog):
    indexes, vectors = M.drop_index(catalog["indexes"], catalog["vectors"], 1)
    assert indexes.count() == 0
    assert sorted((r.image_id, r.index_id) for r in vectors.collect()) == [(1, None), (2, None), (3, None), (9, 7)]


def test_register_fills_only_missing_ids(catalog):
    indexes, vectors = M.register_index(catalog["indexes"], catalog["vectors"], "flatl2", "q", dim=2, ntotal=4)
    assert ids(indexes, "index_id") == [1, 2]
    assert sorted((r.image_id, r.index_id) for r in vectors.collect()) == [(1, 2), (2, 1), (3, 2), (9, 7)]


def test_equal_contents_are_accepted_once(spark, make):
    new = make([(i, b"same") for i in range(50)] + [(60, b"old"), (61, b"new")], "image_id long, content binary")
    existing = M.dedupe_append(make([(1, b"old")], "image_id long, content binary"),
                               make([], "content_hash string")).accepted
    result = M.dedupe_append(new, existing)
    assert ids(result.accepted) == [0, 61]
    assert ids(result.rejected) == list(range(1, 50)) + [60]
    with pytest.raises(M.DuplicateContentError):
        M.dedupe_append(new, existing, "error")
    M.dedupe_append(new.filter("image_id = 61"), existing, "error")


def test_embedding_goes_on_after_a_bad_item(make, catalog):
    def embedder(contents):
        if b"img4" in contents:
            raise RuntimeError("cannot decode")
        return np.array([[len(c), 1.0] for c in contents])

    more = catalog["images"].union(make([(5, b"longer", "{}", 1, "h5")], "images")).coalesce(1)
    result = M.embed_missing(more, catalog["vectors"], embedder)
    assert [(r.image_id, r.embedding) for r in result.vectors.collect()] == [(5, [6.0, 1.0])]
    assert [(r.image_id, r.error) for r in result.errors.collect()] == [(4, "RuntimeError: cannot decode")]


def test_rebuild_leaves_out_vectors_without_item(catalog):
    rebuilt = M.rebuild_index(catalog["vectors"], catalog["images"], catalog["indexes"], "p")
    assert ids(rebuilt.index.cells) == [1, 2, 3]
    empty = M.rebuild_index(catalog["vectors"].limit(0), catalog["images"], catalog["indexes"], "p")
    assert empty.index.cells.count() == 0 and empty.index.dim == 2


def test_bootstrap(spark, catalog):
    done = bootstrap(catalog, lambda contents: np.ones((len(contents), 2)), scratch_path(spark, "index"))
    row = done.status.first()
    assert (row.total_vectors, row.categories_with_prototypes, row.latest_index_id, row.latest_index_ntotal) == (5, 2, 2, 4)
    assert ids(done.index.cells) == [1, 2, 3, 4]
    assert done.errors.count() == 0


def test_null_category_is_never_queued(make, catalog):
    from datetime import datetime

    images = make([(1, b"a", "{}", None, "h1"), (2, b"b", "{}", 2, "h2")], "images")
    changes = make([(1, None, "UPDATE", datetime(2024, 1, 1)), (2, None, "UPDATE", datetime(2024, 1, 1))], "image_id long, category_id int, op string, ts timestamp")
    assert [r.category_id for r in M.recompute_queue(changes, images).collect()] == [2]
    ids = make([(1,), (2,)], "image_id long")
    after = M.delete_items(catalog | {"images": images}, ids, "2024-01-01 00:00:00")
    assert [r.category_id for r in after["recompute_queue"].collect()] == [2]


def test_draining_the_last_vector_leaves_an_empty_index(make, catalog):
    from datetime import datetime

    every = catalog["vectors"].select("image_id").distinct()
    queue = make([(r.image_id, datetime(2024, 1, 1)) for r in every.collect()], "deletion_queue")
    result = M.drain_deletions(queue, catalog["vectors"], catalog["images"], catalog["indexes"], "p", "ivfflat")
    assert result.index.cells.count() == 0 and result.remaining(queue).count() == 0
    assert result.indexes.orderBy("index_id").collect()[-1][2:] == ("p", 2, 0)


def test_absent_content_is_no_duplicate(make):
    new = make([(1, None), (2, None), (3, b"x"), (4, b"x")], "image_id long, content binary")
    result = M.dedupe_append(new, make([], "content_hash string"), "skip")
    rows = [sorted(r.image_id for r in part.collect()) for part in (result.accepted, result.rejected, result.absent)]
    assert rows == [[3], [4], [1, 2]]


def test_repeated_keys_merge_once(make):
    from nearfield.operators import upsert

    old = make([(1, "one", 5)], "categories")
    new = make([(1, "uno", 1), (5, "first", 2), (5, "last", 3)], "category_id int, category_name string, at int")
    names = lambda mode: {r.category_id: r.category_name for r in upsert.upsert_categories(old, new, mode, order_by="at").collect()}
    assert names("ignore") == {1: "one", 5: "first"} and names("update") == {1: "uno", 5: "last"}
    assert upsert.upsert_categories(old, new, "update").count() == 2


def test_new_names_get_fresh_ids_and_keys_cascade(make, catalog):
    from nearfield.operators import upsert

    added = upsert.insert_categories(catalog["categories"], make([("owl",), ("ape",), ("ape",), ("zebra",)], "category_name string"))
    assert [tuple(r)[:2] for r in added.orderBy("category_id").collect()] == [(1, "cat"), (2, "dog"), (3, "owl"), (4, "ape"), (5, "zebra")]
    moved = upsert.rekey(catalog, "image_id", make([(2, 20)], "old long, new long"))
    assert sorted(r.image_id for r in moved["images"].collect()) == [1, 3, 4, 20]
    assert sorted(r.image_id for r in moved["vectors"].collect()) == [1, 3, 9, 20]


def test_integrity_reports_nulls_and_queue_keys(make, catalog):
    from datetime import datetime

    from nearfield.operators.integrity import integrity_report

    images = make([(1, None, "{}", 1, "h1"), (2, b"x", "{}", None, "h2")], "images")
    queue = make([(8, datetime(2024, 1, 1))], "recompute_queue")
    rows = {tuple(r) for r in integrity_report(catalog | {"images": images, "recompute_queue": queue}).collect()}
    assert {("null", "images", "content", None, 1), ("null", "images", "category_id", None, 1), ("orphan", "recompute_queue", "category_id", "8", 1)} <= rows


def test_an_empty_queue_is_shown_with_zero(catalog):
    from nearfield.operators.reports import queue_heads

    rows = {r.queue: (r.id, r.n_shown) for r in queue_heads(catalog["recompute_queue"], catalog["deletion_queue"]).collect()}
    assert rows == {"prototype_recompute": (None, 0), "vector_deletion": (9, 1)}
