"""Keys stay unique when rows are appended, re-keyed or replaced, and only touched cells are written."""

import pytest
from pyspark.sql import functions as F

from nearfield.operators import ann, knn, upsert
from nearfield.session import scratch_path
from nearfield.sources import index_store, sinks

VECTOR = "image_id long, embedding array<float>"


def test_append_refuses_what_an_item_cannot_have(spark, catalog, make):
    folder = scratch_path(spark, "catalog")
    sinks.write_catalog(catalog, folder)
    new = make([(1, [1.0, 1.0]), (4, [2.0, 2.0]), (4, [1.0, 2.0]), (4, [2.0, 2.0]), (None, [0.0, 0.0]), (3, None), (77, [0.0, 0.0])], VECTOR)
    for rows in (new.where("image_id = 1"), new.where("image_id = 4"), new.where("image_id IS NULL"), new.where("embedding IS NULL")):
        with pytest.raises(upsert.KeyTakenError):
            sinks.append_vectors(rows, folder)
    assert spark.read.parquet(f"{folder}/vectors").count() == 4
    done = sinks.append_vectors(new, folder, on_conflict="skip", images=catalog["images"])
    assert [(r.vector_id, r.image_id) for r in done.accepted.collect()] == [(10, 4)]
    assert sorted((r.image_id or 0, r.reason) for r in done.rejected.collect()) == [
        (0, "null"), (1, "exists"), (3, "null"), (4, "repeated"), (4, "repeated"), (77, "unknown")]
    assert spark.read.parquet(f"{folder}/vectors").groupBy("image_id").count().where("count > 1").isEmpty()
    with pytest.raises(ValueError):
        sinks.append_vectors(new, folder, on_conflict="replace")


def test_rekey_keeps_keys_unique(make, catalog):
    def moved(*pairs):
        tables = upsert.rekey(catalog, "category_id", make(list(pairs), "old int, new int"))
        return sorted((r.category_id, r.category_name) for r in tables["categories"].collect())

    for bad in ([(1, 2)], [(1, 7), (2, 7)], [(1, 7), (1, 8)], [(1, None)], [(None, 9)], [(1, 2), (9, 1)], [(1, 2), (2, 3)]):
        with pytest.raises(upsert.KeyTakenError):
            moved(*bad)
    assert moved((1, 2), (2, 1)) == [(1, "dog"), (2, "cat"), (3, "owl")]
    assert moved((1, 2), (2, 3), (3, 9)) == [(2, "cat"), (3, "dog"), (9, "owl")]
    assert moved((50, 1)) == moved() == [(1, "cat"), (2, "dog"), (3, "owl")]


def test_upsert_vectors_replaces_and_adds(make, catalog):
    new = make([(2, [5.0, 5.0]), (4, [1.0, 1.0]), (4, [1.0, 3.0]), (None, [0.0, 0.0]), (3, None)], VECTOR)
    got = sorted((r.vector_id, r.image_id, r.index_id, r.embedding) for r in upsert.upsert_vectors(catalog["vectors"], new).collect())
    assert got == [(1, 1, None, [1.0, 0.0]), (2, 2, 1, [5.0, 5.0]), (3, 3, None, [4.0, 0.0]), (9, 9, 7, [9.0, 9.0]), (10, 4, None, [1.0, 3.0])]
    assert upsert.upsert_vectors(catalog["vectors"], new.limit(0)).count() == 4


def files(spark, path):
    return {r.f for r in spark.read.parquet(f"{path}/cells").select(F.input_file_name().alias("f")).distinct().collect()}


def test_a_replaced_vector_moves_between_two_cells_only(spark, make, tmp_path):
    items = make([(i, [float(i // 4 * 10), float(i % 4)]) for i in range(16)] + [(90, [500.0, 0.0])], VECTOR)
    centroids = make([(i, [10.0 * i, 1.5]) for i in range(4)] + [(9, [500.0, 0.0])], "cell int, centroid array<double>")
    path = str(tmp_path / "index")
    index_store.save_index(ann.ivf_build(items, centroids=centroids), path)
    before = files(spark, path)
    index_store.replace_in_index(index_store.load_index(spark, path), make([(1, [31.0, 0.0]), (90, [20.0, 1.0]), (70, [0.0, 0.0])], VECTOR), path)
    index = index_store.load_index(spark, path)
    cells = {r.image_id: r.cell for r in index.cells.collect()}
    assert index.cells.count() == 18 and (cells[1], cells[90], cells[70], cells[2], cells[5]) == (3, 2, 0, 0, 1)
    kept = {f for f in before if "cell=1/" in f}
    assert kept and kept <= files(spark, path) and not any("cell=9/" in f for f in files(spark, path))
    for bad in ([(1, [1.0])], [(1, None)], [(1, [1.0, 1.0]), (1, [2.0, 1.0])], [(None, [1.0, 1.0])]):
        with pytest.raises(ValueError):
            index_store.replace_in_index(index, make(bad, VECTOR), path)


def test_two_vectors_of_a_query_give_the_same_on_both_ways(make):
    items = make([(1, [0.0, 0.0], 0), (2, [9.0, 9.0], 1), (3, [9.5, 9.0], 1)], "image_id long, embedding array<float>, cell int")
    queries = make([(5, [0.0, 0.5]), (5, [9.0, 9.2]), (6, [9.0, 9.0])], "query_id long, embedding array<float>")
    probes = make([(5, 0), (5, 1), (5, 1), (6, 1)], "query_id long, cell int")
    ways = [sorted(tuple(r) for r in knn.probe_hits(queries, items, 5, probes, max_broadcast_rows=n).collect()) for n in (100, 0)]
    assert [(r[0], r[1], round(r[2], 3)) for r in ways[0]] == [(r[0], r[1], round(r[2], 3)) for r in ways[1]] and len(ways[0]) == 7  # 5 of the first, 2 of the second


@pytest.mark.parametrize("named", [100, 1])
def test_many_queries_read_probed_folders_only(spark, make, tmp_path, monkeypatch, named):
    monkeypatch.setattr(knn, "MAX_NAMED_CELLS", named)
    items = make([(i, [float(i // 4 * 10), float(i % 4)]) for i in range(40)], VECTOR)
    centroids = make([(i, [10.0 * i, 1.5]) for i in range(10)], "cell int, centroid array<double>")
    path = str(tmp_path / "index")
    index_store.save_index(ann.ivf_build(items, centroids=centroids), path)
    index = index_store.load_index(spark, path)
    queries = make([(i, [20.0, float(i)]) for i in range(5)] + [(9, [31.0, 1.0])], "query_id long, embedding array<float>")
    hits = ann.ivf_search(queries, index, 3, 1, max_broadcast_rows=0)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert ("cell" in plan and "IN (2,3)" in plan.replace(" ", "").replace("cellIN", "cell IN").replace("IN(2,3)", "IN (2,3)")) if named > 1 else "dynamicpruning" in plan
    assert sorted(tuple(r) for r in hits.collect()) == sorted(tuple(r) for r in ann.ivf_search(queries, index, 3, 1).collect())
