import numpy as np
import pytest

from nearfield.operators import ann, knn
from nearfield.session import scratch_path
from nearfield.sources.index_store import append_to_index, load_index, replace_in_index, save_index


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(12, 16)) * 4
    vectors = centers[rng.integers(0, 12, 600)] + rng.normal(size=(600, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors.astype(np.float32))]
    items = spark.createDataFrame(rows, "image_id long, embedding array<float>").repartition(4).cache()
    return items, items.withColumnRenamed("image_id", "query_id")


def pairs(hits):
    return sorted((r.query_id, r.rank, r.image_id) for r in hits.collect())


@pytest.fixture(scope="module")
def index(corpus):
    return ann.ivf_build(corpus[0], 12, seed=5)


@pytest.mark.parametrize("bound", [8192, 0])
def test_all_cells_probed_is_exact(corpus, index, bound):
    items, queries = corpus
    exact = knn.knn_exact(queries, items, 10)
    assert pairs(ann.ivf_search(queries, index, 10, 12, max_broadcast_rows=bound)) == pairs(exact)


@pytest.mark.parametrize("bound", [8192, 0])
def test_few_cells_reach_most_hits(corpus, index, bound):
    items, queries = corpus
    exact = knn.knn_exact(queries, items, 10)
    found = ann.ivf_search(queries, index, 10, 2, max_broadcast_rows=bound)
    mean = ann.recall(found, exact).agg({"recall": "avg"}).first()[0]
    assert mean > 0.9


def test_lsh_recall(corpus):
    items, queries = corpus
    exact = knn.knn_exact(queries, items, 10)
    found = ann.ann_lsh(queries, items, 10, bucket_length=8.0, num_tables=8)
    assert found.dropDuplicates(["query_id", "image_id"]).count() == found.count()
    assert ann.recall(found, exact).agg({"recall": "avg"}).first()[0] > 0.9


def _plain_lsh(vectors, hashing, k):
    """By brute force: of the vectors in one of a vector's buckets the k nearest."""
    names = hashing.names(vectors)
    out = []
    for q in range(len(vectors)):
        shared = (names == names[q]).all(axis=2).any(axis=1)
        distance = np.square(vectors.astype(float) - vectors[q].astype(float)).sum(axis=1)
        best = sorted((d, i) for i, (d, s) in enumerate(zip(distance, shared)) if s)[:k]
        out += [(q, r + 1, i) for r, (_, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("bound", [8192, 0])
def test_stored_postings_give_what_the_buckets_hold(spark, corpus, bound):
    """Fitted, appended to, loaded, shrunk and moved: always the plain search of the vectors that are there."""
    items, queries = corpus
    vectors = np.array([r.embedding for r in items.orderBy("image_id").collect()], dtype=np.float32)
    hashing = ann.HashTables.random(16, 3.0, 4, 2, seed=3)
    path = scratch_path(spark, "index")
    save_index(ann.lsh_build(items.filter("image_id < 400"), hashing), path)
    append_to_index(load_index(spark, path), items.filter("image_id >= 300"), path)
    index = load_index(spark, path)
    assert index.postings.count() == 4 * 600 and "embedding" not in index.postings.columns
    want = _plain_lsh(vectors, hashing, 10)
    assert pairs(ann.index_hits(queries, index, 10, max_broadcast_rows=bound)) == want
    if bound:
        return
    moved = items.filter("image_id % 50 = 0").selectExpr("image_id", "transform(embedding, x -> -x) AS embedding")
    replace_in_index(index, moved, path)
    vectors[::50] *= -1
    found = pairs(ann.index_hits(queries, load_index(spark, path), 10))
    want = {(q, i) for q, _, i in _plain_lsh(vectors, hashing, 10)}
    assert {(q, i) for q, _, i in found if q % 50} == {(q, i) for q, i in want if q % 50}
    gone = ann.index_remove(load_index(spark, path), items.filter("image_id < 300").select("image_id"))
    assert gone.postings.count() == 4 * 300 and min(r.image_id for r in ann.index_hits(queries, gone, 3).collect()) >= 300


def test_crowded_bucket_and_repeated_vectors(make):
    """One bucket holds all items in each table, many equal: pairs count once, ties go to the smaller id."""
    rows = [(i, [1.0, 1.0] if i % 3 else [2.0, 2.0]) for i in range(90)]
    items = make(rows, "image_id long, embedding array<float>").repartition(5)
    queries = make([(7, [1.0, 1.0]), (8, [900.0, -900.0])], "query_id long, embedding array<float>")
    for bound in (8192, 0):
        found = pairs(ann.ann_lsh(queries, items, 5, bucket_length=1e3, max_broadcast_rows=bound, projections=np.eye(16, 2) + 1e-3))
        assert [f for f in found if f[0] == 7] == [(7, 1, 1), (7, 2, 2), (7, 3, 4), (7, 4, 5), (7, 5, 7)]
    none = items.limit(0)
    index = ann.lsh_build(none, ann.HashTables.random(2))
    assert ann.index_hits(queries, index, 3).count() == 0
    assert ann.index_hits(queries.limit(0), ann.lsh_build(items, ann.HashTables.random(2)), 3).count() == 0


def test_stored_index_is_the_same_index(spark, corpus, index):
    items, queries = corpus
    path = scratch_path(spark, "index")
    meta = save_index(index, path).first()
    assert (meta.index_type, meta.dim, meta.ntotal) == ("ivfflat", 16, 600)
    stored = load_index(spark, path)
    found = ann.ivf_search(queries.filter("query_id < 3"), stored, 5, 2)
    assert pairs(found) == pairs(ann.ivf_search(queries.filter("query_id < 3"), index, 5, 2))
    plan = stored.cells.filter("cell in (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


@pytest.mark.parametrize("index_type", ann.INDEX_TYPES)
def test_added_and_removed_items(corpus, index_type):
    items, queries = corpus
    some, rest = items.filter("image_id < 400"), items.filter("image_id >= 400")
    one = queries.filter("query_id = 450")
    before = ann.build_index(some, index_type, nlist=6)
    after = ann.index_add(before, rest)
    assert 450 not in [r.image_id for r in ann.search_index(one, before, 3, nprobe=6).collect()]
    assert ann.search_index(one, after, 3, nprobe=6).filter("rank = 1").first().image_id == 450
    gone = ann.index_remove(after, rest.filter("image_id = 450"))
    assert 450 not in [r.image_id for r in ann.search_index(one, gone, 3, nprobe=6).collect()]


def test_append_to_stored_index(spark, corpus):
    items, queries = corpus
    path = scratch_path(spark, "index")
    save_index(ann.build_index(items.filter("image_id < 400"), "ivfflat", nlist=6), path)
    append_to_index(load_index(spark, path), items.filter("image_id >= 400"), path)
    stored = load_index(spark, path)
    assert stored.cells.count() == 600
    exact = knn.knn_exact(queries, items, 4)
    assert pairs(ann.ivf_search(queries, stored, 4, 6)) == pairs(exact)


def test_more_centroids_than_the_bound_meet_in_blocks(corpus):
    index = ann.ivf_build(corpus[0], 12, seed=5)
    cells = {r.image_id: r.cell for r in index.cells.collect()}
    on_grid = ann.assign_cells(corpus[0], index.centroids, max_cells=5)
    assert {r.image_id: r.cell for r in on_grid.collect()} == cells and len(cells) == 600


def test_appended_items_are_counted_once_and_checked(spark, corpus, make):
    items, _ = corpus
    path = scratch_path(spark, "index")
    save_index(ann.build_index(items.filter("image_id < 400"), "flatl2"), path)
    append_to_index(load_index(spark, path), items.filter("image_id >= 300"), path)
    assert spark.read.parquet(f"{path}/meta").first()["ntotal"] == 600 == load_index(spark, path).cells.count()
    with pytest.raises(ValueError):
        append_to_index(load_index(spark, path), make([(9000, [1.0])], "image_id long, embedding array<float>"), path)


def test_unknown_type(corpus):
    with pytest.raises(ValueError):
        ann.build_index(corpus[0], "tree")


@pytest.mark.parametrize("rows,nlist", [(1, 5), (3, 1), (2, 5)])
def test_tiny_indexes(make, rows, nlist):
    items = make([(i, [float(i), 0.0]) for i in range(rows)], "image_id long, embedding array<float>")
    index = ann.ivf_build(items, nlist)
    queries = make([(0, [0.1, 0.0])], "query_id long, embedding array<float>")
    found = ann.ivf_search(queries, index, 5, nlist).orderBy("rank").collect()
    assert [r.image_id for r in found] == list(range(rows))


def test_no_vectors_no_index(make):
    with pytest.raises(ValueError):
        ann.ivf_build(make([], "image_id long, embedding array<float>"))
